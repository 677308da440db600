"""Star-schema tables seen as market tables; used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.sources import schemas as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dam(spark: SparkSession, sf_dir: str) -> DataFrame:
    mw = F.expr("l_quantity * (1 + l_suppkey % 10)")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(S.SEQ),
        F.expr("l_shipdate + make_dt_interval(0, l_linenumber - 1)").alias(S.STARTTIME),
        mw.alias(S.MW),
        (F.floor(F.col("l_extendedprice") / 10 + 0.5) / 100).alias(S.PRICE),
        F.when(F.col("l_returnflag") == "R", mw * 0.9).alias(S.SELF),
        F.when(F.col("l_linestatus") == "F", "EN").otherwise("RU").alias(S.PRODUCT),
        F.lit("GENERATOR").alias(S.RESOURCE_TYPE),
    )


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "FORCED").otherwise("PLANNED").alias(S.KIND),
        F.expr("concat('RES_', o_custkey % 60)").alias(S.RES),
        F.expr("concat('Resource ', o_custkey % 60)").alias(S.NAME),
        F.expr("50.0D * (1 + o_custkey % 10) * CASE WHEN o_orderkey % 13 = 0 THEN 1.04D ELSE 1.0D END").alias(S.PMAX),
        F.expr("round(50.0D * (1 + o_custkey % 10) * ((o_orderkey % 11) / 10.0D), 2)").alias(S.CURT),
        F.col("o_orderdate").alias(S.OUT_START),
        F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + make_dt_interval(cast(o_orderkey % 5 + 1 AS int)) END").alias(S.OUT_STOP),
    )


def rtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where("event_type <> 'error'").select(
        F.lit("EN").alias(S.PRODUCT),
        F.col("user_id").alias(S.SEQ),
        F.col("value").alias(S.MW),
        F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias(S.BID_START),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN ts + make_dt_interval(0, 1) END").alias(S.BID_STOP),
        F.col("ts").alias(S.RUN_START),
        F.expr("ts + make_dt_interval(0, 1)").alias(S.RUN_STOP),
    )


def rtm_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-time bids with prices: the hour's offers of an id make its curve."""
    return S.normalize_rtm_curves(_table(spark, sf_dir, "events").where("event_type <> 'error'").select(
        F.col("user_id").alias(S.SEQ),
        F.expr("date_trunc('HOUR', ts)").alias(S.STARTTIME),
        F.col("value").alias(S.MW),
        F.expr("(event_id % 400) / 4.0D - 10.0D").alias(S.PRICE),
        F.expr("CASE WHEN event_id % 11 = 0 THEN value / 2 END").alias(S.SELF),
    ))


def full_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "ts + make_dt_interval(0, 0, cast(60 + event_id % 9 - 4 AS int))"
    pmax = F.expr("50.0D + 10 * (user_id % 40)")
    return _table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')").select(
        F.lit("FORCED").alias(S.KIND),
        F.expr("concat('GEN_', user_id % 40)").alias(S.RES),
        F.expr("concat('Generator ', user_id % 40)").alias(S.NAME),
        pmax.alias(S.PMAX),
        pmax.alias(S.CURT),
        F.expr(start).alias(S.OUT_START),
        F.expr(f"CASE WHEN event_id % 7 <> 0 THEN {start} + make_dt_interval(0, 0, cast(30 + event_id % 300 AS int)) END").alias(S.OUT_STOP),
    )
