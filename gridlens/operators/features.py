"""Behavioural features of each bid id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.exprs import finite
from gridlens.sources.schemas import MW, PRICE, PRODUCT, RESOURCE_TYPE, SELF, SEQ, STARTTIME

HOURS = [f"hour_{h:02d}" for h in range(24)]
KNOTS = ["mean_knots", "median_knots", "pct_single"]
FLAGS = ["has_null", "has_negative", "pct_self_sched"]
COLUMNS = [SEQ, *KNOTS, *FLAGS, *HOURS, "start", "end", "max_mw"]


def generator_bids(bids: DataFrame) -> DataFrame:
    return bids.where((F.col(PRODUCT) == "EN") & (F.col(RESOURCE_TYPE) == "GENERATOR") & F.col(SEQ).isNotNull())


def by_curve(bids: DataFrame) -> DataFrame:
    """One row for each id and start time: its number of points (knots) and what the features need of them."""
    x, s = F.col(MW), F.col(SELF)
    return generator_bids(bids).groupBy(SEQ, STARTTIME).agg(
        F.count("*").alias("knots"),
        F.max(finite(x)).alias("bid_mw"),
        F.max(finite(s)).alias("self_mw"),
        F.bool_or(s.isNull() & x.isNull() & F.col(PRICE).isNull()).alias("any_null"),
        F.bool_or(F.coalesce(x < 0, F.lit(False)) | F.coalesce(s < 0, F.lit(False))).alias("any_negative"),
        F.count(s).alias("self_rows"),
    )


def features(bids: DataFrame) -> DataFrame:
    """All features in one table. The bids are read and dealt by (id, start time) once; the second level adds up curves."""
    c, rows = by_curve(bids), F.sum("knots")
    hour = F.hour(STARTTIME)
    return c.groupBy(SEQ).agg(
        F.avg("knots").alias("mean_knots"),
        F.median("knots").alias("median_knots"),
        (100 * F.count_if(F.col("knots") == 1) / F.count("*")).alias("pct_single"),
        F.bool_or("any_null").alias("has_null"),
        F.bool_or("any_negative").alias("has_negative"),
        (100 * F.sum("self_rows") / rows).alias("pct_self_sched"),
        *[(100 * F.coalesce(F.sum(F.when(hour == h, F.col("knots"))), F.lit(0)) / rows).alias(n) for h, n in enumerate(HOURS)],
        F.to_date(F.min(STARTTIME)).alias("start"),
        F.to_date(F.max(STARTTIME)).alias("end"),
        F.greatest(F.max("bid_mw"), F.max("self_mw")).alias("max_mw"),
    )


def knot_features(wide: DataFrame) -> DataFrame:
    return wide.select(SEQ, *KNOTS)


def resource_features(wide: DataFrame) -> DataFrame:
    return wide.select(SEQ, *FLAGS, "start", "end", "max_mw")


def hour_features(wide: DataFrame) -> DataFrame:
    return wide.select(SEQ, *HOURS)


def features_long(wide: DataFrame, places: int = 6) -> DataFrame:
    """(id, Feature, Value): every feature as text, for lookups by name."""
    cells = [c for c in COLUMNS if c != SEQ]
    kinds = dict(wide.dtypes)
    text = [F.struct(F.lit(c).alias("Feature"), (F.round(F.col(c), places) if kinds[c] == "double" else F.col(c)).cast("string").alias("Value")) for c in cells]
    return wide.select(SEQ, F.explode(F.array(*text)).alias("f")).select(SEQ, "f.Feature", "f.Value")


def feature_of(long: DataFrame, seq: int, name: str) -> DataFrame:
    return long.where((F.col(SEQ) == seq) & (F.col("Feature") == name)).select("Value")


def id_activity(wide: DataFrame) -> DataFrame:
    return wide.select(SEQ, "start", "end")


def id_attributes(bids: DataFrame) -> DataFrame:
    """The largest offer of each id."""
    return bids.groupBy(SEQ).agg(F.max(finite(F.col(MW))).alias("max_mw"))
