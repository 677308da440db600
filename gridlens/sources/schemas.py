"""The tables of the data model, and how loosely typed input becomes them.

Every normalize_* takes any DataFrame with the named columns, checks that the required ones are
there, and casts with try_cast: what can't be read becomes null. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed column names of the market's tables.
SEQ, STARTTIME, MW, PRICE, SELF = "RESOURCEBID_SEQ", "STARTTIME", "SCH_BID_XAXISDATA", "SCH_BID_Y1AXISDATA", "SELFSCHEDMW"
PRODUCT, RESOURCE_TYPE = "MARKETPRODUCTTYPE", "RESOURCE_TYPE"
BID_START, BID_STOP, RUN_START, RUN_STOP = "SCH_BID_TIMEINTERVALSTART", "SCH_BID_TIMEINTERVALSTOP", "TIMEINTERVALSTART", "TIMEINTERVALEND"
KIND, RES, NAME, PMAX, CURT = "OUTAGE TYPE", "RESOURCE ID", "RESOURCE NAME", "RESOURCE PMAX MW", "CURTAILMENT MW"
OUT_START, OUT_STOP = "CURTAILMENT START DATE TIME", "CURTAILMENT END DATE TIME"

DAM = {SEQ: "bigint", STARTTIME: "timestamp_ntz", MW: "double", PRICE: "double", SELF: "double", PRODUCT: "string", RESOURCE_TYPE: "string"}
RTM = {SEQ: "bigint", PRODUCT: "string", MW: "double", BID_START: "timestamp_ntz", BID_STOP: "timestamp_ntz", RUN_START: "timestamp_ntz", RUN_STOP: "timestamp_ntz"}
OUTAGES = {KIND: "string", RES: "string", NAME: "string", PMAX: "double", CURT: "double", OUT_START: "timestamp_ntz", OUT_STOP: "timestamp_ntz"}
ID_ATTRS = {SEQ: "bigint", "max_mw": "double"}
STATUS = "date date, market string, status string, path string, n_rows int, message string"
FINALS = f"`{RES}` string, `{NAME}` string, `{PMAX}` double, {SEQ} bigint, seq_max_mw double, n_matches bigint, mean_pct_err double, score double, confidence double"
EVENT_COUNTS = f"`{RES}` string, `{NAME}` string, total_curtailment_events bigint, {SEQ} bigint, n_matches bigint, confidence double, score double"


def _as(df: DataFrame, name: str, kind: str) -> Column:
    have = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if have == kind:
        return c
    if kind == "timestamp_ntz":
        # text or a date; an offset in the text would be dropped, so times with one must be converted before
        return c.cast(kind) if have in ("date", "timestamp") else c.cast("string").try_cast(kind)
    return c.try_cast(kind)


def normalized(df: DataFrame, schema: dict[str, str], required: list[str] | None = None) -> DataFrame:
    """df with the schema's columns that it has, cast; raises if a required one (default: all) is missing."""
    missing = [c for c in (schema if required is None else required) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[_as(df, c, k).alias(c) for c, k in schema.items() if c in df.columns])


def normalize_dam(df: DataFrame) -> DataFrame:
    return normalized(df, DAM, [SEQ, STARTTIME, MW, SELF])


def normalize_rtm(df: DataFrame) -> DataFrame:
    return normalized(df, RTM)


def normalize_rtm_curves(df: DataFrame) -> DataFrame:
    """Real-time bids as curves need them: the same columns as day-ahead ones."""
    return normalized(df, DAM, [SEQ, STARTTIME, MW, PRICE, SELF])


def normalize_outages(df: DataFrame) -> DataFrame:
    return normalized(df, OUTAGES)


def normalize_id_attrs(df: DataFrame) -> DataFrame:
    return normalized(df, ID_ATTRS)
