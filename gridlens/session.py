"""Session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Clock times carry no zone, adaptive execution splits skewed joins and sizes shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "gridlens", master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()
