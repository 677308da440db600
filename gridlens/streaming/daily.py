"""Structured Streaming over the directory that ingestion writes: new days flow into daily maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridlens.functions.exprs import finite
from gridlens.sources.schemas import MW, SELF, SEQ, STARTTIME


def bid_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Bids from every daily file, present and to come (path/*.parquet)."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def daily_max_stream(bids: DataFrame, late: str = "2 days") -> DataFrame:
    """(id, day start, daily_max_mw), each once a day is older than `late`; the state holds the open days only."""
    t = bids.withColumn("time", F.col(STARTTIME).cast("timestamp")).withWatermark("time", late)
    offer = F.greatest(finite(F.col(MW)), finite(F.col(SELF)))
    out = t.groupBy(F.window("time", "1 day"), SEQ).agg(F.max(offer).alias("daily_max_mw"))
    return out.select(SEQ, F.to_date("window.start").alias("date"), "daily_max_mw").where("daily_max_mw IS NOT NULL")


def write_days(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to parquet, exactly once; once: take what is there and stop."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
