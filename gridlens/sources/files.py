"""Readers and writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.sources.schemas import DAM, RTM, SEQ, normalized


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without and gets one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridlens-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = place(spark, path)
    fs.deleteOnExit(p)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what several steps read is worked out once."""
    path = temporary(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of this content, in any file system that Spark reaches."""
    fs, p = place(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_bids(spark: SparkSession, path: str) -> DataFrame:
    """One parquet file or a directory of daily ones; filters and columns reach the scan."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and NA for null, by a declared schema."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA", enforceSchema=False)


def read_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of different columns, put together by name; what a file lacks is null.

    Known columns have their declared types, others are text, so a column's type doesn't depend on a day's values; each file is read once.
    """
    known = RTM | DAM
    frames = []
    for p in paths:
        raw = spark.read.csv(p, header=True)
        typed = normalized(raw, {c: known.get(c, "string") for c in raw.columns})
        frames.append(typed)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA", quoteAll=False)


def write_curves(df: DataFrame, path: str, parts: int | None = None, expand: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Curves sorted by id within id ranges: a read of one id touches the few row groups whose statistics hold it.

    expand: makes what is written from df, row by row and in its order, so that only df's rows are dealt and sorted.
    """
    order = [c for c in (SEQ, "date", "hour", "pct", "pct_grid") if c in df.columns]
    by = df.repartitionByRange(parts, SEQ) if parts else df.repartitionByRange(SEQ)
    by = by.sortWithinPartitions(*order)
    (expand(by) if expand else by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_curve(spark: SparkSession, path: str, seq: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col(SEQ) == seq)
