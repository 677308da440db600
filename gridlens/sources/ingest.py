"""Daily ingestion of published bids: download, unpack, read, one parquet file a day.

The download is a function that is passed in, so that nothing here depends on a network; http_fetcher
makes one with retries for a given address. Days are independent: each yields a status row, and a
failed one doesn't stop the others.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import random
import time
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.sources.files import place, put, read_csvs, temporary
from gridlens.sources.schemas import STATUS

Fetcher = Callable[[dt.date, str], bytes]
MARKETS = ("DAM", "RTM")
NO_DATA = "No data returned for the specified selection"


def start_parameter(day: dt.date) -> str:
    """Midnight of the market's zone, in UTC, as requests want it."""
    local = dt.datetime.combine(day, dt.time(), ZoneInfo("America/Los_Angeles"))
    return local.astimezone(ZoneInfo("UTC")).strftime("%Y%m%dT%H:%M-0000")


def http_fetcher(base_url: str, request_pause: float = 5, retry_times: int = 15, retry_pause_base: float = 3, retry_pause_cap: float = 20, sleep: Callable[[float], None] = time.sleep) -> Fetcher:
    """A fetcher of zip archives from base_url; waits before each request, and longer after each failure."""

    def fetch(day: dt.date, market: str) -> bytes:
        sleep(request_pause)
        query = urllib.parse.urlencode({"resultformat": 6, "version": 3, "groupid": f"PUB_{market}_GRP", "startdatetime": start_parameter(day)})
        request = urllib.request.Request(f"{base_url}?{query}", headers={"User-Agent": "Mozilla/5.0"})
        for attempt in range(1, retry_times + 1):
            try:
                with urllib.request.urlopen(request) as answer:
                    return answer.read()
            except OSError:
                if attempt == retry_times:
                    raise
                sleep(random.uniform(1, max(1.0, min(retry_pause_cap, retry_pause_base * 2**attempt))))
        raise AssertionError

    return fetch


def is_no_data(content: bytes) -> bool:
    """An empty file, or an XML answer that says so in its first 30 lines."""
    lines = content.decode("utf-8", "replace").splitlines()[:30]
    return not lines or (lines[0].startswith("<?xml") and any(NO_DATA in x for x in lines))


def unpack(archive: bytes, market: str, day: dt.date) -> list[tuple[str, bytes]]:
    """(name, content) of the bid files with data; none if the archive says that there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            files = [(os.path.basename(n), z.read(n)) for n in z.namelist()]
    except zipfile.BadZipFile as e:
        raise ValueError(f"{market} {day}: the answer is no zip archive ({e})") from e
    prefix = f"PUB_BID_{market}"
    bids = [f for f in files if prefix in f[0]]
    if not bids:
        if any(is_no_data(c) for _, c in files):
            return []
        raise ValueError(f"{market} {day}: the archive has no member named like {prefix}")
    return [f for f in bids if not is_no_data(f[1])]


def read_day(spark: SparkSession, day: dt.date, market: str, fetcher: Fetcher, work_dir: str) -> DataFrame | None:
    """The day's bids, files put together by column name; None if there are none.

    work_dir must be visible to the executors: the CSV files are read from there.
    """
    files = unpack(fetcher(day, market), market, day)
    paths = []
    for name, content in files:
        paths.append(f"{work_dir}/{day:%Y%m%d}_{name}")
        put(spark, paths[-1], content)
    return read_csvs(spark, paths) if paths else None


def fetch_days(spark: SparkSession, start: dt.date | str, end: dt.date | str, market: str, fetcher: Fetcher, output_dir: str | None = None, skip_existing: bool = True, work_dir: str | None = None) -> DataFrame:
    """Write each day from start to end to output_dir/YYYYMMDD.parquet; one status row for each day that was asked for.

    status: written, no_data or error. Days whose file exists are passed over, and yield no row.
    """
    if market not in MARKETS:
        raise ValueError(f"market must be one of {', '.join(MARKETS)}")
    try:
        first, last = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (start, end))
    except (TypeError, ValueError) as e:
        raise ValueError("start and end must be dates") from e
    if last < first:
        raise ValueError("end must not be before start")
    output_dir = output_dir or f"{market.lower()}_daily"
    rows: list[tuple] = []
    work = f"{work_dir}/unpacked" if work_dir else temporary(spark, "unpacked")
    for k in range((last - first).days + 1):
        day = first + dt.timedelta(days=k)
        path = f"{output_dir}/{day:%Y%m%d}.parquet"
        fs, p = place(spark, path)
        if skip_existing and fs.exists(p):
            continue
        try:
            bids = read_day(spark, day, market, fetcher, f"{work}/{day:%Y%m%d}")
            n = bids.count() if bids is not None else 0
            if not n:
                rows.append((day, market, "no_data", None, 0, "the day has no bids"))
                continue
            bids.write.mode("overwrite").parquet(path)
            rows.append((day, market, "written", path, n, None))
        except Exception as e:  # the status row is the report
            rows.append((day, market, "error", None, None, str(e)))
        finally:
            fs.delete(place(spark, f"{work}/{day:%Y%m%d}")[1], True)
    return spark.createDataFrame(rows, STATUS).orderBy(F.col("date"))
