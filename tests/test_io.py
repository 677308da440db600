"""Sources, sinks, ingestion, sampling and streaming."""

import datetime as dt
import io
import zipfile

import pytest

from gridlens.operators.features import id_attributes
from gridlens.plans import curtailment, sample
from gridlens.sources import adapters, files, ingest
from gridlens.sources import schemas as S
from gridlens.streaming import daily
from tests.conftest import DATA
from tests.test_matching import at, bids


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return out.getvalue()


NO_DATA = f"<?xml version='1.0'?>\n<m>{ingest.NO_DATA}</m>"


def test_ingestion(spark, tmp_path):
    days = {
        1: archive(x_PUB_BID_DAM_a__csv="A,B\n1,2\n3,4\n", x_PUB_BID_DAM_b__csv="B,C\n5,6\n"),
        2: archive(answer__xml=NO_DATA),
        3: archive(PUB_BID_DAM__csv=""),
        4: b"not a zip",
        5: archive(other__csv="A\n1\n"),
    }

    def fetch(day, market):
        if day.day == 6:
            raise OSError("down")
        return days[day.day]

    out = str(tmp_path / "dam")
    status = ingest.fetch_days(spark, "2024-01-01", dt.date(2024, 1, 6), "DAM", fetch, out, work_dir=str(tmp_path)).collect()
    assert [r.status for r in status] == ["written", "no_data", "no_data", "error", "error", "error"]
    assert [r.n_rows for r in status] == [3, 0, 0, None, None, None]
    assert "no zip archive" in status[3].message and "no member named like PUB_BID_DAM" in status[4].message and status[5].message == "down"
    got = spark.read.parquet(f"{out}/20240101.parquet")
    assert sorted(got.columns) == ["A", "B", "C"] and got.where("C IS NULL").count() == 2
    again = ingest.fetch_days(spark, "2024-01-01", "2024-01-02", "DAM", fetch, out, work_dir=str(tmp_path)).collect()
    assert [r.status for r in again] == ["no_data"]
    for bad in (("2024-01-02", "2024-01-01", "DAM"), ("x", "2024-01-01", "DAM"), ("2024-01-01", "2024-01-01", "XYZ")):
        with pytest.raises(ValueError):
            ingest.fetch_days(spark, *bad, fetch, out)
    assert ingest.start_parameter(dt.date(2024, 7, 1)) == "20240701T07:00-0000" and ingest.start_parameter(dt.date(2024, 1, 1)) == "20240101T08:00-0000"


def test_retries(monkeypatch):
    waits, calls = [], []

    def fail(request):
        calls.append(request.full_url)
        raise OSError("no")

    monkeypatch.setattr("urllib.request.urlopen", fail)
    f = ingest.http_fetcher("http://localhost/x", retry_times=3, sleep=waits.append)
    with pytest.raises(OSError):
        f(dt.date(2024, 1, 1), "RTM")
    assert len(calls) == 3 and "groupid=PUB_RTM_GRP" in calls[0] and waits[0] == 5 and len(waits) == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "a, b", 1, None, None, None, None), ("B", 'q"x', 2, 5, 3, 0.5, 1.5)], S.EVENT_COUNTS)
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), S.EVENT_COUNTS)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_curves_file_prunes_by_id(spark, tmp_path):
    from gridlens.operators.curves import interpolate

    c = interpolate(adapters.dam(spark, DATA))
    files.write_curves(c, str(tmp_path / "curves"), 4)
    one = files.read_curve(spark, str(tmp_path / "curves"), 3)
    assert one.count() == c.where(f"{S.SEQ} = 3").count()
    assert "PushedFilters: [IsNotNull" in one._jdf.queryExecution().executedPlan().toString()


def test_curves_file_deals_points_only(spark, tmp_path):
    """Written from points, the file holds the whole grid, in the order of ids and grid points."""
    from gridlens.operators.curves import interpolate, knots, on_grid

    dam = adapters.dam(spark, DATA)
    files.write_curves(knots(dam), str(tmp_path / "curves"), 4, lambda points: on_grid(points, outside=True))
    got, want = spark.read.parquet(str(tmp_path / "curves")), interpolate(dam, outside=True)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    for f in sorted((tmp_path / "curves").glob("*.parquet")):
        keys = [tuple(r) for r in spark.read.parquet(str(f)).coalesce(1).select("RESOURCEBID_SEQ", "date", "hour", "pct_grid").collect()]
        assert keys == sorted(keys)


def test_normalize(spark):
    raw = spark.createDataFrame([("1", "2024-01-01 05:00:00", "7.5", None, "x"), ("z", "bad", "", "1", "x")], f"{S.SEQ} string, {S.STARTTIME} string, {S.MW} string, {S.SELF} string, other string")
    a, b = S.normalize_dam(raw).collect()
    assert (a[S.SEQ], a[S.STARTTIME], a[S.MW], a[S.SELF]) == (1, dt.datetime(2024, 1, 1, 5), 7.5, None)
    assert (b[S.SEQ], b[S.STARTTIME], b[S.MW], b[S.SELF]) == (None, None, None, 1.0)
    with pytest.raises(ValueError, match="missing"):
        S.normalize_outages(raw)
    day = spark.createDataFrame([(1, dt.date(2024, 1, 2), 1.0, 1.0)], f"{S.SEQ} long, {S.STARTTIME} date, {S.MW} double, {S.SELF} double")
    assert S.normalize_dam(day).first()[S.STARTTIME] == dt.datetime(2024, 1, 2)


def test_sample(spark):
    dam = adapters.dam(spark, DATA)
    ids = id_attributes(dam)
    r = curtailment.match(dam, adapters.outages(spark, DATA), ids)
    s = sample.build_sample(r.final_matches, r.match_detail, dam, adapters.rtm(spark, DATA), adapters.outages(spark, DATA), ids, resources=3)
    assert s.final_matches.count() == 3 and s.id_attrs.count() == 3
    assert dict(s.outages.dtypes)[S.OUT_START] == "string"
    n = s.rtm_outage_lookup.groupBy("generator").count().toPandas()["count"]
    assert (n <= 2).all()
    assert s.curtailment_dam_data.count() > 0 and s.dam_plot_data.count() > 0


def test_stream_of_days(spark, tmp_path):
    src, out = tmp_path / "days", str(tmp_path / "out")
    for d in range(3):
        bids(spark, [(1, 24 * d + h, float(h), None, 1.0) for h in range(3)]).write.parquet(f"{src}/2024010{d + 1}.parquet")
    schema = bids(spark, []).schema
    q = daily.write_days(daily.daily_max_stream(daily.bid_stream(spark, str(src), schema, 1), "1 hour"), out, str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r.date, r.daily_max_mw) for r in spark.read.parquet(out).collect())
    assert got == [(dt.date(2024, 1, 1), 2.0), (dt.date(2024, 1, 2), 2.0)]
    assert at(0) == dt.datetime(2024, 1, 1)
