"""The registered queries of the market engine: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators import curves, features, intervals, similarity
from gridlens.plans import curtailment, outage, reports, sample
from gridlens.sources import adapters, files, ingest
from gridlens.sources import schemas as S
from gridlens.sources.schemas import SEQ


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that another engine's order of summation doesn't show; the limit lies a little off the halves, where values do stand."""
    return df.select(*[(F.floor(F.col(f"`{c}`") * 1e6 + 0.5003) / 1e6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return features.id_attributes(adapters.dam(spark, sf))


def _curtailment(spark: SparkSession, sf: str, stage: bool = False) -> curtailment.CurtailmentResult:
    return curtailment.match(adapters.dam(spark, sf), adapters.outages(spark, sf), _ids(spark, sf), stage=stage)


def _outage(spark: SparkSession, sf: str, stage: bool = False) -> outage.OutageResult:
    return outage.match(adapters.rtm(spark, sf), adapters.full_outages(spark, sf), stage=stage)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return features.features(adapters.dam(spark, sf))


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    """The features, stored: lookups read them several times, and none reads the bids again."""
    return files.staged(_wide(spark, sf))


def _target(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    wide = _profiled(spark, sf)
    return wide, wide.agg(F.min(SEQ)).first()[0]


def _average(spark: SparkSession, sf: str, **days: str) -> DataFrame:
    dam = adapters.dam(spark, sf)
    return curves.average_curve(curves.interpolate(dam), features.id_attributes(dam), **days)


def pmax_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return curtailment.pmax_lookup(curtailment.planned_partial(adapters.outages(spark, sf)), _ids(spark, sf))


def curtailment_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = _curtailment(spark, sf, stage=True)
    return reports.curtailment_event_counts(r.planned_partial, r.final_matches)


def outage_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = _outage(spark, sf, stage=True)
    return reports.outage_event_counts(r.outages, r.final_matches)


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = _curtailment(spark, sf, stage=True)
    return r.final_matches, r.top_candidates, reports.curtailment_event_counts(r.planned_partial, r.final_matches)


def _outage_candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = _outage(spark, sf, stage=True)
    return r.final_matches, r.top_candidates, reports.outage_event_counts(r.outages, r.final_matches)


def similar_ids(start_filter: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        wide, seq = _target(spark, sf)
        return similarity.find_similar(wide, seq, 10, start_filter)

    return run


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = _curtailment(spark, sf, stage=True)
    return reports.run_summary(r.final_matches, r.top_candidates, S.RES)


def outage_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = _outage(spark, sf, stage=True)
    return reports.run_summary(r.final_matches, r.top_candidates, "generator")


def match_cards(spark: SparkSession, sf: str) -> DataFrame:
    return reports.match_cards(reports.candidates_by_id(*_candidates(spark, sf)), S.RES)


def feature_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One feature of one id, as the lookup table has it."""
    wide, seq = _target(spark, sf)
    return features.feature_of(features.features_long(wide), seq, "has_null")


def counts_as_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The event counts, written as CSV with NA for null and read again."""
    path = files.temporary(spark, "csv")
    files.write_csv(rounded(curtailment_event_counts(spark, sf)), path)
    return files.read_csv(spark, path, S.EVENT_COUNTS)


def curve_of_id(spark: SparkSession, sf: str) -> DataFrame:
    """All curves, written by id, and one id's read again."""
    path = files.temporary(spark, "curves")
    dam = adapters.dam(spark, sf)
    files.write_curves(curves.knots(dam), path, expand=lambda points: curves.on_grid(points, outside=True))
    return files.read_curve(spark, path, dam.agg(F.min(SEQ)).first()[0])


def _ingested(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """(status, folder): the regions as days whose answers hold their nations, two files a day of different columns, and two days without."""
    by: dict[int, list] = {}
    for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect():  # a fixed table
        by.setdefault(r.n_regionkey, []).append(r)

    def fetch(day: dt.date, market: str) -> bytes:
        rows = sorted(by.get(day.day - 1, []))
        if not rows:
            return b"no archive" if day.day % 2 else _zipped({"answer.xml": f"<?xml version='1.0'?>\n<m>{ingest.NO_DATA}</m>"})
        one = [f"{r.n_nationkey},{r.n_name}" for r in rows if r.n_nationkey % 2]
        two = [f"{r.n_nationkey},{r.n_nationkey / 4}" for r in rows if not r.n_nationkey % 2]
        return _zipped({f"a/PUB_BID_{market}_1.csv": "\n".join([f"{SEQ},NAME", *one]), f"PUB_BID_{market}_2.csv": "\n".join([f"{SEQ},{S.MW}", *two])})

    out = files.temporary(spark, "days")
    return ingest.fetch_days(spark, "2024-03-01", f"2024-03-{len(by) + 2:02d}", "DAM", fetch, out), out


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def ingest_status(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf)[0].select("date", "market", "status", "n_rows", F.col("message").isNotNull().alias("has_message"))


def ingested_bids(spark: SparkSession, sf: str) -> DataFrame:
    status, out = _ingested(spark, sf)
    return files.read_bids(spark, f"{out}/*.parquet").select(SEQ, "NAME", S.MW)


def request_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The start parameter of each day of the events: local midnight, in UTC."""
    days = spark.read.parquet(f"{sf}/events.parquet").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    days = days.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("date"))
    utc = F.to_utc_timestamp(F.col("date").cast("timestamp"), "America/Los_Angeles")
    return days.select("date", F.concat(F.date_format(utc, "yyyyMMdd'T'HH:mm"), F.lit("-0000")).alias("startdatetime"))


def _sample(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = _curtailment(spark, sf, stage=True)
        return getattr(sample.build_sample(r.final_matches, r.match_detail, adapters.dam(spark, sf), adapters.rtm(spark, sf), adapters.outages(spark, sf), _ids(spark, sf)), name)

    return run


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "planned_partial": lambda s, d: curtailment.planned_partial(adapters.outages(s, d)),
    "pmax_lookup": pmax_lookup,
    "daily_max_mw": lambda s, d: curtailment.daily_max_mw(adapters.dam(s, d)),
    "raw_curtailment_matches": lambda s, d: _curtailment(s, d).raw_matches,
    "curtailment_scores": lambda s, d: _curtailment(s, d).scores,
    "curtailment_top_candidates": lambda s, d: _curtailment(s, d).top_candidates,
    "curtailment_final": lambda s, d: _curtailment(s, d).final_matches,
    "curtailment_match_detail": lambda s, d: _curtailment(s, d).match_detail,
    "curtailment_event_counts": curtailment_event_counts,
    "confidence_histogram": lambda s, d: reports.confidence_histogram(_curtailment(s, d, stage=True).final_matches),
    "generator_outages": lambda s, d: intervals.merge_outages(adapters.full_outages(s, d)),
    "outages_of_generators": lambda s, d: intervals.merge_outages(adapters.full_outages(s, d), ["GEN_1", "GEN_7", "GEN_x"]),
    "bid_gaps": lambda s, d: intervals.bid_gaps(adapters.rtm(s, d)).drop("next_bid_start_cmp"),
    "seq_max_mw": lambda s, d: outage.seq_max_mw(adapters.rtm(s, d)),
    "outage_raw_matches": lambda s, d: _outage(s, d).raw_matches,
    "outage_scores": lambda s, d: _outage(s, d).scores,
    "outage_top_candidates": lambda s, d: _outage(s, d).top_candidates,
    "outage_final": lambda s, d: _outage(s, d).final_matches,
    "outage_match_detail": lambda s, d: _outage(s, d).match_detail,
    "outage_event_counts": outage_event_counts,
    "outage_confidence_histogram": lambda s, d: reports.confidence_histogram(_outage(s, d, stage=True).final_matches),
    "features_knots": lambda s, d: features.knot_features(_wide(s, d)),
    "features_resource": lambda s, d: features.resource_features(_wide(s, d)),
    "features_hours": lambda s, d: features.hour_features(_wide(s, d)),
    "features_wide": _wide,
    "features_long": lambda s, d: _long(s, d),
    "feature_zscores": lambda s, d: similarity.z_scores(_profiled(s, d)),
    "cosine_pairs": lambda s, d: similarity.cosine_pairs(files.staged(similarity.profiles(_profiled(s, d)))),
    "similar_ids_none": similar_ids("none"),
    "similar_ids_after": similar_ids("after"),
    "similar_ids_before": similar_ids("before"),
    "similar_by_period": lambda s, d: similarity.similar_by_period(*_target(s, d)),
    "interp_curve": lambda s, d: curves.interpolate(adapters.dam(s, d)),
    "interp_grid": lambda s, d: curves.interpolate(adapters.dam(s, d), outside=True),
    "interp_curve_rtm": lambda s, d: curves.interpolate(adapters.rtm_curves(s, d)),
    "average_curve": _average,
    "average_curve_days": lambda s, d: _average(s, d, first="1994-01-01", last="1994-06-30"),
    "outlier_bids": lambda s, d: curves.outlier_bids(adapters.dam(s, d), _average(s, d), 1.0),
    "curve_bands": lambda s, d: curves.bands(_average(s, d), 1.0),
    "curve_segments": lambda s, d: curves.curve_segments(adapters.dam(s, d)),
    "id_candidates": lambda s, d: reports.candidates_by_id(*_candidates(s, d)),
    "name_candidates": lambda s, d: reports.candidates_by_name(*_candidates(s, d)),
    "outage_id_candidates": lambda s, d: reports.candidates_by_id(*_outage_candidates(s, d), res="generator", count="total_outage_events"),
    "outage_name_candidates": lambda s, d: reports.candidates_by_name(*_outage_candidates(s, d), res="generator", named="generator", count="total_outage_events"),
    "valid_ids": lambda s, d: reports.valid_ids(*_candidates(s, d)[:2]),
    "id_activity": lambda s, d: features.id_activity(_wide(s, d)),
    "id_attributes": _ids,
    "run_summary": run_summary,
    "outage_run_summary": outage_run_summary,
    "match_cards": match_cards,
    "feature_lookup": feature_lookup,
    "counts_as_csv": counts_as_csv,
    "curve_of_id": curve_of_id,
    "ingest_status": ingest_status,
    "ingested_bids": ingested_bids,
    "request_parameters": request_parameters,
    "sample_final": _sample("final_matches"),
    "sample_detail": _sample("match_detail"),
    "sample_ids": _sample("id_attrs"),
    "sample_outages": _sample("outages"),
    "sample_dam": _sample("curtailment_dam_data"),
    "sample_plot": _sample("dam_plot_data"),
    "sample_lookup": _sample("rtm_outage_lookup"),
    "sample_rtm": _sample("rtm_data"),
}


def _long(spark: SparkSession, sf: str) -> DataFrame:
    """Values as numbers here: text of doubles differs between engines."""
    long = features.features_long(_wide(spark, sf))
    number = F.when(F.col("Value").isin("true", "false"), (F.col("Value") == "true").cast("double")).otherwise(F.coalesce(F.col("Value").try_cast("double"), F.datediff(F.col("Value").try_cast("date"), F.lit("1970-01-01").cast("date")).cast("double")))
    return long.select(SEQ, "Feature", number.alias("Value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda s, d, f=f: rounded(f(s, d))) for k, f in _Q.items()}
