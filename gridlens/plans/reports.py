"""Event counts, the distribution of confidence, and candidate lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.sources.schemas import NAME, RES, SEQ


def curtailment_event_counts(planned: DataFrame, final: DataFrame) -> DataFrame:
    """All planned partial events of each resource beside its match."""
    n = planned.groupBy(RES, NAME).agg(F.count("*").alias("total_curtailment_events"))
    return n.join(final.select(RES, SEQ, "n_matches", "confidence", "score"), RES, "left").select(RES, NAME, "total_curtailment_events", SEQ, "n_matches", "confidence", "score")


def outage_event_counts(outages: DataFrame, final: DataFrame) -> DataFrame:
    n = outages.groupBy("generator").agg(F.count("*").alias("total_outage_events"))
    cols = [SEQ, "n_matches", "pmax_mw", "max_mw", "confidence", "score"]
    return n.join(final.select("generator", *cols), "generator", "left").select("generator", "total_outage_events", *cols)


def confidence_histogram(final: DataFrame, bins: int = 40) -> DataFrame:
    """bin, n, n_unambiguous: counts over equal bins of log10(1 / (1 - confidence)) for confidences under 1; how many are 1 stands beside each."""
    x = F.round(F.log10(1 / (1 - F.col("confidence"))), 9)
    open_ = F.col("confidence") < 1
    lo, hi, sure = final.agg(F.min(F.when(open_, x)), F.max(F.when(open_, x)), F.count_if(F.col("confidence") == 1)).first()
    open_ = final.where(open_).select(x.alias("x"))
    if lo is None:
        return open_.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(sure).cast("long").alias("n_unambiguous")).limit(0)
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("long") if width else F.lit(0).cast("long")
    return open_.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("n_unambiguous", F.lit(sure).cast("long"))


def _rest(best: DataFrame, every: DataFrame, by: str, what: str, room) -> DataFrame:
    """Candidates of each `by` that aren't its best match, in order of (has confidence, score), as many as there is room for."""
    known = best.select(F.col(f"`{by}`").alias("_by"), F.col(f"`{what}`").alias("_what"))
    left = every.join(known, (F.col(f"`{by}`") == F.col("_by")) & (F.col(f"`{what}`") == F.col("_what")), "left_anti")
    n = best.groupBy(F.col(f"`{by}`").alias("_by")).agg(F.count("*").alias("_best"))
    sure = F.col("confidence") if "confidence" in every.columns else F.lit(None)  # outages' candidates have none
    w = Window.partitionBy(F.col(f"`{by}`")).orderBy(sure.isNotNull().desc(), F.round("score", 9).desc(), F.col(f"`{what}`"))
    ranked = left.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= 5)
    return ranked.join(n, F.col(f"`{by}`") == F.col("_by"), "left").where(F.col("_place") <= room(F.coalesce("_best", F.lit(0)))).drop("_place", "_by", "_best")


def candidates_by_id(best: DataFrame, every: DataFrame, events: DataFrame, seq: int | None = None, res: str = RES, count: str = "total_curtailment_events") -> DataFrame:
    """For one bid id or all: its final match and up to 4 other candidates, with the event count of the resource (column res)."""
    if seq is not None:
        best, every = best.where(F.col(SEQ) == seq), every.where(F.col(SEQ) == seq)
    rows = best.withColumn("match_source", F.lit("final")).unionByName(_rest(best, every, SEQ, res, lambda n: F.lit(4)).withColumn("match_source", F.lit("candidate")), allowMissingColumns=True)
    return rows.join(events.select(res, count).distinct(), res, "left")


def candidates_by_name(best: DataFrame, every: DataFrame, events: DataFrame, name: str | None = None, res: str = RES, named: str = NAME, count: str = "total_curtailment_events") -> DataFrame:
    """For one resource name (column named) or all: its final match and others up to 5 in all."""
    if name is not None:
        best, every = best.where(F.col(f"`{named}`") == name.strip()), every.where(F.col(f"`{named}`") == name.strip())
    rows = best.withColumn("match_source", F.lit("final")).unionByName(_rest(best, every, named, SEQ, lambda n: F.greatest(F.lit(0), 5 - n)).withColumn("match_source", F.lit("candidate")), allowMissingColumns=True)
    return rows.join(events.select(res, count).distinct(), res, "left")


def run_summary(final: DataFrame, top: DataFrame, owner: str) -> DataFrame:
    """One row: final matches, candidate rows, and owners (column) that have a candidate."""
    f = final.agg(F.lit(1).alias("one"), F.count("*").alias("final_matches"), F.countDistinct(SEQ).alias("final_ids"))
    t = top.agg(F.lit(1).alias("one"), F.count("*").alias("candidate_rows"), F.countDistinct(F.col(f"`{owner}`")).alias("owners"))
    return f.join(t, "one").drop("one")


def match_cards(candidates: DataFrame, owner: str, label: str = NAME) -> DataFrame:
    """(id, owner, place, title, body): a lookup's rows as text, best first; what is unknown or blank is left out."""
    known = lambda c: F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "")
    # to 3 places; the limit lies a little off the halves, so that the order of a sum doesn't show
    number = lambda c: F.format_string("%.3f", F.floor(F.col(c) * 1000 + 0.5003) / 1000)
    w = Window.partitionBy(SEQ).orderBy((F.col("match_source") == "final").desc(), F.round("score", 9).desc(), F.col(f"`{owner}`"))
    title = F.when(known(label), F.trim(F.col(f"`{label}`").cast("string"))).otherwise("unknown")
    lines = [F.when(known("n_matches"), F.concat(F.lit("matched events: "), F.col("n_matches").cast("string"))), F.when(known("confidence"), F.concat(F.lit("confidence: "), number("confidence"))), F.when(known("score"), F.concat(F.lit("score: "), number("score")))]
    return candidates.select(SEQ, F.col(f"`{owner}`").alias("owner"), F.row_number().over(w).alias("place"), title.alias("title"), F.concat_ws("; ", *lines).alias("body"))


def valid_ids(best: DataFrame, every: DataFrame) -> DataFrame:
    """The ids one can ask candidates for."""
    return best.select(SEQ).union(every.select(SEQ)).distinct()


def valid_names(best: DataFrame, every: DataFrame) -> DataFrame:
    return best.select(NAME).union(every.select(NAME)).distinct()
