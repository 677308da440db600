"""From matches to scores, ranks, confidence and one owner an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.exprs import confidence, finite, rel_err
from gridlens.sources.schemas import NAME, RES, SEQ

#: Sort keys are rounded to this many places, so that the order in which a mean was added up can't decide a rank.
PLACES = 9


def key(name: str) -> Column:
    return F.round(F.col(name), PLACES)


def score_curtailments(matches: DataFrame) -> DataFrame:
    err = rel_err(F.col("daily_max_mw"), F.col("expected_available_mw"))
    s = matches.groupBy(RES, NAME, SEQ).agg(F.count("*").alias("n_matches"), F.avg(err).alias("mean_pct_err"))
    return s.withColumn("score", F.col("n_matches") * (1 - F.col("mean_pct_err")))


def score_outages(matches: DataFrame) -> DataFrame:
    """Scores may be negative: nothing bounds how far an id's size is from the generator's."""
    m = matches.withColumn("max_mw", finite(F.col("max_mw"))).where("pmax_mw > 0 AND max_mw IS NOT NULL")
    s = m.groupBy("generator", SEQ).agg(
        F.count("*").alias("n_matches"), F.max("pmax_mw").alias("pmax_mw"), F.max("max_mw").alias("max_mw"), F.avg(rel_err(F.col("max_mw"), F.col("pmax_mw"))).alias("mean_pct_err"),
        F.avg("stop_offset").alias("mean_stop_offset"), F.avg("restart_offset").alias("mean_restart_offset"),
        F.avg(F.abs("stop_offset")).alias("mean_abs_stop_offset"), F.avg(F.abs("restart_offset")).alias("mean_abs_restart_offset"),
    )
    return s.withColumn("score", F.col("n_matches") * (1 - F.col("mean_pct_err")))


def ranked(scores: DataFrame, owner: str, ties: list[Column], top: int) -> DataFrame:
    """scores with rank <= top and, for rank 1, confidence; others have none.

    Ranks below the needed ones are cut before the shuffle; the runner-up is then the next row of the same sort.
    """
    order = [key("score").desc(), key("mean_pct_err").asc(), *ties]
    w = Window.partitionBy(F.col(f"`{owner}`")).orderBy(*order)
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(top, 2))
    up = F.lead("score").over(Window.partitionBy(F.col(f"`{owner}`")).orderBy("rank"))
    best = best.withColumn("confidence", F.when(F.col("rank") == 1, confidence(F.col("score"), up)))
    return best.where(F.col("rank") <= top)


def resolve(winners: DataFrame, ties: list[Column]) -> DataFrame:
    """One winner an id: the most confident. Who loses an id is out, and gets no second choice."""
    w = Window.partitionBy(SEQ).orderBy(key("confidence").desc(), key("score").desc(), F.desc("n_matches"), key("mean_pct_err").asc(), *ties)
    return winners.withColumn("_claim", F.row_number().over(w)).where("_claim = 1").drop("_claim")
