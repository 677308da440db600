"""Bid curves: resampling to a percentage grid, averages, outliers, and line segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.exprs import finite
from gridlens.sources.files import staged
from gridlens.sources.schemas import MW, PRICE, SELF, SEQ, STARTTIME


def _points(bids: DataFrame) -> DataFrame:
    """(id, date, hour, mw, price, pct): a self-schedule stands in for the offer; pct of the id's largest mw, halves away from 0.

    An id whose largest mw is 0 has no pct.
    """
    b = bids.where(F.col(SEQ).isNotNull()).select(SEQ, F.col(STARTTIME).cast("timestamp_ntz").alias("date"), F.coalesce(F.col(SELF), F.col(MW)).alias("mw"), F.col(PRICE).alias("price"))
    top = b.groupBy(SEQ).agg(F.max(finite(F.col("mw"))).alias("top_mw"))  # combined before its shuffle: an id's bids need not meet
    pct = F.round(F.try_divide(F.col("mw"), F.col("top_mw")) * 100).cast("int")
    return b.join(top, SEQ).select(SEQ, "date", F.hour("date").alias("hour"), "mw", "price", pct.alias("pct")).where("pct IS NOT NULL AND price IS NOT NULL")


def knots(bids: DataFrame) -> DataFrame:
    """(id, date, hour, pct, price_interp, before, after): each curve's points, one a percentage, and the percentages on both sides; off the grid as well.

    This is what to shuffle or sort: the grid of on_grid is many times as long.
    """
    own = Window.partitionBy(SEQ, "date", "hour").orderBy("pct")
    pts = _points(bids).groupBy(SEQ, "date", "hour", "pct").agg(F.avg("price").alias("price_interp"))
    return pts.withColumn("before", F.lag("pct").over(own)).withColumn("after", F.lead("pct").over(own))


def on_grid(points: DataFrame, outside: bool = False) -> DataFrame:
    """knots() as the rows of interpolate(), row by row and in their order."""
    pct, here = F.col("pct"), F.col("pct").between(0, 100)
    first, last = ~F.coalesce(F.col("before") >= 0, F.lit(False)), ~F.coalesce(F.col("after") <= 100, F.lit(False))

    def run(lo: Column, hi: Column, price: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), price.alias("price"))

    # a row without a date belongs to no curve of the grid
    price = F.when(F.col("date").isNotNull(), F.col("price_interp")) if outside else F.col("price_interp")
    held = F.when(here, run(pct, F.when(last, pct).otherwise(F.col("after") - 1), price))
    if outside:
        none = F.lit(None).cast("double")
        # one point speaks for a curve that has none on the grid: the last below it, else the first above it
        empty = F.when((pct < 0) & last | (pct > 100) & F.col("before").isNull(), run(F.lit(0), F.lit(100), none))
        runs = F.array(F.when(here & first & (pct > 0), run(F.lit(0), pct - 1, none)), held, F.when(here & last & (pct < 100), run(pct + 1, F.lit(100), none)), empty)
    else:
        runs = F.array(held)
    r = points.select(SEQ, "date", "hour", F.explode(F.filter(runs, lambda x: x.isNotNull())).alias("r"))
    steps = r.select(SEQ, "date", "hour", F.explode(F.sequence(F.col("r.lo"), F.col("r.hi"))).alias("pct_grid"), F.col("r.price").alias("price_interp"))
    return steps.withColumn("daily_x", F.col("hour") * 100 + F.col("pct_grid")).select(SEQ, "date", "hour", "pct_grid", "price_interp", "daily_x")


def interpolate(bids: DataFrame, outside: bool = False) -> DataFrame:
    """(id, date, hour, pct_grid, price_interp, daily_x): each curve as a step function on 0..100 %.

    A point's price holds up to the next point; before the first and after the last there is no price.
    outside: also the rows without one, 101 for each curve, even for a curve with points off the grid only.
    """
    return on_grid(knots(bids), outside)


def average_curve(curves: DataFrame, sizes: DataFrame, seq: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Mean and deviation of each id's curves by hour and grid point, over the days from first to last.

    sizes: (id, max_mw), which turns grid points back into megawatts.
    """
    c = curves if seq is None else curves.where(F.col(SEQ) == seq)
    day = F.to_date("date")
    if first:
        c = c.where(day >= F.lit(first).cast("date"))
    if last:
        c = c.where(day <= F.lit(last).cast("date"))
    a = c.groupBy(SEQ, "hour", "pct_grid", "daily_x").agg(F.avg("price_interp").alias("avg_price"), F.stddev_samp("price_interp").alias("sd"), F.count("price_interp").alias("n_days_used")).where("n_days_used <> 0")
    return a.join(sizes, SEQ, "left").withColumn("orig_MW", F.col("pct_grid") / 100 * F.col("max_mw")).drop("max_mw")


def outlier_bids(bids: DataFrame, average: DataFrame, num_sd: float = 2.0) -> DataFrame:
    """Bids over num_sd deviations off the id's average curve at their hour and grid point; without a deviation none is.

    The order of a sum doesn't decide about a bid at the limit itself (three prices at equal distances have two): there the mean and
    the deviation are worked out again in doubles, the curves in order of their date. That takes an average over all days of the bids; with another a bid at the limit is none.
    """
    b = _points(bids).groupBy(SEQ, "date", "hour", F.col("pct").alias("mw_pct_round")).agg(F.avg("price").alias(PRICE), F.avg("mw").alias("bid_mw"))
    a = average.select(SEQ, "hour", F.col("pct_grid").alias("mw_pct_round"), "avg_price", "sd", "n_days_used")
    over = F.abs(F.col(PRICE) - F.col("avg_price")) - num_sd * F.col("sd")
    slack = 1e-9 * (1 + F.abs("avg_price") + F.abs(PRICE))
    place = [SEQ, "hour", "mw_pct_round"]
    near = staged(b.join(a, place).where(over >= -slack).withColumn("at_limit", over <= slack))
    limits = near.where("at_limit")
    own = interpolate(bids.join(limits.select(SEQ).distinct(), SEQ, "left_semi")).withColumnRenamed("pct_grid", "mw_pct_round").join(limits.select(*place).distinct(), place, "left_semi")
    exact = own.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("date", "price_interp"))).alias("days")).select(*place, F.size("days").alias("_n"), *_mean_and_sd(F.col("days.price_interp")))
    p, off = F.col(PRICE), num_sd * F.col("_sd")
    tied = limits.join(exact, place).where((F.col("_n") == F.col("n_days_used")) & ((p > F.col("_mean") + off) | (p < F.col("_mean") - off)))
    columns = [*place, "date", PRICE, "bid_mw", "avg_price", "sd", "n_days_used"]
    return near.where("NOT at_limit").select(*columns).unionByName(tied.select(*columns))


def _mean_and_sd(prices: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of an array, summed from its first element to its last (the deviation by Welford's updates, as engines do)."""
    total = F.aggregate(prices, F.lit(0.0), lambda s, x: s + x)

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - s["mean"]) * (x - mean)).alias("squares"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return (total / F.size(prices)).alias("_mean"), F.aggregate(prices, start, add, lambda s: F.sqrt(F.try_divide(s["squares"], s["n"] - 1))).alias("_sd")


def bands(average: DataFrame, num_sd: float = 2.0) -> DataFrame:
    """Ribbon limits for plots: the lower follows num_sd and stops at 0, the upper is always 2 deviations."""
    return average.withColumn("lower", F.greatest(F.lit(0.0), F.col("avg_price") - num_sd * F.col("sd"))).withColumn("upper", F.col("avg_price") + 2 * F.col("sd"))


def curve_segments(bids: DataFrame, seq: int | None = None) -> DataFrame:
    """(id, start, hour, kind, x, xend, y, yend, single_point): what draws a step curve.

    Points in order of quantity and price; a horizontal piece to where the quantity changes, a vertical
    one there if the price does; and each point, which stands alone if its curve has no other.
    """
    b = bids if seq is None else bids.where(F.col(SEQ) == seq)
    b = b.where(F.col(SEQ).isNotNull() & F.col(STARTTIME).isNotNull() & F.col(MW).isNotNull() & F.col(PRICE).isNotNull())
    b = b.select(SEQ, F.col(STARTTIME).cast("timestamp_ntz").alias("start"), F.hour(STARTTIME).alias("hour"), F.col(MW).cast("double").alias("x"), F.col(PRICE).cast("double").alias("y"))
    w = Window.partitionBy(SEQ, "start").orderBy("x", "y")
    p = b.select("*", F.lead("x").over(w).alias("xn"), F.lead("y").over(w).alias("yn"), (F.count("*").over(Window.partitionBy(SEQ, "start")) == 1).alias("single_point"))

    def piece(kind: str, x, xend, y, yend):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), xend.alias("xend"), y.alias("y"), yend.alias("yend"))

    x, y, xn, yn = map(F.col, ("x", "y", "xn", "yn"))
    pieces = F.array(piece("point", x, x, y, y), F.when(x != xn, piece("horizontal", x, xn, y, y)), F.when(y != yn, piece("vertical", xn, xn, y, yn)))
    return p.select(SEQ, "start", "hour", "single_point", F.explode(F.filter(pieces, lambda s: s.isNotNull())).alias("s")).select(SEQ, "start", "hour", "s.*", "single_point")
