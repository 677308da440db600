"""Mixing sources to target weights; DataFrame functions only.

Targets come from filling up: weights share the mix, no source gives more than `most` times its
words, and what it can't give is shared again. Documents have a place in a permutation of their
source (an MD5 of id, text and number among equal rows); its first digits deal them to blocks. A source gives whole passes and
then the head of its permutation, up to a place that is found through sums over ever finer blocks,
and one more document that fits the rest best. A splitting tree deals the exact block counts of all
sources to output shards: each node draws one half of its blocks without replacement, which is a
multivariate-hypergeometric draw of the counts by source, until nodes are shards. Each shard then
gets its own run of each source's permuted blocks and is shuffled by itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.common import buckets, staged

WEIGHTS = (3, 1, 2)


def block_digits(shards: int) -> int:
    """Hex digits of a place that name its block: a source has 256 blocks, or as many as there are shards."""
    return max(2, math.ceil(math.log(max(shards, 1), 16)))


def n_words(text: Column) -> Column:
    """Runs of characters outside \\x20 and \\x09-\\x0D; each becomes one x, the rest goes."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text.cast("string"), r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def place(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


@dataclass
class Plan:
    sources: DataFrame  # source, source_size, target, whole (passes over all), cut (last place of the rest), extra (one more place)
    blocks: DataFrame  # source, block, pass (1, 2), shard
    shards: int
    seed: str
    digits: int


#: Rows that one task ranks at most; beyond, ranks and running sums come from many tasks' parts. Both ways give the same numbers.
SPREAD = 1_000_000


def before(df: DataFrame, order: list[Column], sums: dict[str, Column], n: int, spread: int) -> DataFrame:
    """df, n rows, with sums over all rows that come before a row in `order`, which must be total."""
    ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if n <= spread:
        return df.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(k) for k, c in sums.items()])
    own = staged(df.repartitionByRange(buckets(df.sparkSession), *order).withColumn("p_", F.spark_partition_id()))
    inside = Window.partitionBy("p_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("p_").agg(*[F.sum(c).alias(f"{k}_p") for k, c in sums.items()])  # one row a partition
    over = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("p_", *[F.coalesce(F.sum(f"{k}_p").over(over), F.lit(0)).alias(f"{k}_p") for k in sums])
    run = own.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{k}_i") for k, c in sums.items()])
    return run.join(F.broadcast(parts), "p_").select(*df.columns, *[(F.col(f"{k}_p") + F.col(f"{k}_i")).alias(k) for k in sums])


def targets(sizes: DataFrame, share_percent: int, most: int, weights=WEIGHTS, spread: int = SPREAD) -> DataFrame:
    """source, source_size, target. One row a source goes through the sums here, however many documents it has."""
    s = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    n, total = s.agg(F.count("*"), F.sum("source_size")).first()
    named = before(s, [F.asc_nulls_last("source")], {"at": F.lit(1)}, n, spread)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("at"), F.lit(len(weights))).cast("int") + 1).cast("long")
    s = staged(named.select("source", "source_size", weight.alias("w")).withColumn("cap", most * F.col("source_size")))
    all_w = s.agg(F.sum("w")).first()[0]
    order = [F.col("cap") / F.col("w"), F.asc_nulls_last("source")]
    s = staged(before(s, order, {"given": F.col("cap"), "w_before": F.col("w"), "pos": F.lit(1)}, n, spread).withColumn("left_w", F.lit(all_w).cast("long") - F.col("w_before")))
    # the first source, in order of room, that isn't filled up: from there on the rest is shared by weight
    free = (F.lit(share_percent * (total or 0)) - 100 * F.col("given")) * F.col("w") <= 100 * F.col("cap") * F.col("left_w")
    at = s.where(free).agg(F.min(F.struct("pos", "given", "left_w"))).first()[0]
    if at is None:
        return s.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    level = (F.lit(share_percent / 100 * total) - at.given) * F.col("w") / at.left_w
    return s.select("source", "source_size", F.when(F.col("pos") >= at.pos, level).otherwise(F.col("cap").cast("double")).alias("target"))


def plan(docs: DataFrame, share_percent: int = 150, most: int = 2, shards: int = 8, seed: str = "mix", spread: int = SPREAD) -> Plan:
    """docs: source, size, place (see sized). shards is rounded up to a power of two."""
    src = lambda a, b: a["source"].eqNullSafe(b["source"])
    t = staged(targets(docs, share_percent, most, spread=spread))
    first = block_digits(shards)
    t = t.withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # where the rest ends: in which block, which sub-block of it, and at which document of that
    at = t.select("source", F.col("rest").alias("room"), F.lit("").alias("block"))
    for outer, digits in ((0, first), (first, first + 3), (first + 3, 32)):
        known = at.select(F.col("source").alias("s"), "room", "block")
        inside = docs.join(known, docs.source.eqNullSafe(known.s) & (F.substring("place", 1, outer) == F.col("block")))
        sums = inside.groupBy("source", "room", F.col("block").alias("outer"), F.substring("place", 1, digits).alias("inner")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source").orderBy("inner")
        sums = sums.withColumn("end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if digits < 32:
            at = sums.where(F.col("end") > F.col("room")).groupBy("source").agg(F.min_by(F.struct((F.col("room") - F.col("end") + F.col("n")).alias("room"), F.col("inner").alias("block")), "inner").alias("x")).select("source", "x.*")
        else:
            last = sums.where(F.col("end") <= F.col("room")).groupBy("source").agg(F.max("inner").alias("last"))
    cut = at.join(last, src(at, last), "left").select(at.source.alias("s"), F.coalesce("last", "block").alias("cut"))
    t = t.join(cut, t.source.eqNullSafe(cut.s), "left").drop("s").withColumn("cut", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit("~"))))
    t = staged(t)
    # one more document, if that brings the source nearer
    known = t.select(F.col("source").alias("s"), "rest", "cut").where("cut is not null")
    d = docs.join(known, docs.source.eqNullSafe(known.s))
    got = d.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("place") <= F.col("cut"), F.col("size"))), F.lit(0)).alias("got"))
    known = got.join(t, src(got, t)).select(got.source.alias("s"), (F.col("rest") - F.col("got")).alias("lack"), "cut")
    d = docs.join(known, docs.source.eqNullSafe(known.s)).where((F.col("place") > F.col("cut")) & (F.abs(F.col("size") - F.col("lack")) < F.col("lack")))
    more = d.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lack")).alias("off"), "place")).alias("m")).select(F.col("source").alias("s"), F.col("m.place").alias("extra"))
    t = staged(t.join(more, t.source.eqNullSafe(more.s), "left").drop("s", "rest"))
    return Plan(t, staged(deal(docs, t, shards, seed, spread)), 1 << max(0, (shards - 1).bit_length()), seed, first)


def halves(slots: DataFrame, order: Column, n: int, spread: int) -> DataFrame:
    """source, rank, shard: each node's slots, the first half of them in `order` to its left child.

    A node of many slots is ranked in 4,096 parts by the first digits of the order, whose counts are added up.
    """
    s = slots.withColumn("o", order)
    if n <= spread:
        place_, all_ = F.row_number().over(Window.partitionBy("shard").orderBy("o", "source", "rank")), F.count("*").over(Window.partitionBy("shard"))
    else:
        s = s.withColumn("part", F.substring("o", 1, 3))
        sums = s.groupBy("shard", "part").agg(F.count("*").alias("m"))
        node = Window.partitionBy("shard")
        sums = sums.select(F.col("shard").alias("sh"), F.col("part").alias("pa"), F.coalesce(F.sum("m").over(node.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("m").over(node).alias("all"))
        s = s.join(sums, (s.shard == sums.sh) & (s.part == sums.pa))
        place_, all_ = F.col("ahead") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("o", "source", "rank")), F.col("all")
    return s.select("source", "rank", (2 * F.col("shard") + (place_ > F.floor(all_ / 2)).cast("int")).alias("shard"))


def deal(docs: DataFrame, sources: DataFrame, shards: int, seed: str, spread: int = SPREAD) -> DataFrame:
    """source, block, pass, shard: the splitting tree over block counts, of which there is one a source, pass and block_digits()."""
    digits = block_digits(shards)
    s = sources.select(F.col("source").alias("s"), "whole", F.substring("cut", 1, digits).alias("cut_block"))
    b = docs.select("source", F.substring("place", 1, digits).alias("block")).distinct()
    b = b.join(s, b.source.eqNullSafe(s.s)).select("source", "block", F.explode(F.array(F.when(F.col("whole") >= 1, 1), F.when((F.col("whole") >= 2) | (F.col("block") <= F.col("cut_block")), F.least(F.col("whole") + 1, F.lit(2))))).alias("pass")).where("pass is not null").distinct()
    mine = Window.partitionBy("source").orderBy(place(seed + "-blocks", F.col("source"), F.col("block"), F.col("pass")), "pass", "block")
    b = staged(b.withColumn("rank", F.row_number().over(mine)))  # the permuted blocks of each source
    slots, n = b.select("source", "rank", F.lit(0).alias("shard")), b.count()
    for level in range(max(0, (shards - 1).bit_length())):
        slots = halves(slots, place(f"{seed}-{level}", F.col("source"), F.col("rank")), n >> level, spread)
        if n >> level > spread:
            slots = staged(slots)
    # the counts of (shard, source) are drawn; each shard takes its count of the source's permuted blocks, in turn
    run = Window.partitionBy("source").orderBy("shard", "rank")
    runs = slots.select(F.col("source").alias("s"), "shard", F.row_number().over(run).alias("r"))
    return b.join(runs, b.source.eqNullSafe(runs.s) & (b["rank"] == runs.r)).select("source", "block", "pass", "shard")


EQUAL = ("doc_id_", "source_", "th_")  # rows that agree in these are equal: one tells them apart by a number


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns({"doc_id_": F.col("doc_id").cast("long"), "source_": F.col("source").cast("string"), "th_": F.md5(text.cast("binary")), "size_": n_words(text)})


def equal_rows(d: DataFrame) -> DataFrame:
    """The keys of which d has several rows."""
    return d.groupBy(*EQUAL).agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_")


def same(a: DataFrame, b: DataFrame, names=EQUAL) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def numbered(d: DataFrame) -> DataFrame:
    """d with no_, 0 and up among equal rows; d.part_ says which task read a row, so that many equal rows are numbered by many tasks."""
    key = [*EQUAL, "part_"]
    one = d.withColumn("k_", F.row_number().over(Window.partitionBy(*key).orderBy("size_")))
    parts = d.groupBy(*key).agg(F.count("*").alias("m_"))
    ahead = Window.partitionBy(*EQUAL).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n0_", F.coalesce(F.sum("m_").over(ahead), F.lit(0)))
    return one.join(parts, same(one, parts, key)).select(*[one[c] for c in d.columns], (F.col("n0_") + F.col("k_") - 1).alias("no_"))


def place_of(seed: str) -> Column:
    return place(seed, F.col("doc_id_"), F.col("th_"), F.col("no_"))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, place, staged: the text is read once. Equal rows (id, source and text) have places of their own."""
    d = staged(keyed(docs).select(*EQUAL, "size_", F.spark_partition_id().alias("part_")))
    d = numbered(d) if equal_rows(d).limit(1).count() else d.withColumn("no_", F.lit(0))
    return staged(d.select(F.col("doc_id_").alias("doc_id"), F.col("source_").alias("source"), F.col("size_").alias("size"), place_of(seed).alias("place")))


def apply(docs: DataFrame, p: Plan) -> DataFrame:
    """docs (source, place and others) with source_size, target, copies and shard_1, shard_2: where each copy goes (null: nowhere).

    Copies of a document go with its block; the extra document goes with the block of the cut.
    """
    t = p.sources.select(F.col("source").alias("s_"), "source_size", "target", "whole", "cut", "extra")
    more = F.coalesce((F.col("place") <= F.col("cut")) | F.col("place").eqNullSafe(F.col("extra")), F.lit(False))
    d = docs.join(t, docs.source.eqNullSafe(t.s_), "left").withColumn("copies", F.least(F.col("whole") + more.cast("int"), F.lit(2)))
    block = F.substring("place", 1, p.digits)
    d = d.withColumn("block_", F.when(F.col("place") > F.col("cut"), F.substring("cut", 1, p.digits)).otherwise(block)).withColumn("first_", F.when(F.col("whole") >= 1, block).otherwise(F.col("block_")))
    by = p.blocks.groupBy("source", "block").agg(F.max(F.when(F.col("pass") == 1, F.col("shard"))).alias("a"), F.max(F.when(F.col("pass") == 2, F.col("shard"))).alias("b"))
    one = by.select(F.col("source").alias("s1"), F.col("block").alias("b1"), F.col("a").alias("shard_1"))
    two = by.select(F.col("source").alias("s2"), F.col("block").alias("b2"), F.col("b").alias("shard_2"))
    d = d.join(one, d.source.eqNullSafe(one.s1) & (d.first_ == one.b1) & (d.copies >= 1), "left")
    d = d.join(two, d.source.eqNullSafe(two.s2) & (d.block_ == two.b2) & (d.copies >= 2), "left")
    return d.select(*docs.columns, "source_size", "target", "copies", "shard_1", "shard_2")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard_1, shard_2: what the mix takes of each document.

    size counts words (a null or empty text: 0 words, taken 0 times its size; a very long one is one document, which may
    miss its source's target by half its size); a null source is a source of its own and
    sorts last; a null doc_id is an id like any other. Repeated rows, and rows that share a doc_id, are
    documents of their own, with places of their own. Documents are taken whole, once, twice or not at all. An empty table
    yields no rows; other columns aren't read. Reruns agree, as places are hashes of id, text and number among equal rows.
    Sums are combined before their shuffles; a hot source is some hundreds of blocks, each of 4,096 sub-blocks, and one row of the plan.
    """
    d = sized(docs, options.get("seed", "mix"))
    got = apply(d, plan(d, **options))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "shard_1", "shard_2")


def placed(docs: DataFrame, seed: str) -> DataFrame:
    """row (docs' own columns), source, doc_id, place. Only rows that have an equal are moved, to be numbered."""
    d = keyed(docs).select(F.struct(*docs.columns).alias("row"), *EQUAL, "size_", F.spark_partition_id().alias("part_"))
    repeated = staged(equal_rows(d))
    if repeated.limit(1).count():
        several = numbered(staged(d.join(repeated, same(d, repeated), "left_semi")))
        d = d.join(repeated, same(d, repeated), "left_anti").withColumn("no_", F.lit(0).cast("long")).unionByName(several)
    else:
        d = d.withColumn("no_", F.lit(0))
    return d.select("row", F.col("source_").alias("source"), F.col("doc_id_").alias("doc_id"), place_of(seed).alias("place"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' own columns, each document as often as it is taken, dealt to shards and shuffled in each."""
    p = plan(sized(docs, options.get("seed", "mix")), **options)
    d = apply(placed(docs, p.seed), p).where("copies > 0").select("row", "place", F.posexplode(F.when(F.col("copies") == 2, F.array("shard_1", "shard_2")).otherwise(F.array("shard_1"))).alias("copy", "shard"))
    d = d.withColumn("order", place(p.seed + "-shuffle", F.col("place"), F.col("copy")))
    own = F.element_at(F.array(*map(F.lit, partition_keys(docs, p.shards))), F.col("shard") + 1)
    return d.repartition(p.shards, own).sortWithinPartitions("shard", "order").select("row.*")


def partition_keys(df: DataFrame, n: int) -> list[int]:
    """For each of n partitions a number that repartition(n, number) sends there, so that shards don't share partitions."""
    ids = df.sparkSession.range(0, 40 * n + 1000).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    got = dict(ids.groupBy("p").agg(F.min("id")).collect())
    return [got.get(k, 0) for k in range(n)]
