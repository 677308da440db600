"""Near-duplicate groups by the chosen-path set similarity join.

A document's set of word shingles has `TOKENS` minwise tokens. A tree starts with all sets; in each
node a set moves to the children of the few tokens that a hash of the node's path chooses, 1 / 0.8
of them on average, so two sets of similarity 0.8 keep one common child on average while others part.
At the planned depth nodes are small and their sets are compared with each other, by sketches.
Independent trees are repeated until the target recall is met. Paths depend on the set alone, so
every document walks its trees by itself, and one exchange brings the nodes together.

Sets that are equal are one class from the start, with a number of its own. What the sketches let pass
forms groups, which hold every linked pair; each group is then judged on its full sets, and the exact
links' connected components are the result. A large group is cut into blocks: each block is judged with a
few pivots of its group, which joins most of it, and who is left is judged against all blocks.
Nothing is emitted by pair: nodes and groups give each member a root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import buckets, grams, groups_of, mix, release, small_batches, staged, tidy, WordHashes, words_of
from gridlens.llm.substring import _pack, _runs, _unpack

TOKENS = 128
SKETCH = 64  # tokens whose low 4 bits make the sketch: 32 bytes
GOLD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(12345)
_XOR, _MUL = _rng.integers(0, 1 << 63, TOKENS, np.uint64), _rng.integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words, of all its words; none: empty."""
    h = hashes.of(words_of(text, lower=True))
    if not len(h):
        return h
    return np.unique(grams(h, words)) if len(h) >= words else grams(h, len(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of non-empty sets, (sets, TOKENS) uint32."""
    flat = np.concatenate(sets)
    n = np.array([len(s) for s in sets])
    at = np.cumsum(n) - n
    out = np.empty((len(sets), TOKENS), np.uint32)
    for j in range(TOKENS):
        out[:, j] = np.minimum.reduceat(((flat ^ _XOR[j]) * _MUL[j] >> np.uint64(32)).astype(np.uint32), at)
    return out


def profile(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, key (128-bit hash of the set, null if empty), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts = b.column(2)
            for i, j in groups_of(texts, 2_000_000):
                sets = [shingles(t.as_py(), words, hashes) for t in texts.slice(i, j - i)]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full) if full else ())
                keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [next(sig).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "th", "n_shingles", "key", "sig"])

    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(cast(text as string)) th", "cast(text as string) text").mapInArrow(tidy(run), "doc_id long, th long, n_shingles long, key binary, sig binary")


def schedule(n: int, recall: float, similarity: float, apart: float = 26.0, room: int = 16) -> tuple[int, int]:
    """(depth, trees): nodes of about `room` unrelated sets if each level parts them `apart`-fold; trees for the recall of a pair at the threshold."""
    depth = max(3, math.ceil(math.log(max(n, 1) / room) / math.log(apart))) if n > room else 3
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)  # the common children of a pair at the threshold: one on average
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def walk(sig: np.ndarray, depth: int, trees: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every node at `depth` that the sets reach in any tree."""
    tok = mix(sig.astype(np.uint64) + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))
    most = np.uint64(int((1 << 64) / (similarity * TOKENS)))
    rows, paths = [], []
    for t in range(trees):
        row, path = np.arange(len(sig)), np.full(len(sig), (t + 1) * GOLD & (1 << 64) - 1, np.uint64)
        for _ in range(depth):
            x = mix(tok[row] ^ path[:, None])
            r, c = np.nonzero(x < most)
            row, path = row[r], mix(path[r] + tok[row[r], c])
        rows.append(row)
        paths.append(path)
    return np.concatenate(rows), np.concatenate(paths)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(sets, 4) uint64: the low 4 bits of the first SKETCH tokens."""
    low = (sig[:, :SKETCH] & 15).astype(np.uint8)
    return np.ascontiguousarray(low[:, ::2] | low[:, 1::2] << 4).view(np.uint64)


def agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many of the SKETCH places each of many agrees with one."""
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return SKETCH - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) over edges a-b."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(ids))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, lab[x], low)
        np.minimum.at(new, lab[y], low)
        new = new[new]
        if (new == lab).all():
            return ids, ids[lab]
        lab = new


def similar(v: np.ndarray, sk: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """One node, exhaustively: (members, root) of each group that sketches connect. Whoever is in a group isn't compared with it again."""
    left = np.arange(1, len(v))
    queue, group = [0], [0]
    while True:
        while queue and len(left):
            hit = agreeing(sk[queue.pop()], sk[left]) >= least
            if hit.any():
                new = left[hit].tolist()
                queue += new
                group += new
                left = left[~hit]
        if len(group) > 1:
            yield v[group], int(v[group].min())
        if len(left) < 2:
            return
        queue, group, left = [int(left[0])], [int(left[0])], left[1:]


def nodes(batches: Iterator[pa.RecordBatch], depth: int, trees: int, similarity: float, parts: int) -> Iterator[pa.RecordBatch]:
    """(rep, sig) -> (part, blob): paths with their sets' sketches, dealt by path."""
    for b in batches:
        for k in range(0, b.num_rows, 4000):
            c = b.slice(k, 4000)
            rep = c.column(0).to_numpy()
            sig = np.frombuffer(b"".join(c.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            sk = sketches(sig)
            row, path = walk(sig, depth, trees, similarity)
            part = (path % np.uint64(parts)).astype(np.int64)
            o = np.lexsort((row, part))
            row, path, part = row[o], path[o], part[o]
            at, size = _runs(part)
            out = []
            for x, y in zip(at, size):
                r = row[x : x + y]
                d, n = _runs(r)
                out.append((int(part[x]), _pack(rep[r[d]], n.astype(np.uint16), sk[r[d]].reshape(-1), path[x : x + y])))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([z for _, z in out], pa.binary())], ["part", "blob"])


def _roots(v: np.ndarray, root: np.ndarray, parts: int) -> pa.Table:
    """(home, blob) of edges, dealt by the vertex."""
    home = (mix(v.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    o = np.argsort(home, kind="stable")
    at, size = _runs(home[o])
    return pa.table({"home": pa.array([int(home[o[x]]) for x in at], pa.int32()), "blob": pa.array([_pack(v[o[x : x + y]], root[o[x : x + y]]) for x, y in zip(at, size)], pa.binary())})


def compare(t: pa.Table, least: int, parts: int) -> pa.Table:
    """The nodes of one part: each member of a group gets the group's root."""
    cols: list[list[np.ndarray]] = [[], [], []]
    for blob in t.column("blob"):
        rep, n, sk, path = _unpack(blob.as_py())
        for c, x in zip(cols, (np.repeat(rep, n), np.repeat(sk.reshape(-1, 4), n, axis=0), path)):
            c.append(x)
    v, sk, path = np.concatenate(cols[0]), np.concatenate(cols[1]), np.concatenate(cols[2])
    del cols
    o = np.lexsort((v, path))
    run, size = _runs(path[o])
    a, b = [], []
    for x, y in zip(run[size > 1].tolist(), size[size > 1].tolist()):
        at = o[x : x + y]
        for members, root in similar(v[at], sk[at], least):
            a.append(members)
            b.append(np.full(len(members), root))
    release()
    if not a:
        return pa.table({"home": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    return _roots(*local_components(np.concatenate(a), np.concatenate(b)), parts)


def merge(t: pa.Table) -> pa.Table:
    """The edges of one home: the root that is left for each vertex."""
    both = [_unpack(b.as_py()) for b in t.column("blob")]
    v, root = local_components(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]))
    return pa.table({"a": v[v != root], "b": root[v != root]})


def components(edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex that each vertex of edges (a, b) reaches; by large and small stars until nothing changes.

    Minima are combined before their shuffle; a hub meets its minimum in a join with one row a vertex.
    """
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select("lo", "hi"))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
        large = staged(both.where("u > v").join(low, F.col("v") == F.col("w")).select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w")
        small = large.join(low, F.col("hi") == F.col("w")).select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        e = staged(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    stars = e.groupBy("hi").agg(F.min("lo").alias("c")).withColumnRenamed("hi", "v")
    return stars.union(e.select("lo", "lo").distinct()).groupBy("v").agg(F.min("c").alias("c"))


def links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component label of each set (by least index) under 100 * intersection >= percent * union, all pairs considered.

    Sets go by size, so a set meets only those that aren't too large for it; blocks that are one component already are passed over.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n = n[order]
    flat = np.concatenate([sets[i] for i in order])
    who = np.repeat(np.arange(k), n)
    _, term, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[term] > 1
    who, term = who[shared], (np.cumsum(df > 1) - 1)[term[shared]]
    width = int((df > 1).sum())
    start = np.searchsorted(who, np.arange(k + 1))
    lab = np.arange(k)
    step = 256
    for i in range(0, k, step):
        i2 = min(i + step, k)
        for j in range(i, k, step):
            j2 = min(j + step, k)
            if 100 * n[i2 - 1] < percent * n[j]:
                break
            if (lab[i:i2] == lab[i]).all() and (lab[j:j2] == lab[i]).all():
                continue
            inter = np.zeros((i2 - i, j2 - j), np.int64)
            for c in range(0, width, 8192):
                def dense(a: int, b: int) -> np.ndarray:
                    w, t = who[start[a] : start[b]], term[start[a] : start[b]]
                    ok = (t >= c) & (t < c + 8192)
                    m = np.zeros((b - a, min(8192, width - c)), np.float32)
                    m[w[ok] - a, t[ok] - c] = 1
                    return m

                left = dense(i, i2)
                inter += (left @ (left if i == j else dense(j, j2)).T).astype(np.int64)  # at most 8,192 by chunk, so exact
            hit = 100 * inter >= percent * (n[i:i2, None] + n[None, j:j2] - inter)
            for r in np.flatnonzero(hit.any(axis=1)):
                labs = np.unique(np.append(lab[j:j2][hit[r]], lab[i + r]))
                if len(labs) > 1:
                    lab[np.isin(lab, labs[1:])] = labs[0]
    out = np.empty(k, np.int64)
    out[order] = order[lab]
    return out


def judge_groups(t: pa.Table, percent: int) -> pa.Table:
    """The groups of one task: roots by exact links on full sets. A set that comes twice counts once."""
    group, v = t.column("c").to_numpy(), t.column("v").to_numpy()
    blobs = t.column("set")
    a, b = [], []
    o = np.lexsort((v, group))
    o = o[np.append(True, (group[o][1:] != group[o][:-1]) | (v[o][1:] != v[o][:-1]))] if len(o) else o
    for x, y in zip(*_runs(group[o])):
        at = o[x : x + y]
        if y > 1:
            lab = links([np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in at], percent)
            a.append(v[at])
            b.append(v[at][lab])
    if not a:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids, root = local_components(np.concatenate(a), np.concatenate(b))
    return pa.table({"a": ids[ids != root], "b": root[ids != root]})


PIVOTS = 16
TASK_BYTES = 32_000_000  # of sets or nodes that meet in one task, about


def judged(docs: DataFrame, groups: DataFrame, classes: DataFrame, words: int, percent: int, heavy: int, members: int) -> DataFrame:
    """Edges (a, b) between classes by exact links inside groups (v, c). The sets come from the classes' representatives' texts."""
    spark = docs.sparkSession
    size = classes.join(groups, "v").groupBy("c").agg(F.sum("n").alias("weight"), F.count("*").alias("m"))
    size = staged(size.select("c", "weight", F.greatest(F.ceil(F.col("weight") / heavy), F.ceil(F.col("m") / members)).cast("int").alias("blocks")))
    light, large = size.agg(F.sum(F.when(F.col("blocks") == 1, F.col("weight"))), F.count_if(F.col("blocks") > 1)).first()
    cut = groups.join(size, "c").join(classes.select("v", "rep", "th"), "v").select("v", "c", "blocks", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("d_"), F.col("th").alias("t_"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts = b.column(4)
            for i, j in groups_of(texts, 2_000_000):
                full = [shingles(t.as_py(), words, hashes).tobytes() for t in texts.slice(i, j - i)]
                yield pa.RecordBatch.from_arrays([*[b.column(x).slice(i, j - i) for x in range(4)], pa.array(full, pa.binary())], ["v", "c", "blocks", "block", "set"])

    def own(which: DataFrame) -> DataFrame:
        both = text.join(which, text.doc_id.eqNullSafe(which.d_) & (text.th == which.t_)).select("v", "c", "blocks", "block", "text")
        # several rows may have the representative's id and text; where a class does, it is cut down before its set is made
        one = both.dropDuplicates(["v"]) if repeated else both
        return one.mapInArrow(tidy(sets), "v long, c long, blocks int, block int, set binary")

    repeated = bool(classes.where("copies > 1").limit(1).count())
    judge = lambda df, *keys: df.groupBy(*keys).applyInArrow(lambda t: judge_groups(t.select(["v", "c", "set"]), percent), "a long, b long")
    tasks = max(4 * buckets(spark), math.ceil(8 * (light or 0) / TASK_BYTES))
    edges = judge(own(cut.where("blocks = 1")).withColumn("g", F.pmod(F.xxhash64("c"), F.lit(tasks))), "g")
    if not large:
        return edges
    # large groups: blocks with the group's pivots, then who isn't in the group's largest part against all blocks
    sets_ = staged(own(cut.where("blocks > 1")))
    pick = sets_.groupBy("c").agg(*[F.min_by("v", F.xxhash64("v", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pick = pick.select(F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p_"))
    pivots = sets_.join(pick, sets_.v == pick.p_).select("v", "c", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = staged(judge(sets_.select("v", "c", "set", "block").unionByName(pivots), "c", "block"))
    part = components(first)
    lab = staged(sets_.select("v", "c", "blocks").join(part.select(F.col("v").alias("w_"), F.col("c").alias("lab")), F.col("v") == F.col("w_"), "left").select("v", "c", "blocks", F.coalesce("lab", "v").alias("lab")))
    main = lab.groupBy("c", "lab").agg(F.count("*").alias("k")).groupBy("c").agg(F.max_by("lab", F.struct("k", "lab")).alias("main")).withColumnRenamed("c", "c_")
    left = lab.join(main, F.col("c") == F.col("c_")).where("lab <> main").select("v", "c")
    count = left.groupBy("c").agg(F.ceil(F.count("*") / members).cast("int").alias("lots"))
    left = staged(left.join(count, "c").select(F.col("v").alias("w_"), "lots", F.pmod(F.xxhash64("v", F.lit(1)), F.col("lots")).cast("int").alias("lot")))
    if left.limit(1).count():
        lots = staged(count.select(F.col("c").alias("c_"), "lots"))
        rest = sets_.join(left, sets_.v == left.w_).select("v", "c", "set", "lot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        every = sets_.join(lots, sets_.c == lots.c_).select("v", "c", "set", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "block")
        first = first.union(judge(rest.unionByName(every.select(*rest.columns)), "c", "lot", "block"))
    return edges.union(first)


def labelled(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.9999, heavy: int = 60_000, members: int = 64) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id, part (the number of the row's component, null without a word)."""
    spark = docs.sparkSession
    similarity = percent / 100
    rows = staged(profile(docs, words))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "th"))
    classes = rows.where("key is not null").groupBy("key").agg(rep.alias("rep"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"), F.count("*").alias("copies"))
    classes = staged(classes.select("key", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "n", "sig", "copies", F.monotonically_increasing_id().alias("v")))
    n = classes.count()
    depth, trees = schedule(n, recall, similarity)
    # a set's nodes: its sketch for each part that it goes to, and its paths
    parts = max(buckets(spark), math.ceil(n * trees * similarity**-depth * 20 / TASK_BYTES))
    expected = SKETCH * (similarity + (1 - similarity) / 16)
    least = int(expected - 5 * math.sqrt(expected * (1 - expected / SKETCH)))
    walked = classes.select("v", "sig").mapInArrow(tidy(lambda it: nodes(it, depth, trees, similarity, parts)), "part int, blob binary")
    met = walked.groupBy("part").applyInArrow(lambda t: compare(t, least, parts), "home int, blob binary")
    groups = staged(components(met.groupBy("home").applyInArrow(merge, "a long, b long")))
    found = components(judged(docs, groups, classes, words, percent, heavy, members))

    part = F.coalesce("c", "v")
    named = staged(classes.select("key", "v", "rep").join(found.withColumnRenamed("v", "w_"), F.col("v") == F.col("w_"), "left").select(F.col("key").alias("k"), part.alias("part"), "rep"))
    least_id = named.groupBy("part").agg(F.min("rep").alias("least")).withColumnRenamed("part", "part_")
    named = named.join(least_id, F.col("part") == F.col("part_")).select("k", "part", "least")
    out = rows.select("doc_id", "th", "n_shingles", "key").join(named, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "part")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles
    (A-Z lower-cased). component_id is the smallest doc_id that links reach, kept whether it is the
    document's own. A text of fewer words is one shingle; a null or empty one has none and is linked
    with nothing. A very long text is one set, held by one task. Equal sets are one class, so a third of all rows may be copies; repeated rows are
    equal sets. A row with a null doc_id is linked like any other, but its id is never a component_id; where links reach
    no id, component_id is null and kept true. Rows that share a doc_id have each their own set.
    An empty table yields no rows; other columns aren't read.

    recall is the probability that a pair at the threshold meets in a tree; more similar ones meet more often, and
    pairs of one group meet anyhow. A group of over `heavy` shingles or `members` sets is cut into blocks; no pair is left out by that.
    """
    found = labelled(docs, **options)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, with their own columns: one document of each group of near-duplicates, and one of repeated rows.

    Texts of one doc_id are one document; if it is the one that stays, it stays with the text of the smallest hash.
    A group without any doc_id keeps the row whose text has the smallest hash.
    """
    cols = docs.columns
    found = labelled(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    nameless = F.when(F.col("component_id").isNull(), F.struct(F.col("part"), F.when(F.col("part").isNull(), F.col("th")).alias("t")))
    one = found.groupBy("component_id", nameless.alias("x")).agg(F.min(F.struct("doc_id", "th")).alias("k"), F.count("*").alias("n"))
    one = staged(one.select(F.col("k.doc_id").alias("d_"), F.col("k.th").alias("t_"), "n"))
    own = docs.select(F.struct(*cols).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    both = own.join(one, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")))
    if not one.where("n > 1").limit(1).count():
        return both.select("row.*")
    repeated = both.where("n > 1").dropDuplicates(["doc_id", "th"])
    return both.where("n = 1").select("row.*").unionByName(repeated.select("row.*"))
