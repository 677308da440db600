"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Equal rows (id and vector) are one class with a count, made before anything else is shuffled.
Classes are dealt to shards by a hash of id and vector, so neither the copies of a vector nor the rows of an id meet in one shard
by force: shards of about shard_rows, in larger tables 64 larger ones. Each shard becomes one row with its
packed tree. Queries are packed into blocks. A block is searched in waves of shards, first one, then
a few, then all others; after each wave the k-th score that all its shards together gave goes on
with the block. In a shard, nodes come in the order of their upper bound q.c + |q| r and are cut as
soon as no query of the block can gain from them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import release, staged, tidy

NONE = np.iinfo(np.int64).min
LEAF = 64
#: Every query goes to every shard, so there are MOST_SHARDS at most until a shard holds LARGEST_SHARD rows, which bounds a worker's memory.
MOST_SHARDS, LARGEST_SHARD = 64, 131_072
#: So many blocks meet a tree in one task.
LOT = 1024


def compact(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def build(ids: np.ndarray, x: np.ndarray, times: np.ndarray | None = None, key: np.ndarray | None = None) -> dict:
    """Nodes in depth-first order; node n covers rows lo[n]:hi[n]; kids[n] are its children or -1. times: how many rows each one stands for; key: a hash of each."""
    times = np.ones(len(ids), np.int64) if times is None else times
    key = np.zeros(len(ids), np.int64) if key is None else key
    order = np.argsort(ids, kind="stable")
    ids, x, times, key = ids[order], x[order], times[order], key[order]
    f = x.astype(np.float64)
    perm = np.arange(len(ids))
    lo, hi, kids, centre, radius = [], [], [], [], []

    def node(a: int, b: int) -> int:
        n = len(lo)
        pts = f[perm[a:b]]
        c = pts.mean(axis=0)
        d = np.sqrt(((pts - c) ** 2).sum(axis=1))
        lo.append(a), hi.append(b), kids.append((-1, -1)), centre.append(c), radius.append(d.max())
        if b - a > LEAF and radius[n] > 0:
            far = pts[d.argmax()]
            other = pts[((pts - far) ** 2).sum(axis=1).argmax()]
            side = pts @ (other - far)
            cut = np.argsort(side, kind="stable")
            perm[a:b] = perm[a:b][cut]
            mid = a + (b - a) // 2
            kids[n] = (node(a, mid), node(mid, b))
        return n

    if len(ids):
        node(0, len(ids))
    return {"ids": ids[perm], "x": compact(x[perm]), "times": times[perm], "key": key[perm], "lo": np.array(lo), "hi": np.array(hi), "kids": kids, "c": np.array(centre, np.float64), "r": np.array(radius)}


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; by floats where all partial sums stay under 2^53."""
    d = min(q.shape[1], x.shape[1])  # a shorter vector counts as padded by zeros
    q, x = q[:, :d], x[:, :d]
    if not d or not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * d
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.einsum("ik,jk->ij", q.astype(np.int64), x.astype(np.int64))


def search(tree: dict, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, qkey: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, times) of the best k classes for each query that reach kth; unused places hold NONE. A query's own row is left out of its class."""
    best, who, times = np.full((len(qid), k), NONE), np.zeros((len(qid), k), np.int64), np.zeros((len(qid), k), np.int64)
    kth = kth.copy()
    if not len(tree["lo"]):
        return best, who, times
    qkey = np.zeros(len(qid), np.int64) if qkey is None else qkey
    f = q.astype(np.float64)
    norm = np.sqrt((f**2).sum(axis=1))
    d = min(f.shape[1], tree["c"].shape[1])

    # of all nodes at once; the slack follows the size of the terms, as their sum may cancel out
    c, reach = tree["c"][:, :d], norm[:, None] * tree["r"]
    bound = f[:, :d] @ c.T + reach + 1e-9 * (1 + np.abs(f[:, :d]) @ np.abs(c).T + reach)
    if "short" not in tree:
        x = tree["x"].astype(np.float64)
        tree["most"], tree["short"] = np.sqrt((x**2).sum(axis=1)).max(), x.astype(np.float32)
    # no partial sum is over the product of the lengths, so that floats hold all of them exactly
    short = f[:, :d].astype(np.float32) if norm.max() * tree["most"] < 2.0**24 - 1 else None

    live = np.arange(len(qid))
    heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []

    def push(n: int, at: np.ndarray) -> None:
        b = bound[at, n]
        ok = b >= kth[at]
        if ok.any():
            heapq.heappush(heap, (-b[ok].max(), n, at[ok], b[ok]))

    push(0, live)
    while heap:
        _, n, at, b = heapq.heappop(heap)
        at = at[b >= kth[at]]
        if not len(at):
            continue
        if tree["kids"][n][0] >= 0:
            for kid in tree["kids"][n]:
                push(kid, at)
            continue
        for a in range(tree["lo"][n], tree["hi"][n], 4 * LEAF):
            z = min(a + 4 * LEAF, tree["hi"][n])
            s = dot(q[at], tree["x"][a:z]) if short is None else short[at] @ tree["short"][a:z, :d].T
            can = (s >= kth[at][:, None].astype(s.dtype)).any(axis=1)
            if not can.any():
                continue
            rows, s = at[can], s[can].astype(np.int64)
            ids = np.broadcast_to(tree["ids"][a:z], s.shape)
            m = np.broadcast_to(tree["times"][a:z], s.shape)
            own = (ids == qid[rows][:, None]) & (tree["key"][a:z][None, :] == qkey[rows][:, None])
            if own.any():
                m = m - own
            s = np.where((m == 0) | (s < kth[rows][:, None]), NONE, s)
            use = (s != NONE).any(axis=1)
            if not use.any():
                continue
            rows = rows[use]
            best[rows], who[rows], times[rows] = top_of(np.concatenate([best[rows], s[use]], axis=1), np.concatenate([who[rows], ids[use]], axis=1), np.concatenate([times[rows], m[use]], axis=1), k)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])
    return best, who, times


def top_of(score: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row, ties by id."""
    top = np.lexsort((ids, -np.maximum(score, NONE + 1)), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, top, 1) for x in (score, ids, times))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, shorter ones padded by zeros; straight from Arrow's buffers, as a shard is large."""
    x = col.combine_chunks()
    many, flat = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64), x.flatten().to_numpy(zero_copy_only=False)
    d = int(many.max(initial=0))
    if (many == d).all():
        return flat.reshape(len(many), d)
    out = np.zeros((len(many), d), np.int64)
    out[np.repeat(np.arange(len(many)), many), np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
    return out


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, shard_rows: int = 2048, block_rows: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", second_wave: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all other rows, ties to the smaller id.

    Queries are rows whose id is divisible by query_every. Components become floor(scale * x). Rows
    with a null id or vector, or a null or non-finite component take no part. A shorter vector counts as
    padded by zeros. Repeated rows are candidates each, other rows of the query's id as well; only the query's own row is left out, and
    a row that stands m times among the queries has its results m times. Fewer candidates than k: all of them.
    An empty table yields no rows; other columns aren't read; long vectors are read whole. Scores must fit a long. Trees and blocks are
    rows of fixed size in the shared folder; each (block, shard) is one unit of work, and a query's
    candidates are cut to k in each task before they meet.
    """
    x = F.col("e").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False)))
    v = ok.select("id", F.transform(x, lambda a: F.floor(a * scale).cast("long")).alias("v"))
    classes = staged(v.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("key", F.xxhash64("id", "v")))
    n, n_queries = classes.agg(F.count("*"), F.count_if(F.col("id") % query_every == 0)).first()
    shards, blocks = max(1, min(-(-n // shard_rows), MOST_SHARDS), -(-n // LARGEST_SHARD)), max(1, -(-n_queries // block_rows))
    lots = -(-blocks // LOT)
    queries = classes.where(F.col("id") % query_every == 0)

    def pack_tree(key: tuple, t: pa.Table) -> pa.Table:
        ids, times, keys = (t.column(c).to_numpy() for c in ("id", "times", "key"))
        return pa.table({"shard": [key[0].as_py()], "tree": [pickle.dumps(build(ids, _matrix(t.column("v")), times, keys), 5)]}, schema=pa.schema([("shard", pa.int32()), ("tree", pa.binary())]))

    def pack_block(key: tuple, t: pa.Table) -> pa.Table:
        ids, times, keys = (t.column(c).to_numpy() for c in ("id", "times", "key"))
        empty = [np.full((len(ids), k), NONE), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)]
        return pa.table({"block": [key[0].as_py()], "qs": [pickle.dumps((ids, keys, times, compact(_matrix(t.column("v"))), np.full(len(ids), NONE)), 5)], "best": [pickle.dumps(empty, 5)]}, schema=pa.schema([("block", pa.int32()), ("qs", pa.binary()), ("best", pa.binary())]))

    deal = lambda m, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(m)).cast("int")
    trees = staged(classes.withColumn("shard", deal(shards, 1)).groupBy("shard").applyInArrow(pack_tree, "shard int, tree binary"))
    state = staged(queries.withColumn("block", deal(blocks, 2)).groupBy("block").applyInArrow(pack_block, "block int, qs binary, best binary"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A lot's blocks and one shard's tree: (block, best of that shard)."""
        of, found = [], []
        tree = pickle.loads(right.column("tree")[0].as_py()) if len(left) and len(right) else None
        for blk, qs in zip(left.column("block").to_pylist(), left.column("qs")) if tree else ():
            qid, qkey, _, q, kth = pickle.loads(qs.as_py())
            got = search(tree, qid, q, kth, k, qkey)
            use = (got[0] != NONE).any(axis=1)
            if use.any():
                of.append(blk)
                found.append(pickle.dumps((np.flatnonzero(use), *(x[use] for x in got)), 5))
        del tree
        release()
        return pa.table({"block": pa.array(of, pa.int32()), "found": pa.array(found, pa.binary())})

    def merge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's results so far and those of a wave: the best of both, and the k-th scores they give."""
        qid, qkey, times, q, kth = pickle.loads(left.column("qs")[0].as_py())
        best = pickle.loads(left.column("best")[0].as_py())
        for f in right.column("found"):
            rows, *got = pickle.loads(f.as_py())
            for x, y in zip(best, top_of(*(np.concatenate([x[rows], y], axis=1) for x, y in zip(best, got)), k)):
                x[rows] = y
        return pa.table({"block": left.column("block"), "qs": [pickle.dumps((qid, qkey, times, q, np.maximum(kth, best[0][:, -1])), 5)], "best": [pickle.dumps(best, 5)]}, schema=left.schema)

    done = 0
    for upto in sorted({1, min(1 + second_wave, shards), shards}):
        # a block begins with its own shard, so that the waves spread over all of them
        wave = state.select("block", "qs", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("step")).withColumn("shard", F.pmod(F.col("block") + F.col("step"), F.lit(shards)).cast("int"))
        wave = wave.withColumn("lot", F.pmod("block", F.lit(lots))).groupBy("shard", "lot")
        forest = trees.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).groupBy("shard", "lot")
        # a cogroup hands a tree over once for all blocks of a lot, and no side of it can be sent to the driver
        found = wave.cogroup(forest).applyInArrow(run, "block int, found binary")
        state = staged(state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(merge, "block int, qs binary, best binary"))
        done = upto

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes become rows again: a candidate class as many as there is room for, a query class its number."""
        for b in batches:
            for qs, best in zip(b.column("qs"), b.column("best")):
                qid, _, many, _, _ = pickle.loads(qs.as_py())
                score, ids, times = pickle.loads(best.as_py())
                upto = np.minimum(np.cumsum(np.where(score != NONE, times, 0), axis=1), k)
                copies = np.diff(upto, axis=1, prepend=0)
                row, place = np.nonzero(copies)
                c = copies[row, place]
                first = np.repeat(upto[row, place] - c, c)
                rank = first + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + 1
                row, place = np.repeat(row, c), np.repeat(place, c)
                for a in range(0, len(row), 4096):  # a hot query class is handed on in pieces
                    r, p, m = row[a : a + 4096], place[a : a + 4096], many[row[a : a + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(rank[a : a + 4096].astype(np.int32)), pa.array(ids[r, p]), pa.array(score[r, p]), pa.array(m)], ["query_id", "rank", "vec_id", "score", "many"])

    rows = state.select("qs", "best").mapInArrow(tidy(spread), "query_id long, rank int, vec_id long, score long, many long")
    return rows.withColumn("many", F.explode(F.sequence(F.lit(1).cast("long"), "many"))).select("query_id", "rank", "vec_id", "score")
