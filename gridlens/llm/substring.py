"""Removal of repeated passages by recompression.

Every text is a sequence of word names. In each round, runs of one name and pairs whose names fall
on the left and right side of that round's random split become one symbol, named by a hash of its
parts; so equal passages get equal symbols but near their ends, in all documents alike. Beside each boundary between symbols stands the range of words it depends on. A
window (20 words) picks, on the highest level that has one, a boundary whose range lies inside it:
its anchor, named by the words that it depends on. Equal windows pick the same anchor. A window
without any such boundary is its own anchor.

Two Spark rounds follow. The first brings equal names of all documents together and reveals which
stand more than once; all windows of other anchors are unique. The second sends the words around the
anchors that are left to the bucket of their name, where windows are compared word by word; the
later ones of equal windows are what is removed. Hashes choose who meets, words decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import buckets, groups_of, mix, release, small_batches, tidy, words_of

FAR = 1 << 40
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _times(k: int) -> np.uint64:
    return np.uint64(int(GOLD) * k & (1 << 64) - 1)


class Ranges:
    """Hashes of h[a:b] by prefix sums, modulo 2^64."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        up, down = np.full(n + 1, BASE), np.full(n + 1, INVERSE)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(up)[:-1], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + GOLD * (b - a).astype(np.uint64))


def levels(h: np.ndarray, first: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """After each round: (position, lo, hi, hash) of the boundaries that are left.

    first: whether a word starts a document. [lo, hi) is what a boundary depends on; boundaries at a
    document's edge depend on words outside it. hash is of the two symbols that decided on the boundary.
    """
    pos, name, edge = np.arange(len(h)), h, first
    lo, hi = pos, pos  # words stand apart everywhere; later, a document's edge depends on what is outside it
    for r in range(rounds):
        if len(pos) < 2:
            return
        salt = _times(r + 1)
        side = mix(name + salt) & np.uint64(1)
        gone = np.zeros(len(pos), bool)
        gone[1:] = ((name[1:] == name[:-1]) | ((side[:-1] == 0) & (side[1:] == 1))) & ~edge[1:]
        # what a boundary depends on grows by the symbols on both sides
        lo2, hi2 = lo.copy(), hi.copy()
        lo2[1:] = lo[:-1]
        hi2[:-1] = hi[1:]
        hi2[-1] = len(h) if r == 0 else pos[-1] + FAR
        lo, hi = np.where(edge, pos - FAR, lo2), np.where(edge, pos + FAR, hi2)
        both = name.copy()
        both[1:] = mix(name[:-1] * BASE + name[1:])
        keep = np.flatnonzero(~gone)
        # a symbol's name: of its only part, or of all parts in order
        size = np.diff(np.append(keep, len(pos)))
        whole = Ranges(name)
        new = np.where(size > 1, mix(whole.of(keep, keep + size) + salt), name[keep])
        pos, lo, hi, edge, tag, name = pos[keep], lo[keep], hi[keep], edge[keep], both[keep], new
        yield pos, lo, hi, mix(tag + salt)


def anchors(h: np.ndarray, first: np.ndarray, last_start: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, anchor position) of each window; last_start: whether a window may start here (all its words are in one document)."""
    n = len(h)
    ranges = Ranges(h)
    key, at = np.zeros(n, np.uint64), np.full(n, -1)
    open_ = last_start.copy()
    for level, (pos, lo, hi, tag) in reversed(list(enumerate(levels(h, first, rounds), 1))):
        a, b = hi - width, lo  # windows that start in a..b see all it depends on
        use = np.flatnonzero((b >= a) & (lo >= 0) & (hi <= n) & (lo > -FAR // 2) & (hi < FAR // 2))
        if not len(use):
            continue
        waiting = np.concatenate([[0], np.cumsum(open_)])
        a_, b_ = np.maximum(a[use], 0), b[use]
        some = waiting[b_ + 1] > waiting[a_]
        use, a_, b_ = use[some], a_[some], b_[some]
        order = np.argsort(tag[use], kind="stable")[::-1]  # the smallest hash writes last and so wins; of equals, the leftmost
        use, a_, b_ = use[order], a_[order], b_[order]
        size = b_ - a_ + 1
        win = np.repeat(a_ - np.cumsum(size) + size, size) + np.arange(size.sum())
        who = np.repeat(use, size)
        ok = open_[win]
        win, who = win[ok], who[ok]
        at[win] = who
        mask = np.zeros(n, bool)
        mask[win] = True
        got = np.flatnonzero(mask)
        mine = at[got]
        key[got] = ranges.of(lo[mine], hi[mine]) + _times(level)
        at[got] = pos[mine]
        open_[got] = False
    alone = np.flatnonzero(open_)
    key[alone] = ranges.of(alone, alone + width)
    at[alone] = alone
    return key, at


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(a).to_bytes(4, "little") + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays)
    return zstandard.compress(raw, 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "little"), np.dtype(raw[at + 4 : at + 8].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * kind.itemsize
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


LAST_ID = np.iinfo(np.int64).max  # stands for a null doc_id, which comes after all others
GROUP_BYTES = 3_000_000  # of texts that are worked on together
TASK_BYTES = 32_000_000  # of texts for each bucket
_KEY = ("id", "x", "y")  # a document: its id, and 128 bits of its text's hashes


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words by text). Equal words have equal hashes; that is all that is asked of them here."""
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8))
    a, z = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    ends = np.cumsum([len(r) + 1 for r in raw])  # where the next text starts, less the first space
    return Ranges(data.astype(np.uint64) * GOLD).of(a, z), np.diff(np.searchsorted(a, ends + 1), prepend=0)


class Texts:
    """The documents of one group: words, windows and anchors. Anchors are numbered in order of position and name, so a document numbers its own alike in any group."""

    def __init__(self, b: pa.RecordBatch, i: int, j: int, width: int, rounds: int):
        self.key = [b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in _KEY]
        self.raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text").slice(i, j - i)]
        h, n = word_hashes(self.raw)
        self.start = np.cumsum(n) - n
        self.any = bool((n >= width).any())
        if not self.any:
            return
        doc = np.repeat(np.arange(len(n)), n)
        first = np.zeros(len(h), bool)
        first[self.start[n > 0]] = True
        inside = np.arange(len(h)) <= np.repeat(self.start + n - width, n)
        key, at = anchors(h, first, inside, width, rounds)
        win = np.flatnonzero(inside)
        o = np.lexsort((win, key[win], at[win]))
        self.win = win[o]  # window starts, by anchor
        k, a = key[self.win], at[self.win]
        self.first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (k[1:] != k[:-1])]))  # each anchor's first window
        self.size = np.diff(np.append(self.first, len(self.win)))
        self.name = mix(k[self.first])
        self.doc = doc[self.win[self.first]]
        at_doc, many = _runs(self.doc)
        self.number = np.arange(len(self.doc)) - np.repeat(at_doc, many)

    def refs(self, at: np.ndarray) -> list[np.ndarray]:
        """The documents and numbers of anchors, which come in order."""
        d_at, d_size = _runs(self.doc[at])
        d = self.doc[at[d_at]]
        return [*(k[d] for k in self.key), d_size.astype(np.uint32), np.diff(self.number[at], prepend=0).astype(np.int32)]


def homes(ids: np.ndarray, x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) ^ mix(x.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _dealt(where: np.ndarray, at: np.ndarray, blob) -> Iterator[tuple[int, bytes]]:
    """(place, blob of the items that go there, in order)."""
    o = np.argsort(where, kind="stable")
    for x, y in zip(*_runs(where[o])):
        yield int(where[o[x]]), blob(at[o[x : x + y]])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


def names(batches: Iterator[pa.RecordBatch], width: int, rounds: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, kind, blob): kind 0, names that stand once in this group, with their anchors; 1, names that stand more often, without; 2, the anchors of those, for their documents' homes."""
    for b in batches:
        for i, j in groups_of(b.column("text"), GROUP_BYTES):
            t = Texts(b, i, j, width, rounds)
            if not t.any:
                continue
            _, inv, count = np.unique(t.name, return_inverse=True, return_counts=True)
            often = count[inv] > 1
            once, several = np.flatnonzero(~often), np.unique(t.name[often])
            place = lambda n: (n % np.uint64(parts)).astype(np.int64)
            rows = [(p, 0, blob) for p, blob in _dealt(place(t.name[once]), once, lambda at: _pack(t.name[at], *t.refs(at)))]
            rows += [(p, 1, blob) for p, blob in _dealt(place(several), several, _pack)]
            at = np.flatnonzero(often)
            rows += [(p, 2, blob) for p, blob in _dealt(homes(t.key[0], t.key[1], parts)[t.doc[at]], at, lambda a: _pack(*t.refs(a)))]
            if rows:
                yield _batch(rows)


def _spread(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """(id, x, y) and number of each anchor or window in packed lists."""
    doc = [np.concatenate([np.repeat(p[k], p[3]) for p in parts]) for k in range(3)]
    return doc, np.concatenate([np.cumsum(p[4].astype(np.int64)) for p in parts])


def _refs(doc: list[np.ndarray], number: np.ndarray) -> bytes:
    o = np.lexsort((number, *doc[::-1]))
    doc, number = [d[o] for d in doc], number[o]
    new = np.concatenate([[True], np.any([d[1:] != d[:-1] for d in doc], axis=0)])
    at = np.flatnonzero(new)
    return _pack(*(d[at] for d in doc), np.diff(np.append(at, len(number))).astype(np.uint32), np.diff(number, prepend=0).astype(np.int32))


def _home(out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"home": pa.array([h for h, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})


def shared(key: tuple, t: pa.Table, parts: int) -> pa.Table:
    """One part of the names: the anchors whose name stands in another group, too, dealt by home; others that are known pass through."""
    single, several, out = [], [], []
    for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob")):
        if kind == 2:
            out.append((key[0].as_py(), blob.as_py()))
        else:
            (several if kind else single).append(_unpack(blob.as_py()))
    if single:
        name = np.concatenate([s[0] for s in single])
        own, inv, count = np.unique(name, return_inverse=True, return_counts=True)
        again = (count > 1) | np.isin(own, np.concatenate([s[0] for s in several] or [own[:0]]))
        use = np.flatnonzero(again[inv])
        if len(use):
            doc, number = _spread([s[1:] for s in single])
            out += _dealt(homes(doc[0][use], doc[1][use], parts), use, lambda at: _refs([d[at] for d in doc], number[at]))
    release()
    return _home(out)


def listed(t: pa.Table, width: int = 0) -> pa.Table:
    """One home: (id, x, y) of each document, and the numbers in its packed lists; with a width, the word ranges that windows starting there cover."""
    (ids, x, y), number = _spread([_unpack(b.as_py()) for b in t.column("blob")])
    o = np.lexsort((number, y, x, ids))
    ids, x, y, number = ids[o], x[o], y[o], number[o]
    doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    if width:
        cut = doc | np.concatenate([[True], number[1:] > number[:-1] + width])  # touching ranges become one
        number = np.stack([number[cut], number[np.append(np.flatnonzero(cut)[1:] - 1, len(number) - 1)] + width], 1)
    else:
        cut = doc | np.concatenate([[True], number[1:] > number[:-1]])
        number = number[cut][:, None]
    offsets = np.concatenate([[0], np.cumsum(number.shape[1] * np.bincount(np.cumsum(doc)[cut] - 1))]).astype(np.int32)
    return pa.table({"i": ids[doc], "u": x[doc], "w": y[doc], "list": pa.ListArray.from_arrays(pa.array(offsets), pa.array(number.reshape(-1).astype(np.int32)))})


def leads(word: np.ndarray, start: np.ndarray, order: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """For each window of words that begins at start the first in `order` (least significant key first) that equals it word by word. Hashes propose, all words are compared."""
    lead = np.arange(len(start))
    hash_ = Ranges(mix(word.astype(np.uint64))).of(start, start + width)
    todo = np.argsort(hash_, kind="stable")
    run, size = _runs(hash_[todo])
    todo = todo[np.repeat(size > 1, size)]  # most windows are alone
    todo = todo[np.lexsort((*(k[todo] for k in order), hash_[todo]))]
    while len(todo):
        run, size = _runs(hash_[todo])
        head = np.repeat(todo[run], size)
        same = np.ones(len(todo), bool)
        for a in range(0, len(todo), 20_000):
            z = slice(a, a + 20_000)
            x, y = start[todo[z]], start[head[z]]
            for k in range(width):
                same[z] &= word[x + k] == word[y + k]
        lead[todo[same]] = head[same]
        todo = todo[~same]  # equal hashes of different words: the rest of such runs goes once more, in the same order
    return lead


class Numbers(dict):
    """Words, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def segments(batches: Iterator[pa.RecordBatch], width: int, rounds: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, kind, blob): kind 0, the words around shared anchors for the bucket of their name, with the windows that begin there; 2, windows that repeat one in this group already."""
    for b in batches:
        for i, j in groups_of(b.column("text"), GROUP_BYTES):
            t = Texts(b, i, j, width, rounds)
            if not t.any:
                continue
            words = [r.split() for r in t.raw]
            numbers = b.column("list").slice(i, j - i)
            at_doc = np.searchsorted(t.doc, np.arange(j - i))
            size = pc.list_value_length(numbers).to_numpy(zero_copy_only=False)
            use = np.repeat(at_doc, size) + numbers.flatten().to_numpy()
            n = t.size[use]
            win = t.win[np.repeat(t.first[use] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            owner = np.repeat(np.arange(len(use)), n)
            doc = t.doc[use][owner]
            pos = win - t.start[doc]
            word = Numbers().of([w for ws in words for w in ws])
            lead = leads(word, win, (pos, t.key[0][doc]), width)
            later = (t.key[0][doc] > t.key[0][doc[lead]]) | ((t.key[0][doc] == t.key[0][doc[lead]]) & (pos > pos[lead]))
            rows = []
            at = np.flatnonzero(later)
            if len(at):
                home = homes(t.key[0], t.key[1], parts)[doc[at]]
                rows += [(p, 2, blob) for p, blob in _dealt(home, at, lambda a: _refs([k[doc[a]] for k in t.key], pos[a]))]
            # of equal windows in this group the first one goes on, for all its words' sake with its neighbours of one anchor
            sent = np.flatnonzero(~later)
            if len(sent):
                s_at, s_size = _runs(owner[sent])
                anchor = use[owner[sent][s_at]]
                s_pos = pos[sent][s_at]
                s_last = pos[sent][s_at + s_size - 1]

                def blob(a: np.ndarray) -> bytes:
                    d = t.doc[anchor[a]]
                    text = b" ".join(b" ".join(words[k][p : z + width]) for k, p, z in zip(d.tolist(), s_pos[a].tolist(), s_last[a].tolist()))
                    m = s_size[a]
                    w = np.repeat(s_at[a] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    return _pack(*(k[d] for k in t.key), s_pos[a].astype(np.int32), (s_last[a] - s_pos[a] + width).astype(np.uint8), m.astype(np.uint8), (pos[sent][w] - np.repeat(s_pos[a], m)).astype(np.uint8), np.frombuffer(text, np.uint8))

                rows += [(p, 0, x) for p, x in _dealt((t.name[anchor] % np.uint64(parts)).astype(np.int64), np.arange(len(anchor)), blob)]
            yield _batch(rows)


def meet(key: tuple, t: pa.Table, width: int, parts: int) -> pa.Table:
    """One bucket: windows whose equal starts earlier, dealt by their documents' homes; repeats known before pass through."""
    out: list[tuple[int, bytes]] = []
    cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
    known = Numbers()
    base = 0
    for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob")):
        if kind:
            out.append((key[0].as_py(), blob.as_py()))
            continue
        ids, x, y, s_pos, n_words, m, off, text = _unpack(blob.as_py())
        word = known.of(text.tobytes().split(b" "))
        first = np.cumsum(n_words.astype(np.int64)) - n_words + base
        base += len(word)
        for c, v in zip(cols, (word, *(np.repeat(k, m) for k in (ids, x, y)), np.repeat(s_pos, m) + off, np.repeat(first, m) + off)):
            c.append(v)
    if cols[0]:
        word, ids, x, y, pos, start = (np.concatenate(c) for c in cols)
        del cols, known
        lead = leads(word, start, (pos, ids), width)
        at = np.flatnonzero((ids > ids[lead]) | ((ids == ids[lead]) & (pos > pos[lead])))
        if len(at):
            out += _dealt(homes(ids[at], x[at], parts), at, lambda a: _refs([ids[a], x[a], y[a]], pos[a].astype(np.int64)))
    release()
    return _home(out)


def _documents(docs: DataFrame) -> DataFrame:
    text = "cast(text as string)"
    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", f"coalesce(cast(doc_id as bigint), {LAST_ID}L) id", f"xxhash64({text}) x", f"xxhash64(7, {text}) y", f"{text} text")


_LIST = "i long, u long, w long, list array<int>"


def _with(documents: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return documents.join(lists, (F.col("id") == F.col("i")) & (F.col("x") == F.col("u")) & (F.col("y") == F.col("w")), how)


def repeats(documents: DataFrame, width: int = 20, rounds: int = 4, parts: int | None = None) -> DataFrame:
    """i, u, w (a document's key), list: flat [start, end) pairs of word positions that repeat an earlier window."""
    if not parts:
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(buckets(documents.sparkSession), -(-size // TASK_BYTES))
    sent = "part int, kind int, blob binary"
    named = documents.mapInArrow(tidy(lambda it: names(it, width, rounds, parts)), sent)
    met = named.groupBy("part").applyInArrow(lambda key, t: shared(key, t, parts), "home int, blob binary")
    numbers = met.groupBy("home").applyInArrow(lambda t: listed(t), _LIST)
    around = _with(documents, numbers, "inner").mapInArrow(tidy(lambda it: segments(it, width, rounds, parts)), sent)
    met = around.groupBy("part").applyInArrow(lambda key, t: meet(key, t, width, parts), "home int, blob binary")
    return met.groupBy("home").applyInArrow(lambda t: listed(t, width), _LIST)


def dedup(docs: DataFrame, width: int = 20, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; on request kept (string).

    A word goes if a window of `width` words (129 at most) over it equals one that starts earlier: in a document of
    smaller doc_id, or in the same one further ahead. Windows are judged on the input. A null or short
    text loses nothing. Null doc_ids come last and count as one id, whose texts are versions; rows that repeat a doc_id and text start nowhere
    earlier than each other, and are treated alike; one doc_id with two texts is one document with two
    versions, told apart by 128 bits of hash, each with its own removals. A very long text is worked on by itself, in one task. An empty table yields no rows; other columns aren't read.
    The number of buckets follows the bytes of all texts; a name or window goes once a group of texts to its bucket, however often the group has it.
    """
    documents = _documents(docs)
    both = _with(documents, repeats(documents, width, **options), "left").select("doc_id", "text", "list")
    names_ = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t, cover in zip(b.column(1), b.column(2)):
                words = words_of(t.as_py())
                cuts = cover.as_py() or []
                kept, at = [], 0
                for s, e in zip(cuts[::2], cuts[1::2]):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                text = b" ".join(kept)
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass") if with_text else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2 : 3 + with_text]]], names_)

    return both.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
