"""Personal data: patterns, and terms that give a protected value away.

The patterns find values to protect. The corpus then tells how strongly a term near such a value
reveals it: with n_e different contexts of the value, n_te of them with the term inside, n_t units
that hold the term and N units in all, the pointwise mutual information ln(n_te N / (n_t n_e)) is set
against the value's own information ln(N / n_e). Units are the value's contexts and, apart from them,
different texts: n_t is n_te and the texts that hold the term, but not near the value; N is n_e and the
texts without the value. A term over the lower threshold of that ratio is generalised to its
class (a name, a word, an abbreviation), over the upper one removed, wherever it stands in the documents
where it is near the value. In all other documents that happens if the term alone gives the value away:
if n_te / n_t, the share of the value's units among those that hold it, is over a half. Copies share their text, and near copies their
contexts, so they are evidence neither for a term nor against it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import small_batches, staged, tidy

KINDS = ("email", "ip", "card", "phone", "term", "removed")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # a run of digits that fails at its start fails throughout
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")  # shorter ones fail anyway
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[0-9]")
BLOOM_BITS = (20, 26)  # least and most bits of the filter of terms: 8 MB at most
COPY_BITS = 24


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; found from each @ outwards, so that long runs take linear time."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = floor = m.end()
            yield start, end
        else:
            floor = at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
        out.sort()
    return out


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.lower().encode("utf-8", "surrogatepass")) >> 1


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """(entity, term, context) for the terms among the `reach` words on either side of each value, however far off they stand.

    The text's terms are found in one pass; those that overlap a value are none.
    """
    if not spans:
        return []
    starts, ends, k, until = array("q"), array("q"), 0, 0
    for m in _TERM.finditer(text):
        a, z = m.span()
        while k < len(spans) and spans[k][0] < z:  # until: how far the values reach that begin before this term's end
            until = max(until, spans[k][2])
            k += 1
        if until <= a:
            starts.append(a)
            ends.append(z)
    found: dict[tuple[int, int, int], None] = {}
    for s, kind, e in spans:
        entity = xxhash.xxh64_intdigest(f"{kind}:{text[s:e].lower()}".encode("utf-8", "surrogatepass")) >> 1
        p, n = bisect_right(ends, s), bisect_left(starts, e)
        near = [text[starts[i] : ends[i]].lower() for i in (*range(max(0, p - reach), p), *range(n, min(n + reach, len(starts))))]
        window = xxhash.xxh64_intdigest(" ".join(near).encode("utf-8", "surrogatepass")) >> 1
        for t in near:
            found[entity, term_hash(t), window] = None
    return list(found)


def term_class(term: str) -> str:
    """What a generalised term becomes: one level above it."""
    return "ABBREVIATION" if len(term) <= 5 and term.isupper() else "NAME" if term[:1].isupper() else "WORD"


_ROW = "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, ctx array<struct<entity:long,term:long,window:long>>"
_CTX = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("window", pa.int64())]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_base(docs: DataFrame, reach: int = 5) -> DataFrame:
    """The patterns' spans and contexts of each row, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(2):
                text = t.as_py() or ""
                spans = base_spans(text)
                said = joined(spans)
                n = [0] * 5
                for _, k, _ in spans:
                    n[k] += 1
                row = (*n[:4], hashlib.sha256(said.encode()).hexdigest(), said, [dict(zip(("entity", "term", "window"), c)) for c in contexts(text, spans, reach)] if spans else [])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [_CTX]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols, kinds)], ["doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "ctx"])

    return _keyed(docs).mapInArrow(tidy(run), _ROW)


def _keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(cast(text as string)) th", "cast(text as string) text")


def _filter_bits(hashes: DataFrame, name: str, size: int) -> np.ndarray:
    """A bit for each slot of `size` that a hash falls into, packed by 64."""
    slot = F.pmod(F.col(name), F.lit(size))
    words = hashes.select(slot.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("m")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return bits.view(np.uint64)


def _terms_filter(terms: DataFrame) -> np.ndarray:
    """A filter of the terms' hashes (term): 1,024 slots a term, 2^26 at most, so that few other words pass."""
    n = terms.count()
    return _filter_bits(terms, "term", 1 << min(BLOOM_BITS[1], max(BLOOM_BITS[0], (1024 * n).bit_length()))) if n else np.zeros(0, np.uint64)


def _passing(filt: np.ndarray):
    """Function from a lower-cased word to its hash, or -1 where the filter doesn't know it."""
    size, known = 64 * len(filt), {}

    def of(w: str) -> int:
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = term_hash(w)
            p = h % size
            h = h if int(filt[p >> 6]) >> (p & 63) & 1 else -1
            if len(w) < 40:
                known[w] = h
        return h

    return of


def _texts_with(docs: DataFrame, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, texts): different texts that hold each term. copied: the hashes (th) of texts that stand in several rows.

    terms pass a filter of bounded size before they are counted; the exact join follows. Texts that a filter
    of 2^24 bits knows to stand once are counted in their task; others go by (term, th) and count once.
    """
    room = 1 << COPY_BITS
    bits = _terms_filter(terms)
    if not len(bits):
        return terms.select("term", F.lit(0).cast("long").alias("texts"))
    sent = docs.sparkSession.sparkContext.broadcast((bits, _filter_bits(copied, "th", room)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, again = sent.value
        hash_of = _passing(filt)
        for b in batches:
            total: dict[int, int] = {}
            term, th = [], []
            seen: set[int] = set()
            for t, x in zip(b.column(0), b.column(1).to_pylist()):
                if x in seen:
                    continue
                p = x % room
                single = not int(again[p >> 6]) >> (p & 63) & 1
                if not single:
                    seen.add(x)
                for w in {*_TERM.findall((t.as_py() or "").lower())}:
                    h = hash_of(w)
                    if h >= 0 and single:
                        total[h] = total.get(h, 0) + 1
                    elif h >= 0:
                        term.append(h)
                        th.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([*total, *term], pa.int64()), pa.array([None] * len(total) + th, pa.int64()), pa.array([*total.values(), *[1] * len(term)], pa.int64())], ["term", "th", "n"])

    found = docs.selectExpr("cast(text as string) text", "xxhash64(cast(text as string)) th").mapInArrow(tidy(run), "term long, th long, n long")
    once = found.groupBy("term", "th").agg(F.sum("n").alias("n")).select("term", F.when(F.col("th").isNull(), F.col("n")).otherwise(1).alias("n"))
    return terms.join(once.groupBy("term").agg(F.sum("n").alias("texts")), "term")


def disclosing(docs: DataFrame, base: DataFrame, support: int = 3, generalise: float = 0.6, remove: float = 0.9) -> DataFrame:
    """(entity, term, removed, alone), staged: the terms that give a value away; alone: without the value near them, too.

    base is find_base()'s staged table. A pair needs `support` different contexts.
    """
    ctx = base.where(F.size("ctx") > 0).select("th", F.explode("ctx").alias("c")).select("th", "c.*")
    pairs = ctx.groupBy("entity", "term", "window").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    pairs = staged(pairs)
    n_e = ctx.groupBy("entity", "window").agg(F.count("*").alias("n")).groupBy("entity").agg(F.count("*").alias("n_e"))
    texts_te = ctx.groupBy("entity", "term", "th").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("texts_te"))
    texts_e = ctx.groupBy("entity", "th").agg(F.count("*").alias("n")).groupBy("entity").agg(F.count("*").alias("texts_e"))
    sizes = staged(base.groupBy("th").agg(F.count("*").alias("n")))
    texts = _texts_with(docs, pairs.select("term").distinct(), sizes.where("n > 1").select("th"))
    n_all = F.lit(sizes.count()) - F.col("texts_e") + F.col("n_e")
    n_t = F.greatest(F.col("texts") - F.col("texts_te"), F.lit(0)) + F.col("n_te")
    ratio = F.log(F.col("n_te") * n_all / (n_t * F.col("n_e"))) / F.log(n_all / F.col("n_e"))
    every = pairs.join(texts_te, ["entity", "term"]).join(n_e.join(texts_e, "entity"), "entity").where(n_all > F.col("n_e"))
    shown = every.join(texts, "term").select("entity", "term", ratio.alias("ratio"), (2 * F.col("n_te") > n_t).alias("alone")).where(F.col("ratio") >= generalise)
    return staged(shown.select("entity", "term", (F.col("ratio") >= remove).alias("removed"), "alone"))


_TERMS = "array<struct<start:int,end:int,removed:boolean>>"


def places(docs: DataFrame, base: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc_id, th, terms): where the terms of disclosing() stand, but for places inside a base span."""
    schema = f"doc_id long, th long, terms {_TERMS}"
    bits = _terms_filter(shown.select("term").distinct())
    if not len(bits):
        return docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = _passing(sent.value)
        for b in batches:
            out: list[tuple] = []
            for d, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text, spans, k, until = t.as_py() or "", None, 0, 0
                for m in _TERM.finditer(text):
                    h = hash_of(m[0].lower())
                    if h < 0:
                        continue
                    spans = base_spans(text) if spans is None else spans
                    a, z = m.span()
                    while k < len(spans) and spans[k][0] < z:
                        until = max(until, spans[k][2])
                        k += 1
                    if until <= a:
                        out.append((d, th, h, a, z))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 2)], ["doc_id", "th", "term", "start", "end"])

    found = staged(_keyed(docs).mapInArrow(tidy(run), "doc_id long, th long, term long, start int, end int"))
    near = base.where(F.size("ctx") > 0).select("doc_id", "th", F.explode("ctx").alias("c")).select("doc_id", "th", "c.entity", "c.term").join(shown, ["entity", "term"])
    near = near.groupBy(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), F.col("term").alias("term_")).agg(F.bool_or("removed").alias("removed"))
    beside = found.join(near, found.doc_id.eqNullSafe(near.d_) & (found.th == near.t_) & (found.term == near.term_)).select(*found.columns, "removed")
    alone = found.join(shown.where("alone").groupBy("term").agg(F.bool_or("removed").alias("removed")), "term").select(*found.columns, "removed")
    per = beside.union(alone).groupBy("doc_id", "th", "start", "end").agg(F.bool_or("removed").alias("removed"))  # repeated rows have the same places
    return per.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))


def scan(docs: DataFrame, **thresholds) -> tuple[DataFrame, DataFrame]:
    """(base, terms), both staged: find_base's rows, and those of places()."""
    base = staged(find_base(docs))
    return base, staged(places(docs, base, disclosing(docs, base, **thresholds)))


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans: all spans of every row, and their number; term: a generalised term, removed: a removed one.

    A null or empty text has no spans. Repeated rows each get their row, a null doc_id stays null,
    rows of one doc_id with different texts are kept apart by a hash of the text; spans of different
    kinds may overlap, ties in start go by kind. An empty table yields no rows; other columns aren't read.
    A very long text is read in one piece, in time that grows with its length. Two scans of the texts, and a third where terms disclose values; no
    shuffle of texts: what is shuffled are terms near values, counts and the places of disclosing terms.
    """
    base, terms = scan(docs, **thresholds)
    extra = F.transform("terms", lambda s: F.struct(s.start.alias("s"), F.when(s.removed, 5).otherwise(4).alias("k"), F.format_string("%s:%d:%d", F.when(s.removed, "removed").otherwise("term"), s.start, s.end).alias("said")))
    parts = F.filter(F.split("base", ","), lambda x: x != "")
    ours = F.transform(parts, lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.when(x.startswith("email"), 0).when(x.startswith("ip"), 1).when(x.startswith("card"), 2).otherwise(3).alias("k"), x.alias("said")))
    every = F.array_sort(F.concat(ours, extra))
    got = base.join(terms, (base.doc_id.eqNullSafe(terms.doc_id)) & base.th.eqNullSafe(terms.th), "left").drop(terms.doc_id).drop(terms.th)
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_join(F.transform(every, lambda x: x.said), ","))
    number = F.size(parts).cast("long") + F.coalesce(F.array_size("terms"), F.lit(0))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), number.alias("n_spans"))


def masked(text: str, terms: list[dict] | None) -> str:
    """Values become their kind in brackets, terms their class in brackets or nothing; overlapping spans become one, under the first's name."""
    spans = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base_spans(text)]
    spans += [(t["start"], t["end"], "" if t["removed"] else f"[{term_class(text[t['start'] : t['end']])}]") for t in terms or ()]
    out, at = [], 0
    for s, e, name in sorted(spans):
        if s >= at:
            out += text[at:s], name
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with its own columns, text masked; n_chars, where there is one, follows the text. Null texts stay null."""
    _, terms = scan(docs, **thresholds)
    cols = docs.columns
    t = terms.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), F.col("terms").alias("terms_"))
    own = small_batches(docs).select(F.struct(*cols).alias("row_"), F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.col("text").cast("string")).alias("h_"))
    both = own.join(t, F.col("id_").eqNullSafe(F.col("d_")) & (F.col("h_") == F.col("t_")), "left").select("row_.*", "terms_")
    where = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(where).to_pylist()
            new = [t if t is None else masked(t, s) for t, s in zip(texts, b.column(len(cols)).to_pylist())]
            arrays = [b.column(i) for i in range(len(cols))]
            arrays[where] = pa.array(new, pa.string())
            if "n_chars" in cols:
                i = cols.index("n_chars")
                arrays[i] = pa.array([old if t == n else len(n) for t, n, old in zip(texts, new, arrays[i].to_pylist())], arrays[i].type)
            yield pa.RecordBatch.from_arrays(arrays, cols)

    return both.mapInArrow(tidy(run), docs.schema)
