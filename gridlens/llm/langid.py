"""Language identification as inference of a mixture.

Each language has likelihoods of character n-grams inside words. A document is a mixture: every
word belongs to one language, and expectation-maximisation finds the proportions that explain its
words best. Languages enter in the order of their shares in the full mixture; the set that
maximises log-likelihood minus a penalty for each language is kept, and the language with the
largest share in that set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import groups_of, mix, small_batches, tidy

BITS = 17
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, a space after each; and the text of each."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])


def word_grams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words: (feature, word), and each word's first position. Three n-grams end at each letter: 1 to 3 long, word starts marked."""
    c = np.where(letters()[cp], cp, 0).astype(np.uint64)
    at = np.flatnonzero(c)
    before = np.concatenate([np.zeros(2, np.uint64), c])  # before[i + 2] is c[i]
    first = np.concatenate([[True], c[:-1] == 0])[at]
    word = np.cumsum(first) - 1
    one, two = before[at + 2], before[at + 1]
    three = np.where(two == 0, np.uint64(0), before[at])
    bi = mix((two * np.uint64(0x110000) + one) * np.uint64(4) + np.uint64(1))
    tri = mix(((three * np.uint64(0x110000) + two) * np.uint64(0x110000) + one) * np.uint64(4) + np.uint64(2))
    last = np.concatenate([c[1:] == 0, [True]])[at]
    end = mix((two * np.uint64(0x110000) + one) * np.uint64(4) + np.uint64(3))[last]
    shift = np.uint64(64 - BITS)
    feats = np.concatenate([bi >> shift, tri >> shift, end >> shift]).astype(np.int64)
    return feats, np.concatenate([word, word, word[last]]), at[first]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (2 ** BITS, languages), float32


def fit(docs: DataFrame, per_lang: int = 2000, most_langs: int = 256, smoothing: float = 0.2) -> Model:
    """Likelihoods from at most about per_lang labelled documents of each language.

    Every lang value is learnt; a table with more than most_langs of them is refused with a ValueError, as a
    model of that size (0.5 MB a language) would not fit the workers. Learnt from are documents with a text and a non-null lang whose
    crc32(doc_id as text) mod 3 isn't 1; a null doc_id counts as held out. The sample is a threshold
    on a hash of doc_id, so no rows of one language meet in a task; counts are added up by hashed
    feature in each task before their shuffle, and the table that reaches the driver has 2^17 cells a language.
    """
    rows = small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(lang as string) lang", "cast(text as string) text").where(
        "lang is not null and text is not null and not coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, true)"
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} lang values; none is dropped, so raise most_langs or clean the column")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    sample = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def rows_of() -> Iterator[pa.RecordBatch]:
            for k, v in total.items():
                if (at := np.flatnonzero(v)).size:
                    yield pa.RecordBatch.from_arrays([pa.array([langs.index(k)] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(v[at])], ["l", "f", "n"])
            total.clear()

        for b in batches:
            for i, j in groups_of(b.column(1), 500_000):
                lang, text = (b.column(k).slice(i, j - i).to_pylist() for k in (0, 1))
                for k in set(lang):
                    if k not in total and len(total) >= 64:
                        yield from rows_of()
                    feats, _, _ = word_grams(code_points([t for t, x in zip(text, lang) if x == k])[0])
                    total[k] = total.get(k, 0) + np.bincount(feats, minlength=1 << BITS)
        yield from rows_of()

    got = sample.mapInArrow(tidy(count), "l int, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow()
    l, f, n = (got.column(k).to_numpy() for k in ("l", "f", "n"))
    seen = max(1, len(np.unique(f)))
    logp = np.empty((1 << BITS, len(langs)), np.float32)
    for k in range(len(langs)):
        own = np.zeros(1 << BITS)
        own[f[l == k]] = n[l == k]
        logp[:, k] = np.log((own + smoothing) / (own.sum() + smoothing * seen))
    return Model(langs, logp)


WORDS = 200_000  # that are worked on at once
PIECE = 400_000  # characters of a long text, about


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _by_doc(like: np.ndarray, doc: np.ndarray, out: np.ndarray, of) -> np.ndarray:
    """out plus of(words' likelihoods, their documents), added up by document, some words at a time."""
    for a in range(0, len(doc), WORDS):
        d = doc[a : a + WORDS]
        at = _runs(d)
        out[d[at]] += np.add.reduceat(of(like[a : a + WORDS], d), at, axis=0)
    return out


def em(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = 25, settled: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document. like: words x languages (scaled by each word's best), words sorted by document."""
    n_docs, n = allowed.shape[0], np.diff(np.append(starts, len(doc)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    live = np.arange(n_docs)
    w_like, w_doc, w_n = like, doc, n

    def parts(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        resp = x * share[live][d]
        return resp / np.maximum(resp.sum(axis=1, keepdims=True), 1e-30)

    for r in range(rounds):
        new = _by_doc(w_like, w_doc, np.zeros((len(live), like.shape[1])), parts) / w_n[:, None]
        moved = np.abs(new - share[live]).max(axis=1) > settled
        share[live] = new
        if not moved.any():
            break
        if moved.mean() < 0.7:  # go on with the words of unsettled documents
            live = live[moved]
            keep = np.repeat(moved, w_n)
            w_like, w_n = w_like[keep], w_n[moved]
            w_doc = np.repeat(np.arange(len(live)), w_n)
    return share, _by_doc(like, doc, np.zeros(n_docs), lambda x, d: np.log(np.maximum((x * share[d]).sum(axis=1), 1e-30)))


def pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """(parts of texts, the texts they are of) of about PIECE characters in all; long texts are cut where no word is."""
    out: list[str] = []
    owner: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            end = min(len(t), at + PIECE)
            while end < len(t) and (t[end - 1].isalpha() and t[end].isalpha()):
                end += 1
            if out and size + end - at > PIECE:
                yield out, owner
                out, owner, size = [], [], 0
            out.append(t[at:end])
            owner.append(k)
            size += end - at
            at = max(end, 1)
    if out:
        yield out, owner


def mixtures(texts: list[str], model: Model, penalty: float) -> np.ndarray:
    """Language proportions by text (rows of zeros where a text has no letter)."""
    L = len(model.langs)
    out = np.zeros((len(texts), L))
    likes, docs_, alone = [], [], np.zeros((len(texts), L))
    for part, owner_ in pieces(texts) if L else ():
        cp, owner = code_points(part)
        feats, word, first = word_grams(cp)
        if not len(first):
            continue
        ll = np.empty((len(first), L))
        for k in range(L):
            ll[:, k] = np.bincount(word, model.logp[feats, k], len(first))
        ll = np.maximum(ll - ll.max(axis=1, keepdims=True), -60)
        d = np.array(owner_)[owner[first]]
        at = _runs(d)
        alone[d[at]] += np.add.reduceat(ll, at, axis=0)  # one language alone
        likes.append(np.exp(ll).astype(np.float32))
        docs_.append(d)
    if not likes:
        return out
    like, doc_id = np.concatenate(likes), np.concatenate(docs_)
    del likes, docs_
    starts = _runs(doc_id)
    ids = doc_id[starts]
    doc = np.repeat(np.arange(len(ids)), np.diff(np.append(starts, len(doc_id))))
    cost = penalty * np.log(np.bincount(doc) + 1.0)
    ll1 = alone[ids]
    best1 = ll1.argmax(axis=1)
    chosen = np.zeros((len(ids), L))
    chosen[np.arange(len(ids)), best1] = 1
    score = ll1.max(axis=1) - cost
    full, top = em(like, doc, starts, np.ones((len(ids), L)))
    # No set can gain more than the full mixture does, so a document whose gain can't pay a second language is done.
    open_ = np.flatnonzero(top - 2 * cost > score)
    rank = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, L + 1):
        if not len(open_):
            break
        keep = np.isin(doc, open_)
        n = np.bincount(doc, minlength=len(ids))[open_]
        allowed = np.zeros((len(open_), L))
        np.put_along_axis(allowed, rank[open_, :size], 1, axis=1)
        share, fit_ = em(like[keep], np.repeat(np.arange(len(open_)), n), np.cumsum(n) - n, allowed)
        gained = fit_ - size * cost[open_] > score[open_]
        chosen[open_[gained]] = share[gained]
        score[open_[gained]] = (fit_ - size * cost[open_])[gained]
        open_ = open_[top[open_] - (size + 1) * cost[open_] > score[open_]]
    out[ids] = chosen
    return out


def identify(docs: DataFrame, model: Model, penalty: float = 2.0) -> DataFrame:
    """doc_id, lang_pred, score, mixture (map of language to proportion).

    lang_pred is the language with the largest proportion in the chosen set (ties: first by code
    point), score its proportion. A null text, one without a letter, and any text where no language
    was learnt are 'und' with score 0 and an empty mixture. Repeated rows each get their row; an
    empty table yields none. Only doc_id and text are read: lang and source can't leak in.
    Long texts are read whole, in pieces, of which 4 bytes a word and language stay; no shuffle; the model's size is fixed and broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            texts = b.column(1)
            for i, j in groups_of(texts, 400_000 * 64 // max(64, len(m.langs))):
                share = mixtures([t or "" for t in texts.slice(i, j - i).to_pylist()], m, penalty)
                best = share.argmax(axis=1) if m.langs else np.zeros(j - i, int)
                none = share.sum(axis=1) == 0
                pred = ["und" if z else m.langs[k] for k, z in zip(best, none)]
                top = [0.0 if z else float(min(1.0, share[r, k])) for r, (k, z) in enumerate(zip(best, none))]
                maps = [[(m.langs[k], float(v)) for k, v in enumerate(row) if v > 0.005] for row in share]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(top), pa.array(maps, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, mixture map<string,double>")


def accept(docs: DataFrame, model: Model, least: float = 0.25, penalty: float = 2.0) -> DataFrame:
    """docs' rows, with their own columns, less those that are 'und': a null text, one without a letter, all where no language was learnt. A null lang becomes the prediction.

    A share of at least `least` is asked for, too, but where at most 1 / least languages are learnt the largest
    share always is. Shares compare the learnt languages with each other only: a text in one that wasn't learnt, or
    letters at random, gets the nearest learnt language and stays.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))
    cols = docs.columns
    text, lang = cols.index("text"), cols.index("lang") if "lang" in cols else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            texts = b.column(text)
            for i, j in groups_of(texts, 400_000 * 64 // max(64, len(m.langs))):
                share = mixtures([t or "" for t in texts.slice(i, j - i).to_pylist()], m, penalty)
                top = share.max(axis=1, initial=0)
                part = b.slice(i, j - i)
                if lang is not None and m.langs:
                    best = share.argmax(axis=1)
                    named = pa.array([v if v is not None else m.langs[k] for v, k in zip(part.column(lang).to_pylist(), best)], part.column(lang).type)
                    part = pa.RecordBatch.from_arrays([named if k == lang else part.column(k) for k in range(len(cols))], cols)
                yield part.filter(pa.array(top >= max(least, 1e-9)))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def held_out(doc_id=None):
    d = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(d.cast("string").cast("binary")) % 3 == 1, F.lit(False))
