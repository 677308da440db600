"""Quality rules by document and by host.

Rules judge each document by itself. Their failures are then counted by host (the document's
source); each host's failure rate is shrunk towards a beta prior fitted to all hosts by the
method of moments, and a host whose shrunk rate is over the limit loses all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import grams, groups_of, mix, small_batches, staged, tidy, WordHashes, words_of

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
WINDOW = 5


def repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By document, the words in WINDOW-word windows that the document has twice or more. h: word hashes, doc: each word's document."""
    g = grams(h, WINDOW)
    if not len(g):
        return np.zeros(n_docs, np.int64)
    inside = doc[: len(g)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    key = g[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    hit = at[twice[:-1]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=n_docs)


def line_repeats(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to (key..., text); drops the text."""
    hashes = WordHashes()
    for b in batches:
        texts = b.column(b.num_columns - 1)
        for i, j in groups_of(texts, 2_000_000):
            part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
            words = [words_of(t) for t in part]
            n = np.array([len(w) for w in words], np.int64)
            h = np.concatenate([hashes.of(w) for w in words]) if n.sum() else np.empty(0, np.uint64)
            doc = np.repeat(np.arange(len(part)), n)
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(k).slice(i, j - i) for k in range(b.num_columns - 1)],
                    pa.array(n),
                    pa.array([len(t) - sum(map(t.count, SPACES)) for t in part], pa.int64()),
                    pa.array([sum(map(t.count, SYMBOLS[1:-1])) for t in part], pa.int64()),
                    pa.array([line_repeats(t) for t in part], pa.int64()),
                    pa.array(repeated_words(h, doc, len(part)), pa.int64()),
                ],
                ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )


def judge(docs: DataFrame, least_words: int = 10, most_repeat: int = 20, most_host: float = 0.5, weak_prior: float = 10.0) -> DataFrame:
    """doc_id, source, the measures, base_failed, kept, host_docs, host_failed.

    base_failed: under least_words words, or over most_repeat percent of words in repeated windows.
    A host is dropped if (failures + a) / (documents + a + b) > most_host; a and b are fitted to the
    hosts' rates (mean m, sample variance v: a + b = m (1 - m) / v - 1; weak_prior where v is 0,
    unknown, or too large for a beta). A null text has no words and fails; a null source is a host of
    its own; a null doc_id and repeated rows stay and count as rows; an empty table yields no rows.
    A very long text is measured whole, by itself, in one task. Other columns aren't read. The measures are written once to the shared folder; both the count by
    host, which is combined before its shuffle, and the documents read them from there. A hot host
    is one row of the counts; AQE splits its documents if the counts are too large to broadcast.
    """
    ddl = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    m = staged(small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(source as string) source", "cast(text as string) text").mapInArrow(tidy(measures), ddl))
    m = m.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words")))
    hosts = m.groupBy("source").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m_, v = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    k = max(m_ * (1 - m_) / v - 1, 0.0) if v else 0.0
    k = k or weak_prior
    shrunk = (F.col("host_failed") + (m_ or 0.0) * k) / (F.col("host_docs") + k)
    verdict = hosts.select(F.col("source").alias("host"), "host_docs", "host_failed", (shrunk <= most_host).alias("host_kept"))
    return m.join(verdict, m.source.eqNullSafe(verdict.host), "left").select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_docs", "host_failed",
    )
