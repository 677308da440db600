"""BPE encoding and decoding with a backtracking encoder.

A text is normalised and cut into pieces as the tokenizer file says. Each piece is encoded by
itself: an Aho-Corasick automaton over all tokens finds, in one pass, the tokens that start at
each position; the encoder takes the longest and steps back when two neighbours could not stand
side by side after BPE's merges. That test is a table over token pairs, filled when a pair is
first met. A tokenisation whose neighbours are all compatible is the one that merging in rank
order gives, and every position is left at most once for good, so the time is linear.
Decoding reads each token's string through an offset table into one byte blob.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridlens.llm.common import small_batches, tidy

END = 0x10000  # added to the code point of a piece's last unit
_RARE = regex.compile("[^\x00-\u024f]")  # up to there NFC changes nothing and all versions of Unicode agree
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")


# The normaliser and the cuts, as tokenizer files state them, that _CUT stands for. Texts go by the library's own where a file states others.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def refuse(why: str) -> None:
    raise ValueError(f"this encoder can't follow the tokenizer file: {why}")


def byte_units() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Known(dict):
    """What `find` gives, kept for pieces of ordinary length; in two generations of `room`, so that frequent ones stay."""

    def __init__(self, find: Callable[[str], str], room: int):
        super().__init__()
        self.find, self.room, self.old = find, room, {}

    def __missing__(self, p: str) -> str:
        got = self.old.get(p) or self.find(p)
        if len(p) <= 32:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[p] = got
        return got


class Codec:
    """Tables of one tokenizer file (its JSON text), and the encoder over them.

    The file must hold byte-level BPE with "</w>" at word ends, without a decoder; a ValueError says what else it asks for.
    """

    def __init__(self, spec: bytes, room: int = 100_000):
        d = json.loads(spec)
        model = d["model"]
        if model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
            refuse("words must end in </w>, and pieces have no prefix")
        if any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges")):
            refuse("merges must be plain")
        if d.get("decoder") or d.get("post_processor"):
            refuse("it names a decoder or a post-processor")
        if any(a[k] for a in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            refuse("added tokens must stand for their very strings")
        if (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[-1].get("type") != "ByteLevel":
            refuse("pieces must end as bytes")
        self.plain = d["normalizer"] == _NORMALISER and d["pre_tokenizer"] == _PIECES
        vocab: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.mark = os.path.commonprefix(list(self.special))
        self.units = byte_units()
        self.merges: dict[tuple[int, int], int] = {}
        self.base: dict[str, int] = {}
        form: dict[int, str] = {}
        for u in self.units:
            self.base[u], self.base[chr(END + ord(u))] = vocab[u], vocab[u + "</w>"]
        form.update({i: u for u, i in self.base.items()})
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merges[i, j] = k
            form[k] = form[i] + form[j]
            if k != len(self.base) + rank:
                refuse("ids must follow the merges' ranks")
        self.form = form
        self.automaton = ahocorasick.Automaton()
        for i, f in form.items():
            self.automaton.add_word(f, (len(f), i))
        self.automaton.make_automaton()
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        table = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.ids = {f: i for i, f in form.items()}
        self.prefix: dict[int, tuple[int, int] | None] = {}
        self.parts = {k: p for p, k in self.merges.items()}
        self.sound: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.room = room
        self.known = Known(self.piece, room)
        self.decimal = [str(i) for i in range(len(form))]
        self.unit_of = dict(enumerate(self.units))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spec = spec

    @cached_property
    def library(self):
        """The tokenizers library's own object: for its Unicode tables only, and only once a text needs them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.spec)

    # -- pieces ---------------------------------------------------------------------------------
    def pieces(self, part: str) -> list[str]:
        """Normalised pieces of a text without special tokens. Rare letters, and files with other cuts, go by the library's own tables."""
        if self.plain and not _RARE.search(part):
            return _CUT.findall(part.lower())
        clean = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
        back = {u: b for b, u in enumerate(self.units)}
        return [bytes(back[u] for u in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    # -- encoding -------------------------------------------------------------------------------
    def merged(self, units: str) -> list[int]:
        """Plain BPE: merge the lowest rank until none is left. What the tests hold the encoder against."""
        ids = [self.base[u] for u in units]
        while len(ids) > 1:
            k = min((self.merges.get(p, 1 << 30) for p in zip(ids, ids[1:])), default=1 << 30)
            if k == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merges.get((ids[i], ids[i + 1])) == k:
                    out.append(k)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def joins(self, left: int, right: int, until: int) -> bool:
        """Whether BPE would merge across the border of two tokens before `until`.

        A merge's rank is its time, as a token's id is higher than its parts'. Going back in time, the tokens at
        the border are the last parts of `left` and the first parts of `right`; a pair of them merges if that comes before either is
        merged into its own token. Of equal merges the one further left comes first.
        """
        ends_l = ends_r = until
        while True:
            k = self.merges.get((left, right))
            if k is not None and k < ends_l and k <= ends_r and k < until:
                return True
            if left > right:
                if left not in self.parts:
                    return False
                ends_l, left = left, self.parts[left][1]
            else:
                if right not in self.parts:
                    return False
                ends_r, right = right, self.parts[right][0]

    def whole(self, token: int) -> bool:
        """Whether merging gives this token for its own string."""
        ok = self.sound.get(token)
        if ok is None:
            a, b = self.parts.get(token, (-1, -1))
            ok = self.sound[token] = a < 0 or (self.whole(a) and self.whole(b) and not self.joins(a, b, token))
        return ok

    def fits(self, before: int, token: int) -> bool:
        """Whether merging keeps `token` whole right after `before` (-1: at the start)."""
        if len(self.pairs) > 2 * self.room:
            self.pairs.clear()
        ok = self.pairs[(before + 1) << 20 | token] = self.whole(token) and (before < 0 or not self.joins(before, token, 1 << 30))
        return ok

    def shorter(self, token: int) -> tuple[int, int] | None:
        """(length, id) of the longest token that is a proper prefix of this one."""
        if token not in self.prefix:
            f = self.form[token]
            self.prefix[token] = next(((n, self.ids[f[:n]]) for n in range(len(f) - 1, 0, -1) if f[:n] in self.ids), None)
        return self.prefix[token]

    def encode_units(self, units: str) -> list[int]:
        """The one tokenisation whose neighbours all fit; by the longest token first, stepping back at dead ends."""
        n, at, out, dead = len(units), 0, [], bytearray(len(units) + 1)
        longest: list = [None] * n
        for end, hit in self.automaton.iter(units):
            longest[end - hit[0] + 1] = hit  # longer ones end later
        pairs, fits = self.pairs, self.fits
        before = -1
        hit = longest[0]
        while True:
            while hit:
                size, token = hit
                if not dead[at + size] and (ok if (ok := pairs.get((before + 1) << 20 | token)) is not None else fits(before, token)):
                    break
                hit = self.shorter(token)
            if hit:
                out.append(hit)
                at += size
                if at == n:
                    return [i for _, i in out]
                before, hit = token, longest[at]
            else:
                dead[at] = 1
                size, token = out.pop()
                at -= size
                before = out[-1][1] if out else -1
                hit = self.shorter(token)

    def piece(self, p: str) -> str:
        """Ids of one piece, as decimal text."""
        units = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.unit_of)
        ids = self.encode_units(units[:-1] + chr(END + ord(units[-1])))
        return " ".join([self.decimal[i] for i in ids])

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimal text."""
        if not text:
            return np.empty(0, np.int64), ""
        said: list[str] = []
        parts = self.split_special.split(text) if self.split_special and self.mark in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                said.append(str(self.special[part]))
            elif part:
                said += map(self.known.__getitem__, self.pieces(part))
        all_ = " ".join(said)
        return np.fromstring(all_, np.int64, sep=" "), all_

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' strings joined by one space (the file names no decoder)."""
        if not len(ids):
            return b""
        out = []
        for k in range(0, len(ids), 200_000):
            part = ids[k : k + 200_000]
            at = self.offsets[part]
            size = self.offsets[part + 1] - at
            where = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append(self.blob[where].tobytes())
        return b"".join(out)[:-1]


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; on request ids (array<int>) and decoded (string).

    A null or empty text has no tokens: 0, and the hashes of the empty string. A repeated row is
    encoded again and yields its own row; a null doc_id stays null; an empty table yields no rows.
    Other columns aren't read, whatever their names. The file is read on the driver (a parameter
    of fixed size) and broadcast; texts are encoded where they lie, without a shuffle.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(spec.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                cols: dict[str, list] = {name: [] for name, _ in fields}
                for text in map(lambda t: t.as_py(), b.column(1)):
                    ids, said = c.encode(text)
                    back = c.decode(ids)
                    cols["n_tokens"].append(len(ids))
                    cols["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                    cols["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        cols["ids"].append(ids.astype(np.int32))
                    if with_text:
                        cols["decoded"].append(back.decode())
                cols["doc_id"] = b.column(0)
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) if n != "doc_id" else cols[n] for n, t in fields], [n for n, _ in fields])

    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), ddl)
