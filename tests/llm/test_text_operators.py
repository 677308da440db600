"""Language ID, BPE, quality rules and PII against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlens.llm import bpe, langid, pii, quality, queries
from tests.conftest import DATA
from tests.llm.conftest import DOCS

Q = queries.queries()


# -- language ID --------------------------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    got = Q["op1_language_id"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    import zlib

    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(docs)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    test = both[both.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def test_mixture_em_and_selection(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = langid.fit(docs)
    en, de = (" ".join(r.text for r in docs.where(f"lang = '{k}'").limit(5).collect())[:4000] for k in ("en", "de"))
    share = langid.mixtures([en, de, en[:3000] + " " + de[:3000], "", "12 34"], m, 2.0)
    e, d = m.langs.index("en"), m.langs.index("de")
    assert share[0, e] > 0.95 and share[1, d] > 0.95
    assert 0.3 < share[2, e] < 0.7 and 0.3 < share[2, d] < 0.7
    assert (share[3:] == 0).all()


def test_em_reaches_the_likeliest_proportions():
    import numpy as np

    rng = np.random.default_rng(1)
    like = rng.random((300, 2)) + 0.01
    share, ll = langid.em(like, np.zeros(300, int), np.array([0]), np.ones((1, 2)), rounds=500, settled=1e-7)
    grid = np.linspace(0.001, 0.999, 999)
    want = max(grid, key=lambda p: np.log(like @ np.array([p, 1 - p])).sum())
    assert abs(share[0, 0] - want) < 2e-3


def plain_mixture(text, m, penalty):
    """Word by word from the definition: nested sets by share in the full mixture, penalised likelihood."""
    import numpy as np

    rows = []
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        feats, _, _ = langid.word_grams(langid.code_points([w])[0])
        ll = m.logp[feats].astype(float).sum(axis=0)
        rows.append(np.exp(np.maximum(ll - ll.max(), -60)))
    if not rows:
        return np.zeros(len(m.langs))
    like, n = np.array(rows), len(rows)

    def fit(allowed):
        share = allowed / allowed.sum()
        for _ in range(25):
            resp = like * share
            new = (resp / np.maximum(resp.sum(axis=1, keepdims=True), 1e-30)).mean(axis=0)
            done = np.abs(new - share).max() <= 2e-3
            share = new
            if done:
                break
        return share, np.log(np.maximum(like @ share, 1e-30)).sum()

    cost = penalty * np.log(n + 1)
    alone = np.log(like).sum(axis=0)
    best, score = np.eye(len(m.langs))[alone.argmax()], alone.max() - cost
    order = np.argsort(-fit(np.ones(len(m.langs)))[0], kind="stable")
    for k in range(2, len(m.langs) + 1):
        allowed = np.zeros(len(m.langs))
        allowed[order[:k]] = 1
        share, ll = fit(allowed)
        if ll - k * cost > score:
            best, score = share, ll - k * cost
    return best


def test_mixtures_equal_a_plain_version(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = langid.fit(docs)
    texts = [r.text or "" for r in docs.limit(60).collect()]
    texts += [a[:300] + " " + b[:300] for a, b in zip(texts, texts[7:])]
    want = [plain_mixture(t, m, 2.0) for t in texts]
    got = langid.mixtures(texts, m, 2.0)
    assert abs(got - want).max() < 1e-3
    monkeypatch.setattr(langid, "PIECE", 50)
    monkeypatch.setattr(langid, "WORDS", 7)
    assert abs(langid.mixtures(texts, m, 2.0) - got).max() < 1e-3


def test_language_of_a_very_long_text(spark):
    """Tens of MB in one text, in bounded memory."""
    import tracemalloc

    m = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    text = "the other thing is what they said and then some more of it " * 400_000
    tracemalloc.start()
    share = langid.mixtures([text], m, 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert share.shape == (1, len(m.langs)) and share.sum() > 0.99 and peak < 700_000_000


def test_every_language_is_learnt(spark):
    letter = [chr(0x4E00 + 50 * k) for k in range(70)]
    rows = [(1000 * k + i, " ".join(letter[k] * (1 + i % 3) for _ in range(8)), f"x{k:02d}", "s", 8) for k in range(70) for i in range(3 if k == 69 else 6)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    assert model.langs == [f"x{k:02d}" for k in range(70)]
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {r[0]: r[2] for r in rows}
    with pytest.raises(ValueError, match="more than 69 lang values"):
        langid.fit(docs, most_langs=69)


def test_no_leak_from_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = langid.fit(docs)
    a = langid.identify(docs, m).select("doc_id", "lang_pred").toPandas().sort_values("doc_id")
    b = langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), m).select("doc_id", "lang_pred").toPandas().sort_values("doc_id")
    assert (a.values == b.values).all()


def test_language_hard_rows(spark, hard, none, wider):
    m = langid.fit(hard)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(wider(hard), m).collect()}
    assert {(1, "und"), (2, "und"), (4, "und"), (None, "und")} <= got
    assert langid.identify(hard, m).count() == 11
    assert langid.identify(none, m).count() == langid.accept(none, m).count() == 0
    nothing = langid.fit(none)
    assert {(r.lang_pred, r.score) for r in langid.identify(hard, nothing).collect()} == {("und", 0.0)}
    kept = langid.accept(hard, m)
    assert kept.columns == hard.columns and kept.where("lang IS NULL").count() == 0 and kept.where("doc_id IN (1, 2, 4)").count() == 0


# -- BPE ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def spec():
    with open(queries.tokenizer_path(), "rb") as f:
        return f.read()


def test_codec_equals_the_library(spec):
    from tokenizers import Tokenizer

    c, t = bpe.Codec(spec, room=500), Tokenizer.from_buffer(spec)
    rnd = random.Random(7)
    texts = ["", "<|startoftext|>Hello<|endoftext|> wOrld's I'LL", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ é", "a\x1cb\x85c\xa0d", "ab" * 3000, "aaaa" * 500, "½²x²", "😀日本語12", "don't're''s'd", "<|endoftext", "\x00\x07\x7f"]
    for _ in range(1500):
        top = rnd.choice([0x7F, 0x24F, 0x3000, 0x10FFFF])
        texts.append("".join(chr(x) for x in (rnd.randint(0, top) for _ in range(rnd.randint(0, 40))) if not 0xD800 <= x <= 0xDFFF))
        texts.append("".join(rnd.choice("abcdeéèthinger' .") for _ in range(rnd.randint(0, 80))))
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        ids, said = c.encode(x)
        assert ids.tolist() == want and said == " ".join(map(str, want))
        assert c.decode(ids).decode() == t.decode(want, skip_special_tokens=False)


def test_codec_follows_or_refuses_other_files(spec):
    import json

    from tokenizers import Tokenizer

    assert bpe.Codec(spec).plain
    other = json.loads(spec)
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]{1,3}|[^\s\p{L}]"  # pieces of three letters
    other["added_tokens"][0]["content"] = "[start]"
    own = json.dumps(other).encode()
    c, t = bpe.Codec(own), Tokenizer.from_buffer(own)
    for x in ["", "The quick brown fox's 123 jumps", "[start]Hello<|endoftext|>", "straße İ 日本語"]:
        want = t.encode(x, add_special_tokens=False).ids
        ids, _ = c.encode(x)
        assert not c.plain and ids.tolist() == want and c.decode(ids).decode() == t.decode(want, skip_special_tokens=False)
    for change in ({"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}, {"pre_tokenizer": None}, {"model": other["model"] | {"end_of_word_suffix": None}}, {"model": other["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(other | change).encode())
    with open(queries.tokenizer_path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.Codec(f.read())


def test_backtracking_equals_merging(spec):
    c = bpe.Codec(spec)
    rnd = random.Random(3)
    for _ in range(400):
        units = "".join(rnd.choice("theingaorstlnd") for _ in range(rnd.randint(1, 25)))
        units = units[:-1] + chr(bpe.END + ord(units[-1]))
        assert c.encode_units(units) == c.merged(units)


def test_pair_table_equals_merging(spec):
    c, rnd = bpe.Codec(spec), random.Random(2)
    every = sorted(c.form)
    inner = [i for i in every if ord(c.form[i][-1]) < bpe.END]
    for k in range(8000):
        a, b = rnd.choice(inner[: 3000 if k % 2 else None]), rnd.choice(every[: 4000 if k % 3 else None])
        if c.whole(a):
            assert c.fits(a, b) == (c.merged(c.form[a] + c.form[b]) == [a, b])
    assert all(c.whole(t) == (c.merged(c.form[t]) == [t]) for t in rnd.sample(every, 2000))


def test_op2(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in Q["op2_bpe"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_hard_rows(hard, none, wider):
    got = bpe.encode_documents(wider(hard), queries.tokenizer_path(), with_ids=True, with_text=True).collect()
    assert len(got) == 11 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert max(r.n_tokens for r in got) == 40_000
    assert bpe.encode_documents(none, queries.tokenizer_path()).count() == 0


# -- quality ------------------------------------------------------------------------------------
def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_op9(spark):
    got = {r.doc_id: r for r in Q["op9_quality_rules"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        g, want = got[r.doc_id], plain_measures(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g.kept and g.base_failed)
    assert sum(not g.kept for g in got.values()) < 0.2 * len(got)


def test_hosts_are_shrunk(spark):
    good, bad = "a b c d e f g h i j k l", "x"
    rows = [(i, bad, "en", "rotten", 1) for i in range(60)] + [(99, good, "en", "rotten", 1)]
    rows += [(100 + i, good if i % 20 else bad, "en", f"h{i % 7}", 1) for i in range(140)] + [(300, bad, "en", "tiny", 1), (301, good, "en", None, 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[99].base_failed and not got[99].kept
    assert all(g.kept == (not g.base_failed) for i, g in got.items() if i >= 100)


def test_quality_hard_rows(hard, none, wider):
    got = quality.judge(wider(hard)).collect()
    assert len(got) == 11 and {r.n_words for r in got if r.doc_id in (1, 2)} == {0}
    assert {(r.n_words, r.n_repeat_words) for r in got if r.doc_id == 9} == {(40_000, 40_000)}
    assert quality.judge(none).count() == 0


# -- PII ----------------------------------------------------------------------------------------
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_plain_ones():
    rnd = random.Random(3)
    for _ in range(20_000):
        letters = rnd.choice(["a@.b-1 ", "0123456789 -", "+1 ().-2", "1.2.255.", "ab@c.d@e.f%", "é1@a.b\n"])
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        assert plain_spans(t) == pii.base_spans(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "1 " * 150_000, "+1(" * 50_000, "a@b" * 100_000, "9" * 5000 + ".1.1.1"):
        pii.base_spans(t)


def test_op7(spark):
    got = {r.doc_id: r for r in Q["op7_pii"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        spans = plain_spans(r.text or "")
        g, n = got[r.doc_id], Counter(k for _, k, _ in spans)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(n[k] for k in range(4))
        said = pii.joined(spans)
        assert g.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x for x in g.spans.split(",") if x and not x.startswith(("term", "removed"))] == [x for x in said.split(",") if x]
        assert spans or not g.spans  # clean documents are left alone
        assert g.n_spans == len(g.spans.split(",") if g.spans else [])


def disclosing(spark):
    rows = [(i, f"w{chr(97 + i) * 3} then Zorbatron at jane@x.example.com and {chr(98 + i) * 4} once", "en", "s", 60) for i in range(6)]
    rows += [(100 + i, "then and once at some other place", "en", "s", 30) for i in range(30)]
    rows += [(200 + i, "copied Quibble near joe@y.example.com every time", "en", "s", 40) for i in range(9)]
    return spark.createDataFrame(rows, DOCS)


def test_terms_that_reveal(spark):
    docs = disclosing(spark)
    got = {r.doc_id: r.spans.split(",") for r in pii.find(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for i in range(6):
        terms = {text[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i]) if k in ("term", "removed")}
        assert "Zorbatron" in terms and not terms & {"then", "and", "once", "at"}
    assert all(got[100 + i] == [""] for i in range(30))
    assert all(len(got[200 + i]) == 1 for i in range(9)), "copies are one context, not nine"
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert all("Zorbatron" not in clean[i].text and "[EMAIL]" in clean[i].text and clean[i].n_chars == len(clean[i].text) for i in range(6))
    assert clean[100].text == text[100] and clean[100].n_chars == 30


def plain_terms(docs, support=3, generalise=0.6, remove=0.9, reach=5):
    """({term: removed} for all documents, {(text, term): removed} for those with the value), straight from the definition."""
    from math import log

    contexts, texts = {}, {t for t in docs if t is not None} | ({""} if None in docs else set())
    holds = {t: {m[0].lower() for m in pii._TERM.finditer(t)} for t in texts}
    for t in texts:
        spans = plain_spans(t)
        terms = [m.span() for m in pii._TERM.finditer(t) if not any(m.start() < e and s < m.end() for s, _, e in spans)]
        for s, k, e in spans:
            near = [t[a:z].lower() for a, z in [x for x in terms if x[1] <= s][-reach:] + [x for x in terms if x[0] >= e][:reach]]
            if near:
                contexts.setdefault((k, t[s:e].lower()), []).append((tuple(near), t))
    out, beside = {}, {}
    for found in contexts.values():
        n_e, texts_e = len({c for c, _ in found}), len({t for _, t in found})
        for w in {w for c, _ in found for w in c}:
            n_te, texts_te = len({c for c, _ in found if w in c}), len({t for c, t in found if w in c})
            n_all = len(texts) - texts_e + n_e
            if n_te < support or n_all <= n_e:
                continue
            n_t = max(0, sum(w in h for h in holds.values()) - texts_te) + n_te
            ratio = log(n_te * n_all / (n_t * n_e)) / log(n_all / n_e)
            if ratio >= generalise:
                for t in {t for c, t in found if w in c}:
                    beside[t, w] = beside.get((t, w), False) or ratio >= remove
                if n_te / n_t > 0.5:
                    out[w] = out.get(w, False) or ratio >= remove
    return out, beside


@pytest.mark.parametrize("seed", range(2))
def test_terms_equal_a_plain_version(spark, seed):
    """Disclosing terms go in all documents, near the value or not; what is done to each is told."""
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "epsilon", "zeta", "eta1x", "theta", "iota", "kappa", "lambda", "omicron"]
    said = {f"u{k}@x{k}.org": f"Secret{chr(97 + k)}" for k in range(3)}
    docs = []
    for i in range(120):
        t = [rnd.choice(words) for _ in range(rnd.randint(3, 12))]
        if rnd.random() < 0.4:
            mail, name = rnd.choice([*said.items()])
            t.insert(rnd.randint(0, len(t)), f"{name if rnd.random() < 0.8 else ''} {mail}")
        if rnd.random() < 0.03:
            t.append(rnd.choice([*said.values()]))
        docs.append((i, " ".join(t) if rnd.random() < 0.97 else None, "en", "s", 1))
    docs += docs[:10]
    want, beside = plain_terms([t for _, t, *_ in docs])
    assert beside and set(want) & {"secreta", "secretb", "secretc"}
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(docs, DOCS)).collect()}
    for i, t, *_ in docs:
        spans = plain_spans(t or "")
        own = []
        for m in pii._TERM.finditer(t or ""):
            how = [x for x in (want.get(m[0].lower()), beside.get((t, m[0].lower()))) if x is not None]
            if how and not any(m.start() < e and s < m.end() for s, _, e in spans):
                own.append((m.start(), 4 + any(how), m.end()))
        assert got[i] == pii.joined(sorted(spans + own))


def test_many_values_take_linear_time():
    import time

    def took(n):
        text = " ".join(f"word{chr(97 + i % 26)} name{i}@site{i}.org" for i in range(n))
        at = time.perf_counter()
        pii.contexts(text, pii.base_spans(text), 5)
        return time.perf_counter() - at

    took(1000)
    assert took(16_000) < 8 * took(4000) + 0.5


@pytest.mark.parametrize("ending", ["", " page {}"])
def test_copies_are_no_evidence_against_a_term(spark, ending):
    """A document that stands 1,000 times more, exactly or with another ending, counts as before; with the numbers of the finding."""
    others = [(1000 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x some other text", "en", "s", 30) for i in range(3000)]
    rows = [(i, f"{chr(97 + i) * 4} saw Zorbatron at jane@x.example.com with {chr(98 + i) * 5} and then others went away quietly", "en", "s", 60) for i in range(6)]
    copies = [(10_000 + i, rows[0][1] + ending.format("".join(chr(97 + int(d)) for d in f"{i:04d}")), "en", "s", 60) for i in range(1000)]

    def terms(docs):
        found = pii.find(spark.createDataFrame(docs, DOCS)).where("spans like '%term%' or spans like '%removed%'").select("doc_id", "spans").collect()
        return {r.doc_id: [x for x in r.spans.split(",") if x.startswith(("term", "removed"))] for r in found}

    before, after = terms(rows + others), terms(rows + others + copies)
    said = f"removed:{rows[0][1].index('Zorbatron')}:{rows[0][1].index(' at ')}"
    assert len(before) == 6 and said in before[0]
    assert {k: v for k, v in after.items() if k < 10_000} == before and len(after) == 1006
    assert all(v == before[0] for k, v in after.items() if k >= 10_000)


def test_pii_hard_rows(spark, hard, none, wider):
    assert pii.find(wider(hard)).count() == 11 and {(r.spans, r.n_spans) for r in pii.find(hard).collect()} == {("", 0)}
    same = pii.sanitise(hard)
    assert sorted(map(str, same.collect())) == sorted(map(str, hard.collect()))
    assert pii.find(none).count() == pii.sanitise(none).count() == 0
    twice = spark.createDataFrame([(None, "mail a@b.cd", "en", "s", 11)] * 2 + [(1, "mail a@b.cd", "en", "s", 11), (1, "no mail", "en", "s", 7)], DOCS)
    assert sorted(r.spans for r in pii.find(twice).collect()) == ["", "email:5:11", "email:5:11", "email:5:11"]
    assert sorted(r.text for r in pii.sanitise(twice).collect()) == ["mail [EMAIL]"] * 3 + ["no mail"]


def test_contexts_reach_over_gaps_of_any_length():
    gap = " 12 ## " * 100
    text = f"far Zorbatron{gap}a@b.cd{gap}Quibble end"
    found = pii.contexts(text, pii.base_spans(text), 5)
    assert {t for _, t, _ in found} == {pii.term_hash(w) for w in ("far", "Zorbatron", "Quibble", "end")}
    text = "x" * 300 + " at a@b.cd"  # a word over the old edge stays whole
    assert [t for _, t, _ in pii.contexts(text, pii.base_spans(text), 5)] == [pii.term_hash("x" * 300)]


def test_overlapping_spans_become_one():
    assert pii.masked("call +4111 1111 1111 1111 now", None).count("[") == 1
    assert pii.masked("x", [{"start": 0, "end": 1, "removed": True}]) == "" and pii.masked("plain", None) == "plain"
