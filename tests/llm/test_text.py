"""URL filter, decontamination, language ID, language-model scores, encoding, store and shards."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketloom.llm import bytebpe, decontam, langid, lmscore, queries, sharding, tokenstore, urlfilter, util

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [None, "", " ", "it's\n\n 's 'tis don''t he'll've", "a" * 3000, "世界 العربية ３４ ½ é́ 😀", "\t\n x   y\r\n", "<|endoftext|> Σας ΣΑΣ", "\x1c a\x00b"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", "a", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, ids string, row string, size int").repartition(3)


# ------------------------------------------------------------------ urls

RULES = [urlfilter.parse(*r) for r in queries.URL_RULES] + [urlfilter.parse("block", "/x.y"), urlfilter.parse("block", "a.b+c.org/p(q")]
URLS = ["http://Example.COM/en/75?x", "https://a.example.com/en/", "http://com/en/x", "http://xexample.net/de/8", "http://example.net/de/81#z", "http://q.org/es", None, "", "no scheme", "://", "http://h?a/en/", "ftp://x/x.yz", "http://n/xzy", "http://k.a.b+c.org/p(q)", "http://net/de/://com/en/"]


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def _host_free(rule):
    return rule.host == ""


@pytest.mark.parametrize("inline", [512, 0])
def test_urls_against_brute_force(spark, inline):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    rules = [r for r in RULES if not _host_free(r)]
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(df, rules, keep=["page_id"], inline=inline).collect()}
    for i, u in enumerate(URLS * 2):
        rest = url_brute(u)
        fits = [r for r in rules if (rest[0] == r.host or rest[0].endswith("." + r.host)) and rest[1].startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert got[i] == (rest[0], rest[1], best and best.text, best.action if best else "allow"), u
    assert urlfilter.judge(df.where("false"), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, []).collect()} == {"allow"}


@pytest.mark.parametrize("inline", [512, 0])
def test_urls_of_odd_tables(spark, inline):
    """Null ids, clashing columns, repeated rows, a very long url, a rule without a literal token, and no rows."""
    long = "http://a.com/en/" + "x" * 200_000
    df = spark.createDataFrame([(None, long, "mine", "old"), (None, long, "mine", "old"), (1, None, None, None)], "page_id long, url string, host string, VERDICT string")
    rules = [urlfilter.parse("block", "com/en/"), urlfilter.parse("allow", "a.com/--")]
    got = urlfilter.judge(df, rules, keep=["page_id", "host", "url", "VERDICT"], inline=inline)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((str(r.page_id), r.host, len(r.path), r["rule"], r.verdict) for r in got.collect()) == [("1", "", 0, None, "allow")] + [("None", "a.com", 200_004, "com/en/", "block")] * 2
    assert urlfilter.judge(df.where("false"), rules, inline=inline).count() == 0


def test_rules_are_filed_by_their_rarest_token():
    filed = {r.text: t for t, r in urlfilter.index([urlfilter.parse(*x) for x in queries.URL_RULES])}
    assert filed == {"com/en/": "en", "example.com/en/7": "en", "net/de/": "net", "example.net/de/8": "net", "org/es/": "org"} or all(t in r for r, t in filed.items())
    assert "7" not in urlfilter.parse("allow", "example.com/en/7").tokens()


# ------------------------------------------------------------------ decontamination


def tile_brute(item, doc, least):
    mi, md, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best, found = 0, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n >= least and n >= best:
                    found = found + [(i, j)] if n == best else [(i, j)]
                    best = n
        if not found:
            return sorted(tiles)
        for i, j in found:
            if not any(mi[i : i + best]) and not any(md[j : j + best]):
                mi[i : i + best] = [True] * best
                md[j : j + best] = [True] * best
                tiles.append((i, j, best))


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        doc = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        got = decontam.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 2)
        assert sorted(got) == tile_brute(item, doc, 2)


def test_tiling_of_repetitive_texts_is_fast():
    """Equal words, and short cycles of words, of 200,000 words: no list of pairs is made."""
    began = time.time()
    equal = np.full(200_000, 7, np.uint64)
    assert decontam.tile(equal[:40], equal, 4) == [(0, 0, 40)]
    assert sum(n for *_, n in decontam.tile(equal[:3000], np.arange(200_000, dtype=np.uint64) % 3 + 6, 1)) == 3000
    cycle = np.arange(200_000, dtype=np.uint64) % 5
    assert decontam.tile(cycle[:2001], cycle, 4) == [(0, 0, 2001)]
    assert time.time() - began < 10


def contaminated_brute(text, items, least, threshold):
    """Coverage by definition, of every item and without seeds."""
    words = lambda t: re.findall(r"(?:[^\x00-\x7f]|[a-z0-9])+", (t or "").lower())
    doc, out = words(text), []
    for name, item in items:
        w = words(item)
        share = sum(n for *_, n in tile_brute(w, doc, min(least, len(w)))) / len(w) if w else 0.0
        if share >= threshold:
            out.append((-share, name is None, name or 0))
    return [(name if not none else None, -share) for share, none, name in sorted(out)]


def test_contamination_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(1, 14)))) for i in range(12)] + [(None, "one two three four five"), (12, None), (13, ""), (14, "..")]
    texts = [None, "", "One two; three four!"]
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(items[:13])[1].split()
            a = rng.randint(0, len(w))
            parts += [" ".join(w[a:] + w[:a]), " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 5)))]
        texts.append(", ".join(parts))
    texts += [" ".join(rng.choice("ijk") + rng.choice("xyz") for _ in range(9)) for _ in range(20)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in queries.op5_decontamination(spark, str(tmp_path)).collect()}
    caught = 0
    for i, t in enumerate(texts):
        told = contaminated_brute(t, items, decontam.LEAST, decontam.THRESHOLD)
        caught += bool(told)
        assert got[i].contaminated == bool(told), t
        assert (got[i].item_id, got[i].coverage) == (told[0] if told else (None, 0.0)), t
        assert got[i].item_ids == sorted((x for x, _ in told if x is not None)) or None in got[i].item_ids
    assert 20 < caught <= 80


def test_contamination_by_items_with_other_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four"), (1, "one two three four"), (1, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([("b", "one two three four"), ("a", "One, two, three, four."), (None, "three four")], "item_id string, text string")
    got = decontam.judge(docs, items).collect()
    assert sorted((r.contaminated, r.item_id) for r in got if r.contaminated) == [(True, "a")] * 2 and len(got) == 3


def test_contamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix potent brews at dawn"
    w = item.split()
    texts = [item.upper() + "!", "Well, " + " ".join(w[9:]) + " -- " + " ".join(w[:9]), " ".join(w[:6]), "nothing of it", None, "", "x " * 5000 + item, "the the the the the"]
    bench = spark.createDataFrame([(3, item), (1, item), (4, None), (5, ""), (6, "short one")], "item_id long, text string")
    for portion in (10**6, 40):
        got = {r.doc_id: r for r in decontam.judge(table(spark, texts), bench, portion=portion).collect()}
        assert [got[i].contaminated for i in range(8)] == [True, True, False, False, False, False, True, False]
        assert got[0].item_ids == [1, 3] and got[0].item_id == 1 and got[0].coverage == 1.0 and got[3].item_id is None
    kept = decontam.clean(table(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7] and kept.columns == table(spark, texts).columns
    assert decontam.judge(table(spark, ["say: short one."]), bench).first().item_id == 6
    assert decontam.judge(table(spark, texts).where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontam.judge(table(spark, texts), bench.where("false")).collect())


# ------------------------------------------------------------------ language ID


def test_language_accuracy_on_held_out_rows(spark):
    rng = random.Random(6)
    roots = {"aa": ["thon", "with", "ing", "er"], "bb": ["èle", "oui", "eau", "ç"], "cc": ["über", "sch", "keit", "ß"]}
    text = lambda lang: " ".join("".join(rng.choices(roots[lang], k=2)) for _ in range(12))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choices(list(roots), k=150))]
    rows += [(200, None, "aa"), (201, "12 --", "aa"), (202, text("bb"), None), (203, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:150] if i % 3 == 1]) > 0.98
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (200, 201, 203)) and got[202].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.train(df.where("false"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0


def grams(text):
    """Hash classes of the n-grams of one text, by definition."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    chars = [ord(c) for c in " " + " ".join(words) + " "] if words else []
    out = []
    for n in range(1, langid.ORDER + 1):
        for i in range(len(chars) - n + 1):
            if chars[i] == 32 and chars[i + n - 1] == 32:
                continue
            h = 0
            for c in chars[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h = (h * 0x9E3779B1 + n * 0x85EBCA6B) & 0xFFFFFFFF
            out.append((h ^ h >> 15) % langid.BUCKETS)
    return out


def languages_brute(rows, learnt):
    counts, n = {}, Counter()
    for _, text, lang in learnt:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
            n[lang] += 1
    out = []
    for _, text, _ in rows:
        found = grams(text)
        if not found or not counts:
            out.append(("und", 0.0))
            continue
        logs = {lang: math.log(n[lang] / n.total()) + sum(math.log(c[g] + 0.5) - math.log(c.total() + 0.5 * langid.BUCKETS) for g in found) for lang, c in counts.items()}
        best = max(sorted(logs), key=lambda x: logs[x])
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_language_query_against_brute_force(spark, tmp_path):
    """Also nulls in any column, repeated rows, ties of languages learnt from the same texts, and very long texts."""
    rng = random.Random(16)
    roots = {"aa": ["thon", "with", "İng", "er"], "bb": ["èle", "oui", "EAU", "ç"], "tt": ["zz", "yy"], "tu": ["zz", "yy"], None: ["unsaid"]}
    rows = []
    for i in range(60):
        lang = rng.choice(list(roots))
        rows.append((i, " ".join("".join(rng.choices(roots[lang], k=2)) for _ in range(rng.randint(1, 3))) + rng.choice(["", " -- 12", "!"]), lang))
    rows += [(100 + i, "zz yy", lang) for i, lang in enumerate(["tt", "tu"] * 6)]
    rows += [rows[0], rows[0], (200, None, "aa"), (201, "", None), (202, "12 ٣ --", "bb"), (None, "with thon", "aa"), (203, "oui " * 60_000, None), (204, "x", None)]
    spark.createDataFrame([(*r, "s", 1.0, "en") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    told = languages_brute(rows, [r for r in rows if not held(r[0])])
    got = sorted(map(tuple, queries.op7_language_id(spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()), key=str)
    for mine, ((i, _, _), (lang, score)) in zip(got, sorted(zip(rows, told), key=lambda x: str((x[0][0], held(x[0][0]), *x[1])))):
        assert mine[:3] == (i, held(i), lang) and mine[3] == pytest.approx(score, rel=1e-6)
    assert len(got) == len(rows) and {"aa", "bb", "tt", "und"} <= {x[2] for x in got}


def test_language_of_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    for learnt in (df, df.where("false")):
        assert {r.lang_pred for r in langid.identify(df, langid.train(learnt)).collect()} == {"und"}
    assert langid.identify(df.where("false"), langid.train(df)).count() == 0


def test_ngrams_stay_within_a_text():
    one, many = langid.features([b"ab"]), langid.features([b"ab", b"", b"ab"])
    assert Counter(one[0].tolist()) == Counter(many[0][many[1] == 2].tolist()) and many[2].tolist() == [True, False, True]


# ------------------------------------------------------------------ language-model scores


def lm_brute(texts, chosen):
    W = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
    out = []
    cls = [lmscore.classes([(t or "").encode()]) for t in texts]
    for own, (t, (w, h, p, n)) in enumerate(zip(texts, cls)):
        losses = []
        for use in (lambda i: chosen[i], lambda i: True):
            cw, ch, cp = Counter(), Counter(), Counter()
            for i, c in enumerate(cls):
                if use(i) and i != own:
                    cw.update(c[0].tolist()), ch.update(c[1].tolist()), cp.update(c[2].tolist())
            total = sum(cw.values())
            prob = [(cp[z] + 2.0 * (cw[x] + 1) / (total + lmscore.WORDS)) / (ch[y] + 2.0) for x, y, z in zip(w.tolist(), h.tolist(), p.tolist())]
            losses.append(-sum(map(math.log, prob)) / len(prob) if prob else None)
        assert n[0] == len(W.findall((t or "").encode()))
        out.append((int(n[0]), *losses))
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN", 2)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "C", "c", "dé"]) for _ in range(rng.randint(0, 9))) for _ in range(30)] + [None, ""]
    chosen = [i % 3 == 0 for i in range(32)]
    df = table(spark, texts)
    got = {r.doc_id: r for r in lmscore.score(df, lmscore.fit(df, F.when(F.col("doc_id") % 3 == 0, True))).collect()}
    for i, (n, a, b) in enumerate(lm_brute(texts, chosen)):
        assert got[i].n_tokens == n
        if n:
            assert (got[i].target_loss, got[i].background_loss) == pytest.approx((a, b), rel=1e-5)
            assert got[i].score == pytest.approx(a - b, rel=1e-4, abs=1e-5)
        else:
            assert got[i].score is None
    assert lmscore.score(df.where("false"), lmscore.fit(df.where("false"), F.lit(True))).count() == 0


@pytest.mark.parametrize("apart", [False, True])
def test_scores_of_many_words_are_those_of_exact_ngrams(spark, monkeypatch, apart):
    monkeypatch.setattr(lmscore, "WORDS", 100)
    rng = random.Random(5)
    # 6,000 words: tables of 2 ** 18 and 2 ** 20 classes would have some of them and of their pairs share counts
    texts = [" ".join(f"w{rng.randint(0, 5999)}" for _ in range(400)) for _ in range(150)] + [None, "", "w1 " * 500]
    split = [(t or "").split() for t in texts]
    df = table(spark, texts)
    scored = df.where("doc_id % 2 = 0").unionByName(df.where("doc_id = 1").withColumn("text", F.lit("w1 never seen w2"))) if apart else df
    if apart:
        split[1] = "w1 never seen w2".split()
    got = {r.doc_id: r for r in lmscore.score(scored, lmscore.fit(df, F.col("doc_id") % 3 == 0)).collect()}
    models = []
    for use in (lambda i: i % 3 == 0, lambda i: True):
        cw, ch, cp = Counter(), Counter(), Counter()
        for i, t in enumerate(texts):
            if use(i):
                words = (t or "").split()
                cw.update(words), ch.update([None, *words][: len(words)]), cp.update(zip([None, *words], words))
        models.append((cw, ch, cp))
    size = len(models[1][0])
    assert size > 5900 and len(got) == (78 if apart else 153)
    for i, r in got.items():
        assert r.n_tokens == len(split[i])
        for (cw, ch, cp), counted, loss in zip(models, (i % 3 == 0, True), (r.target_loss, r.background_loss)):
            if counted and not apart:  # held out of its own model
                w = split[i]
                cw, ch, cp = cw - Counter(w), ch - Counter([None, *w][: len(w)]), cp - Counter(zip([None, *w], w))
            prob = [(cp[h, w] + 2.0 * (cw[w] + 1) / (cw.total() + size)) / (ch[h] + 2.0) for h, w in zip([None, *split[i]], split[i])]
            assert loss == (pytest.approx(-sum(map(math.log, prob)) / len(prob), rel=1e-9) if prob else None)


def test_probabilities_add_up_and_no_loss_is_negative(spark):
    """Over the whole vocabulary, for a text that is not counted, after any word."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(30)]
    counted = [(i, " ".join(rng.choice(vocabulary) for _ in range(12)), i % 2 == 0) for i in range(40)]
    model = lmscore.fit(spark.createDataFrame(counted, "doc_id long, text string, good boolean"), F.col("good"))
    # the share of what was never counted is spread over the rest of the vocabulary, WORDS - 30 words
    asked = [f"v3 {w}" for w in vocabulary] + ["v3", "v3 unseen"]
    got = {r.doc_id: r for r in lmscore.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for name in ("target_loss", "background_loss"):
        first = math.exp(-got[30][name])
        after = [math.exp(-2 * got[i][name]) / first for i in (*range(30), 31)]
        assert sum(after[:30]) + (lmscore.WORDS - 30) * after[30] == pytest.approx(1, rel=1e-6)
    assert all(r.target_loss > 0 and r.background_loss > 0 for r in got.values())


def test_score_query_holds_labelled_rows_out(spark, tmp_path):
    texts = ["a b c d", "a b c d", "q r s t", None, "", "a b x y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (0, "a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 0, 1), (2, 1, None), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op10_lm_score(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, None}
    by_id = {r.doc_id: r for r in got}
    chosen = [True, False, True, False, False, False, False, True]
    for i, (n, a, b) in enumerate(lm_brute([t for _, t in rows], chosen)):
        mine = by_id[rows[i][0]]
        assert mine.n_tokens == n and (not n or (mine.target_loss, mine.background_loss) == pytest.approx((a, b), rel=1e-9))


# ------------------------------------------------------------------ encoding


def test_encoding_against_tiktoken(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(9)
    texts = TRICKY + ["".join(rng.choice("aelrvstmd xé世  \t\n''12.,!") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    encoded = bytebpe.encode(table(spark, texts), RANKS)
    got = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: bytes(r.decoded) for r in bytebpe.decode(encoded, RANKS).collect()}
    coder = bytebpe.Coder(bytebpe.read_ranks(RANKS))
    for i, t in enumerate(texts):
        assert got[i].ids == known.encode_ordinary(t or ""), repr(t)
        assert back[i] == (t or "").encode()
        at = 0
        for token, offset in zip(got[i].ids, got[i].offsets):
            assert offset == at
            at += len(coder.words[token])
    assert bytebpe.encode(table(spark, texts).where("false"), RANKS).count() == 0


def test_short_and_long_merges_agree(monkeypatch):
    coder = bytebpe.Coder(bytebpe.read_ranks(RANKS))
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdeing th") for _ in range(rng.randint(2, 32)))
        short = coder.merge(piece)
        long = coder.merge(piece * 3)
        assert b"".join(coder.words[i] for i in long) == piece * 3 and b"".join(coder.words[i] for i in short) == piece


def test_token_digests(spark):
    r = queries.token_digests(table(spark, ["", None, "hello world"])).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in r[:2]] == [(0, empty, empty)] * 2
    assert r[2].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()


# ------------------------------------------------------------------ store


def replaced(spark, path, change):
    """The rows of a stored table, changed."""
    schema, rows = spark.read.parquet(path).schema, [r.asDict() for r in spark.read.parquet(path).collect()]
    spark.createDataFrame(change(rows), schema).write.mode("overwrite").parquet(path)


def stored(spark, texts):
    path = util.Scratch(spark, "t").path("store")
    tokenstore.write(table(spark, texts), path, WORDS)
    return path


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "FAN", 2)
    t = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    passage = " ".join(f"word{rng.randint(0, 900)}" for _ in range(2000))
    texts = TRICKY + [passage, "before " + passage, passage + " after"] + ["few words"] * 4
    path = stored(spark, texts)
    start = 0
    for r in tokenstore.read(spark, path).orderBy("id").collect():
        ids = np.array(t.encode(texts[r.id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    held = spark.read.parquet(f"{path}/chunks")
    assert held.agg(F.sum("n")).first()[0] < 0.6 * start and held.groupBy("digest").count().where("`count` > 1").count() == 0
    assert {r.width for r in spark.read.parquet(f"{path}/manifest").collect()} == {2}


def _swapped(rows):
    rows[0]["payload"], rows[1]["payload"] = rows[1]["payload"], rows[0]["payload"]
    return rows


def _longer(rows):
    rows[0]["n_tokens"] += 1
    return rows


def _shorter(rows):
    row = max(rows, key=lambda r: len(r["digests"]))
    row["digests"] = row["digests"][:-1]
    return rows


@pytest.mark.parametrize(
    "part, change, message",
    [
        ("chunks", lambda rows: rows[1:], "missing"),
        ("chunks", _swapped, "differs"),
        ("recipes", lambda rows: rows[1:], "differ"),
        ("recipes", _longer, "differ"),
        ("recipes", _shorter, "differ"),
        ("manifest", lambda rows: [r | {"root": "0" * 64} if r["part"] == -1 else r for r in rows], "differ"),
    ],
)
def test_damaged_store_is_not_read(spark, part, change, message):
    path = stored(spark, ["one text", "another text of more words", "third", None])
    replaced(spark, f"{path}/{part}", change)
    with pytest.raises(Exception, match=message):
        tokenstore.read(spark, path).collect()


def test_words_are_encoded_as_by_the_library():
    """Combining marks, signs, contractions, white space and the text of special tokens, in any order."""
    t, words = Tokenizer.from_file(WORDS), tokenstore.Words(WORDS, most=500)
    rng = random.Random(5)
    parts = list("J\u030cT\u0308W\u030aY\u0323j\u0301éÉßẞİıÅÿŸ÷×µªº\xa0\x85\u2028\x1c\x001٣½²abZ.,!_~@[{-/ \n\t\rñ日한\u1100\u1161ﬁ😀\u200dΣς\u212a\u212b\u0345")
    parts += ["'s", "'S", "'", "’", "'ll", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "the", "THE", "###", "ción", "ΑΣ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    texts += [f"{chr(i)}a a{chr(i)}. {chr(i)}," for i in range(0x3000)]
    told = [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]
    for start in range(0, len(texts), 1000):
        ids, counts = words.encode([x.encode() for x in texts[start : start + 1000]])
        for got, text, known in zip(np.split(ids, np.cumsum(counts)[:-1]), texts[start:], told[start:]):
            assert got.tolist() == known, repr(text)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    whole = tokenstore.span_hashes
    monkeypatch.setattr(tokenstore, "span_hashes", lambda *a: whole(*a) & np.uint64(31))
    monkeypatch.setattr(tokenstore, "LOOKED_UP", 300)
    t, words = Tokenizer.from_file(WORDS), tokenstore.Words(WORDS, most=2000)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abÉé1 \n.,'-") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["x" * 700 + " " + "x" * 701, "<|endoftext|>"]
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        ids, counts = words.encode([x.encode() for x in some])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids + [2] for e in t.encode_batch(some, add_special_tokens=False)]


def test_words_alike_but_for_case_and_signs_are_encoded_once():
    words = tokenstore.Words(WORDS)
    seen, model = [], words.model

    class Spy:
        def encode_batch_fast(self, texts, **how):
            seen.extend(x for text in texts for x in text.split())
            return model.encode_batch_fast(texts, **how)

    words.model = Spy()
    for text in ("école École### ÉCOLE!! école.*** École", "école? école$$$, cole", "ÉCOLE-1"):
        words.encode([text.encode()])
    assert len([x for x in seen if x.endswith("cole")]) == 2  # école, cole


def test_store_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "b"), (None, "c d"), (5, "a"), (5, "a"), (None, None)], "doc_id int, text string")
    path = util.Scratch(spark, "t").path("store")
    tokenstore.write(df, path, WORDS)
    got = tokenstore.read(spark, path).orderBy("start").collect()
    assert [r.id for r in got] == [5, 5, 5, None, None] and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 2, 3]


def test_store_query_agrees_with_the_library_as_loaded(spark, tmp_path):
    t = Tokenizer.from_file(WORDS)
    texts = ["see <|endoftext|> here <|startoftext|>", "A<|endoftext|>b <|ENDOFTEXT|> <|endOfText|>", "x,<|endoftext|><|endoftext|>, y.<|startoftext|>", "<|endoftext", "É<|startoftext|>\u0301a 'S", *TRICKY]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r in queries.op8_token_store(spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = np.array(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), texts[r.doc_id]
        start += len(ids)
    assert start > len(texts)


def test_store_of_nothing(spark):
    path = util.Scratch(spark, "t").path("store")
    tokenstore.write(table(spark, ["x"]).where("false"), path, WORDS)
    assert tokenstore.read(spark, path).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 20_000).astype(np.uint32)
    streams = [ids, np.concatenate((rng.integers(0, 9, 777).astype(np.uint32), ids)), np.zeros(10_000, np.uint32), ids[:1]]
    ends, chunks = tokenstore.cuts(np.concatenate(streams), np.array([len(x) for x in streams]))
    pieces = np.split(np.concatenate(streams), ends[:-1])
    mine = [[x.tobytes() for x in pieces[b - n : b]] for b, n in zip(np.cumsum(chunks), chunks)]
    assert [b"".join(x) for x in mine] == [x.tobytes() for x in streams]
    assert len(set(mine[0]) & set(mine[1])) > 0.8 * len(mine[0])
    assert all(len(x) <= 4 * tokenstore.MOST for x in sum(mine, []))
    alone = [tokenstore.cuts(x, np.array([len(x)]))[1].tolist() for x in streams]
    assert sum(alone, []) == chunks.tolist()


# ------------------------------------------------------------------ shards


def test_shards_against_brute_force(spark):
    texts = [None if i % 50 == 0 else "é" * (i % 7) for i in range(203)]
    df = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    got = {r.doc_id: r for r in sharding.interleave(df, shards=16).collect()}
    source = {i: "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 3}" for i in range(203)}
    dice = {i: hashlib.md5(f"{sharding.SEED}:{i}".encode()).hexdigest() for i in source}
    rows = []
    for s in set(source.values()):
        own = sorted((i for i in source if source[i] == s), key=lambda i: dice[i])
        rows += [((2 * k + 1) / (2 * len(own)), "null" if s is None else "=" + s, dice[i], i) for k, i in enumerate(own)]
    order = [i for *_, i in sorted(rows)]
    slots = Counter()
    for place, i in enumerate(order):
        shard = place * 16 // 203
        assert (got[i].place, got[i].shard, got[i].slot) == (place, shard, slots[shard])
        slots[shard] += 1
        data = (texts[i] or "").encode()
        assert (got[i]["size"], got[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert max(slots.values()) - min(slots.values()) <= 1 and len(slots) == 16
    assert sharding.interleave(df.where("false")).count() == 0


def test_shard_query(spark, tmp_path):
    texts = [None, "", "é", "same", "same", "x" * 50_000] + [f"text {i}" for i in range(60)]
    table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 2))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_sharding(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    shards = [sorted(r.slot for r in got.values() if r.shard == k) for k in range(16)]
    assert all(x == list(range(len(x))) for x in shards) and max(map(len, shards)) - min(map(len, shards)) <= 1
    # every shard has the mixture of sources, to a row
    share = Counter(r.source for r in got.values())
    for k in range(16):
        own = Counter(r.source for r in got.values() if r.shard == k)
        assert all(abs(own[x] - share[x] / 16) <= 2 for x in share)


def test_shards_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted(r.slot for r in sharding.interleave(df, shards=1).collect()) == [0, 1, 2]
