"""Line, document and embedding deduplication against brute force, with the defined edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketloom.llm import components, embdedup, linededup, minhash, util, words

SCHEMA = "doc_id long, text string, component string, key string, rep string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


# ------------------------------------------------------------------ lines


def full_lines(text):
    return [x for x in (line.strip(" \t\r\f\v") for line in (text or "").split("\n")) if x]


def deleted(texts, min_words=50):
    """By definition: a line goes if any run of ``min_words`` words that covers it stood before, whatever its lines."""
    seen, gone = set(), []
    for t in texts:
        own = full_lines(t)
        mine = set()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(len(x.split()) for x in own[i:j]) >= min_words:
                    if tuple(own[i:j]) in seen:
                        mine |= set(range(i, j))
                    seen.add(tuple(own[i:j]))
        gone.append((len(own), sorted(mine)))
    return gone


@pytest.mark.parametrize("least", [1, 4, 7])
def test_lines_against_brute_force(spark, least):
    rng = random.Random(least)
    long = " ".join(["w%d" % i for i in range(9)])
    texts = ["\n".join(rng.choice(["a", "b", "c", " d ", "", long, "e\tf", "g h i"]) for _ in range(rng.randint(0, 24))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r for r in linededup.report(docs(spark, list(enumerate(texts))), least).collect()}
    for i, (n, gone) in enumerate(deleted(texts, least)):
        assert (got[i].n_lines, got[i].n_removed) == (n, len(gone)), (i, texts[i])
        assert got[i].n_runs == sum(p - 1 not in gone for p in gone)
    assert got[60].kept_text is None and got[61].kept_text == ""


def test_runs_deeper_than_two_lines_decide(spark):
    """Lines and pairs of lines are common; only the run of five that stands twice has 50 words."""
    line = lambda c: " ".join(f"{c}{i}" for i in range(10))
    run = "\n".join(map(line, "abcde"))
    others = ["\n".join(map(line, x)) for x in ("ab", "bc", "cd", "de", "abxde", "xabcdy")]
    rows = list(enumerate([*others, run, "first\n" + run + "\nlast"]))
    got = {r.doc_id: r.kept_text for r in linededup.report(docs(spark, rows)).collect()}
    assert [got[i] for i in range(8)] == [*others, run, "first\nlast"]


def test_intervals_are_a_suffix_array(spark):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(12))) for k in range(5)]
    lines = linededup.cut_lines(spark.createDataFrame(rows, "key long, text string"), 9).withColumn("need", F.lit(3))
    levels = linededup.suffix_intervals(lines, util.Scratch(spark, "t"))
    ids = {(r.key, r.pos): bytes(r.line) for r in lines.collect()}
    for k, level in enumerate(levels):
        depth = 1 << k
        prefix = {(key, p): tuple(ids[key, p + i] for i in range(depth)) for key, p in ids if (key, p + depth - 1) in ids}
        groups = {}
        for place, run in prefix.items():
            groups.setdefault(run, []).append(place)
        ranks = {run: i for i, run in enumerate(sorted(run for run, at in groups.items() if len(at) > 1))}
        got = {(r.key, r.pos): (r["rank"], (r.first_key, r.first_pos)) for r in level.collect()}
        assert got == {at: (ranks[run], min(groups[run])) for at, run in prefix.items() if run in ranks}
    assert len(levels) == 4


def test_lines_of_repeated_rows_and_copies(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "x\na\nb"), (2, "b\n\nc\nlast"), (3, "only"), (4, "only")]
    out = linededup.deduplicate(docs(spark, rows), 2)
    assert out.columns == ["doc_id", "text", "component", "key", "rep"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a\nb\nc"), (None, "x"), (2, "\nlast"), (3, "only"), (4, "only")], key=str)
    assert linededup.deduplicate(docs(spark, rows).where("false"), 2).count() == 0


def test_very_long_document(spark):
    body = "\n".join(f"line {i}" for i in range(20_000))
    got = {r.doc_id: r for r in linededup.report(docs(spark, [(1, body), (2, body + "\nmore")])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 20_000 and got[2].kept_text == "more" and got[2].n_runs == 1


# ------------------------------------------------------------------ documents


def near_brute(rows, width, percent):
    def shingles(t):
        w = [x for x in minhash_words(t)]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                common = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label


def minhash_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("width, tile", [(4, 400), (5, 3)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, width, tile):
    monkeypatch.setattr(minhash, "TILE_SETS", tile)
    rng = random.Random(width)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(50):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w).replace("w1", "W1") + ("\t" if i % 2 else "")))
    rows += [(50, None), (51, ""), (52, "a b"), (53, "A  B"), (54, "É b"), (55, "é b"), (56, " \n ")]
    sizes, label = near_brute(rows, width, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows), width=width).collect()}
    assert [got[i].n_shingles for i, _ in rows] == sizes
    assert [got[i].component_id for i, _ in rows] == label
    assert all(got[i].kept == (label[i] == i) for i, _ in rows)
    kept = minhash.first_of_each(docs(spark, rows), width=width)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows if label[i] == i]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t = "one two three four five six"
    rows = [(7, t), (7, t), (None, t), (3, "other words here that stand alone"), (7, None)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, True), (7, 7, False), (None, 7, False), (3, 3, True), (7, 7, True)], key=str)
    assert minhash.near_duplicates(docs(spark, rows).where("false")).count() == 0


def test_recall_close_to_the_threshold(spark):
    """Pairs planted at Jaccard 0.80 to 0.85 of four-word shingles: at least 0.99 of those at the threshold are found."""
    rng = random.Random(12)
    rows, linked = [], []
    for i in range(400):
        w = [f"p{i}w{k}" for k in range(203)]
        other = list(w)
        # of 200 shingles, four change with each word far from the others
        for k in rng.sample(range(8, 195, 8), 5):
            other[k] = f"other{i}w{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        linked.append(100 * 180 >= 80 * 220)
    assert all(linked)  # 180 / 220 = 0.818
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows), width=4).collect()}
    found = sum(got[2 * i + 1].component_id == 2 * i for i in range(400))
    assert found >= 396
    assert all(got[2 * i].kept for i in range(400))


def test_near_duplicates_among_boilerplate(spark, monkeypatch):
    """Documents that share a third of their words with all others are candidates of each other, and not linked."""
    monkeypatch.setattr(minhash, "TILE_SETS", 16)
    rng = random.Random(13)
    shared = [f"menu{k}" for k in range(60)]
    rows = []
    for i in range(120):
        own = [f"d{i}w{k}" for k in range(60)]
        rows.append((i, " ".join(shared + own)))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join(shared + own[:-2])))
    rng.shuffle(rows)
    rows.sort()
    _, label = near_brute(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), width=4).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in label]


def test_near_duplicates_of_odd_texts(spark):
    long = "word" * 200_000
    rows = [(None, None), (1, long), (2, long), (3, "a " * 100_000), (4, "a " * 99_999), (5, None)]
    got = sorted(map(tuple, minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)], key=str)
    none = docs(spark, [(1, None), (2, None)])
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(none).collect()} == {(1, 1, True), (2, 2, True)}


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    pool = words.mix(np.arange(3000, dtype=np.uint64))
    a, b = pool[:2000], pool[1000:]
    rng.shuffle(a)
    s = minhash.signatures(np.concatenate((a, b)), np.array([0, 2000]), 1024)
    assert (s[0] == s[1]).mean() == pytest.approx(1000 / 3000, abs=0.05)


def test_word_hashes_depend_on_the_word_alone():
    h, n = words.word_hashes([b"ab  cd\n", b"", b"cd Ab x"])
    assert n.tolist() == [2, 0, 3] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), util.Scratch(spark, "t")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 200)) and got[302] == 300
    assert components.components(spark.createDataFrame([], "a long, b long"), util.Scratch(spark, "t")).count() == 0


# ------------------------------------------------------------------ embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 40))
    x = np.concatenate([base[rng.integers(0, 6, 150)] + rng.normal(size=(150, 40)) * rng.choice([0.05, 0.25, 0.3], (150, 1)), rng.normal(size=(50, 40))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    odd = [(200, None, "a"), (201, [0.0] * 40, "b"), (202, [float("nan")] * 40, "b"), (203, [None] * 40, None), (204, [math.inf] + [0.0] * 39, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label string").repartition(4)
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    label = np.arange(200)
    for _ in range(200):
        label = np.array([label[link[i]].min() for i in range(200)])
    got = {r.vec_id: r for r in embdedup.near_duplicates(df, tile_rows=40).collect()}
    assert [got[i].n_links for i in range(200)] == (link.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(200)] == label.tolist()
    assert all(got[i].kept == (label[i] == i) for i in range(200))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(200, 205))


def test_embeddings_of_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (None, [1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embdedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, False), (None, 2, 1, False), (2, 0, 2, True)], key=str)
    assert embdedup.near_duplicates(df.where("false")).count() == 0


def test_embeddings_in_rounds_and_with_copies(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "ROUND_BYTES", 1)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5, 24))
    x = (base[rng.integers(0, 5, 60)] + rng.normal(size=(60, 24)) * 0.2).astype(np.float32)
    x = x[rng.integers(0, 60, 150)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    label = np.arange(150)
    for _ in range(150):
        label = np.array([label[link[i]].min() for i in range(150)])
    got = {r.vec_id: r for r in embdedup.near_duplicates(df, tile_rows=30).collect()}
    assert len(got) == 150
    assert [got[i].n_links for i in range(150)] == (link.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(150)] == label.tolist()


def test_a_class_of_copies_is_not_paired(spark):
    keys, one = np.arange(2), np.array([[1.0, 0.0], [0.96, 0.28]])
    counts, edges = embdedup.compare(keys, one, keys, one, np.eye(2), 0.95, True, np.array([1000, 7]), np.array([1000, 7]))
    assert counts.to_dict() == {0: 7, 1: 1000} and len(edges) == 1


@pytest.mark.parametrize("small", [0, 10, 10**6])
def test_components_at_the_driver_and_by_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(small)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    label = list(range(200))
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), util.Scratch(spark, "t")).collect()))
    assert got == {n: label[n] for a, b in edges if a != b for n in (a, b)}
