"""The embedding queries train as widely and as long as the configuration says."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketloom.config import DEFAULT
from basketloom.operators import embed, skipgram
from basketloom.plans import models

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["item2vec_vectors", "item2vec_topk", "kg_embeddings"])
def test_training_is_whole(spark, monkeypatch, name):
    calls = []

    def word2vec(sentences, **options):
        calls.append((sentences, options))
        return spark.createDataFrame([(20, [1.0] * options["dim"]), (21, [2.0] * options["dim"])], "id long, vec array<double>")

    monkeypatch.setattr(models.embed, "word2vec", word2vec)
    out = getattr(models, name)(spark, str(DATA))
    ((sentences, options),) = calls
    assert (options["dim"], options["epochs"]) == (DEFAULT.item2vec_dim, DEFAULT.epochs) == (128, 20)
    if name != "item2vec_topk":
        assert {len(r.vec) for r in out.collect()} == {128}
    if name == "kg_embeddings":
        starts = models.semantic_starts(spark, str(DATA)).count()
        walks, longest = sentences.agg(F.count("*"), F.max(F.size("items"))).first()
        assert walks == starts * DEFAULT.num_walks and longest == DEFAULT.walk_length


@pytest.mark.parametrize("partitions, least", [(1, 4096), (3, 4)])
def test_vectors_are_trained_in_blocks(spark, monkeypatch, partitions, least):
    monkeypatch.setattr(skipgram, "LEAST_BLOCK", least)
    rows = [([10 * (i % 2) + (i * 7 + k * (1 + i % 3)) % 8 for k in range(5)],) for i in range(400)] + [([3, 99, 4],)]
    v = {r.id: np.array(r.vec) for r in embed.word2vec(spark.createDataFrame(rows, "items array<long>"), dim=8, window=3, min_count=5, epochs=10, partitions=partitions).collect()}
    assert sorted(v) == [*range(8), *range(10, 18)]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    same = np.mean([cos(v[a], v[b]) for a in range(8) for b in range(a)])
    other = np.mean([cos(v[a], v[b + 10]) for a in range(8) for b in range(8)])
    assert same > other + 0.3 and all(np.isfinite(x).all() for x in v.values())


def test_sentences_of_a_plan_that_is_laid_out_already(spark, tmp_path):
    spark.createDataFrame([(i, i % 7) for i in range(60)], "o long, p long").write.parquet(f"{tmp_path}/lines")
    held = spark.read.parquet(f"{tmp_path}/lines").where("p >= 0").persist()
    held._jdf.queryExecution().executedPlan().supportsColumnar()
    sentences = held.groupBy((F.col("o") / 5).cast("int")).agg(F.collect_list("p").alias("items")).select("items")
    assert embed.word2vec(sentences, dim=4, window=2, min_count=1).count() == 7


def test_sums_of_rows():
    rng = np.random.default_rng(3)
    at = np.concatenate((rng.integers(0, 40, 60), np.full(50, 7), [99]))
    change, order = rng.random((len(at), 3)), np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    assert np.allclose(skipgram.sums(change, order, first), [change[at == r].sum(axis=0) for r in rows])


def test_best_of_many_blocks_with_ties():
    score = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf]])
    assert [x.tolist() for x in embed.top_of(score, np.array([[7, 1, 3, 5, 2]]), 3)] == [[[0.9, 0.5, 0.5]], [[1, 3, 5]]]


def test_blocks_meet_for_several_epochs(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "LEAST_BLOCK", 4)
    rounds, write = [], type(spark.range(1).write).parquet

    def counted(self, path, *args, **options):
        rounds.append("/state-" in path)
        return write(self, path, *args, **options)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", counted)
    rows = [([(i * 5 + k * 7) % 13 for k in range(4)],) for i in range(60)]
    assert embed.word2vec(spark.createDataFrame(rows, "items array<long>"), dim=4, window=2, min_count=1, epochs=12, partitions=3).count() == 13
    assert sum(rounds) == 3 * 3


@pytest.mark.parametrize("most", [0, 30, 500])
def test_steps_hold_all_pairs(most):
    rng = np.random.default_rng(1)
    n, pairs = 40, 40 * most // 2
    i, j = rng.integers(0, 20, pairs) if most < 500 else np.minimum(rng.integers(0, 400, pairs), 19), rng.integers(0, 30, pairs)
    w = rng.random(pairs).astype(np.float32)
    got = np.zeros((n, 30))
    work = skipgram.dealt(i, j, w, n, rng)
    for at, other, weight in work:
        np.add.at(got, (np.repeat(at, other.shape[1]), other.ravel()), weight.ravel())
    wanted = np.zeros((n, 30))
    np.add.at(wanted, (i, j), w)
    assert np.allclose(got, wanted, rtol=1e-4) and {*np.concatenate([x[0] for x in work])} == {*range(n)}


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_search_leaves_out_what_is_not_finite(spark, monkeypatch, small):
    monkeypatch.setattr(embed, "SMALL_ANCHORS", small, raising=False)
    rng = np.random.default_rng(2)
    # equal vectors, so that ties go by id; the last ones are null, zero or not finite
    v = np.round(rng.standard_normal((90, 3)))[rng.integers(0, 60, 150)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(150, [float("nan"), 1.0, 0.0]), (151, [float("inf"), 1.0, 1.0]), (152, None), (153, [0.0, 0.0, 0.0]), (154, [None, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "id long, vec array<double>")
    got = embed.cosine_top_k(table.where("id % 5 = 0"), table, 7, positive=False, block=20).collect()
    length = np.linalg.norm(v, axis=1)
    known = np.flatnonzero(length > 0)
    score = np.round((v @ v.T) / np.maximum(length, 1e-9)[:, None] / np.maximum(length, 1e-9), 6)
    wanted = {(a, b, r + 1) for a in known if a % 5 == 0 for r, b in enumerate(sorted((b for b in known if b != a), key=lambda b: (-score[a, b], b))[:7])}
    assert {(r.a, r.b, r.rank) for r in got} == wanted and all(abs(score[r.a, r.b] - r.score) < 1e-9 for r in got)


@pytest.mark.parametrize("held", [3, 1 << 21])
def test_pairs_are_packed_by_blocks(monkeypatch, held):
    monkeypatch.setattr(skipgram, "HELD", held, raising=False)
    lists = [[5, 9, 5, 12], [9, 5], [], [12, 12, 3_000_007]]
    got, blocks, packs = {}, 3, 2
    for batch in skipgram._pairs(2, blocks, packs, 42)(iter([pa.RecordBatch.from_pydict({"items": pa.array(lists, pa.list_(pa.int64()))})])):
        for x, y, data in zip(*(batch[c].to_pylist() for c in ("x", "y", "data"))):
            for a, b, w in np.frombuffer(data, np.int64).reshape(3, -1).T:
                assert (x, y) == (skipgram._block(a, blocks, 42), skipgram._block(b, blocks, 42))
                got[a, b] = got.get((a, b), 0) + w
    assert got == {(5, 9): 6, (5, 12): 2, (9, 12): 1, (12, 3_000_007): 3}
