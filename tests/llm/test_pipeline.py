"""The pipeline against its brute-force composition, and the registration of its parts."""

import hashlib
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from test_dedup import deleted, near_brute

import __spark_entry__ as entry
import corpus_pipeline
from basketloom.llm import bytebpe, langid, minhash, queries

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix potent brews"


def expected(rows, known):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = []
    for (i, t), (n, gone) in zip(rows, deleted([t for _, t in rows])):
        if gone and len(gone) == n:
            continue
        full, out = -1, []
        for line in t.split("\n"):
            full += bool(line.strip())
            if not line.strip() or full not in gone:
                out.append(line)
        kept.append((i, "\n".join(out)))
    _, label = near_brute(kept, 5, 80)
    kept = [x for k, x in enumerate(kept) if label[k] == k]
    kept = [(i, t) for i, t in kept if ITEM not in t]
    return {i: (len(ids := known.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"{rng.choice(['wor', 'thi', 'een'])}{rng.choice(['ds', 'ng', 'ty'])}{rng.randint(0, 300)}"
    line = lambda: " ".join(word() for _ in range(14))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(24):
        own = [line() for _ in range(4)]
        rows.append((i, "\n".join(own[:2] + (shared if i % 3 == 0 else []) + own[2:])))
    rows += [(30, rows[1][1]), (31, rows[1][1].replace(rows[1][1].split()[20], "other")), (32, None), (33, "12 34 --"), (34, line() + " " + ITEM + "\n" + line()), (35, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(public_tokenizers.path(queries.BYTE_RANKS)), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected(rows, known)
    assert 30 not in got and 31 not in got and 32 not in got and 34 not in got and len(got) == 24
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns


WIDE = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` int, lang_pred string, score double, found string, `kept text` int"


def widened(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "k", 1, "x", 0.5, "f", None) for i, t, lang in rows], WIDE)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    """Nulls in any column, null and repeated ids, repeated rows, further columns, and tables without rows."""
    spark.createDataFrame([(0, ITEM), (1, None), (None, "  ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"plain{i % 7} words{i}" for i in range(40))
    other = " ".join(f"quite{i} others{i % 5}" for i in range(40))
    rows = [(1, text, "en"), (1, text, "en"), (None, other, None), (2, None, None), (None, None, "en"), (3, "", "en"), (4, ITEM, "en"), (5, "\n \n", "de")]
    docs = widened(spark, rows)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if name == "tokens":
        assert sorted(r.n_tokens for r in got)[:2] == [0, 0] and len(got) == len(rows)
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        return
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    texts = [r.text for r in got]
    told = {
        "language": [text, text, other, ITEM],
        "lines": [text, other, None, None, "", ITEM, "\n \n"],
        "near": [text, other, None, None, "", ITEM, "\n \n"],
        "benchmark": [text, text, other, None, None, "", "\n \n"],
    }[name]
    assert sorted(texts, key=str) == sorted(told, key=str)
    assert all(r["key"] == "k" and r["row"] == 1 and r.lang_pred == "x" for r in got)
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_steps_hold_little_of_a_batch_at_once():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice(['wor', 'thi', 'een'])}{rng.choice(['ds', 'ng', 'ty'])}" for _ in range(500)) for _ in range(512)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(512)), "id": list(range(512)), "row": texts, "lang": ["en", "de"] * 256, "text": texts})
    model = SimpleNamespace(value=langid.LanguageModel(["de", "en"], np.zeros((2, langid.BUCKETS)), np.zeros(2)))
    for step in (langid._count, langid._predict(model), minhash._signed(5, 24, 4), minhash._sets(5)):
        list(step(iter([batch.slice(0, 2)])))  # tables that are made once
        tracemalloc.start()
        assert sum(x.num_rows for x in step(iter([batch]))) >= 2
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 64 << 20


def test_registration():
    known = entry.queries()
    assert "pipeline" in known and {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "tokens"]
