"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as lower-case code points with every run of non-letters as one blank. Each n-gram of 1 to ``ORDER``
characters is hashed into ``BUCKETS`` classes. Training adds up class counts per language, prediction sums the rows
of the log-probability matrix (languages x ``BUCKETS``, of fixed size, broadcast) in numpy, many texts at a time.

Defined cases: a null text, or one without a letter, gets ``und`` with score 0. Rows without language are not learnt
from. Without any learnt language all texts get ``und``. Ties go to the alphabetically first language. Repeated rows
are each predicted; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import batches, raw, small_batches

ORDER = 3
BUCKETS = 1 << 15
#: Training uses about this many labelled rows at most, taken by a hash of the id; a documented bound.
TRAIN_ROWS = 60_000
#: Tasks that count the sample.
FIT_TASKS = 12
#: Bytes of text whose n-grams are held at once; they take some 150 times as much.
SLICE = 1 << 18
UNKNOWN = "und"


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for cp in range(0x110000):
        if cp < 0xD800 or cp > 0xDFFF:
            table[cp] = chr(cp).isalpha()
    return table


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    return _LETTERS[0]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash classes of all n-grams, the index of the text of each, and which texts hold a letter.

    The texts stand one after another with a blank before, between and after, so n-grams never span two texts.
    """
    joined = (b" \n" + b" \n".join(texts) + b" \n").decode("utf-8", "replace").lower()
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # the line feeds of the texts themselves became blanks before joining
    edges = chars == 10
    owner = np.cumsum(edges) - 1
    is_letter = letters()[chars]
    keep = is_letter | np.concatenate(([True], is_letter[:-1])) | edges
    code = np.where(is_letter, chars, 32)[keep].astype(np.uint32)
    owner, edges, is_letter = owner[keep], edges[keep], is_letter[keep]
    out, whose = [], []
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, ORDER + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        h = (h[:size] * np.uint32(0x01000193)) ^ code[n - 1 : n - 1 + size]
        mixed = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        ok = (owner[:size] == owner[n - 1 : n - 1 + size]) & (owner[:size] >= 0) & (owner[:size] < len(texts))
        ok &= is_letter[:size] | is_letter[n - 1 : n - 1 + size]
        out.append((mixed & np.uint32(BUCKETS - 1))[ok].astype(np.int32))
        whose.append(owner[:size][ok])
    has = np.zeros(len(texts), dtype=bool)
    has[owner[is_letter]] = True
    return np.concatenate(out), np.concatenate(whose), has


def clean(column: pa.Array) -> list[bytes]:
    return [x.replace(b"\n", b" ") for x in raw(column)]


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` in alphabetical order; ``logs`` holds log P(class | language), ``prior`` log P(language)."""

    langs: list[str]
    logs: np.ndarray
    prior: np.ndarray


def train(docs: DataFrame, labelled: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on the rows with a language for which ``labelled`` holds, about ``most_rows`` of them.

    Each task adds up its classes per language and emits one sparse vector a language; these are summed by blocks of
    classes, so what reaches the driver is one matrix of fixed size.
    """
    if labelled is not None:
        docs = docs.where(labelled)
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    total = rows.select("lang").count()
    if total > most_rows:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(most_rows / total * 1_000_000))
    # the sample is bounded, and so is what its few tasks emit
    counted = rows.select("text", "lang").repartition(FIT_TASKS).mapInArrow(_count, "lang string, n long, classes binary")
    by_lang = {}
    for lang, n, block in counted.groupBy("lang").applyInPandas(_add, "lang string, n long, classes binary").collect():
        by_lang[lang] = (n, np.frombuffer(block, dtype=np.float64))
    langs = sorted(by_lang)
    if not langs:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    counts = np.array([by_lang[x][1] for x in langs])
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    prior = np.log(np.array([by_lang[x][0] for x in langs], dtype=float) / sum(by_lang[x][0] for x in langs))
    return LanguageModel(langs, logs.astype(np.float64), prior)


def _count(stream):
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches(stream, most=SLICE):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        index = np.array([names.index(x) for x in langs], dtype=np.int64)
        classes, whose, _ = features(clean(batch.column("text")))
        counts = np.bincount(index[whose] * BUCKETS + classes, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        for i, name in enumerate(names):
            sums[name] = sums.get(name, 0) + counts[i]
            rows[name] = rows.get(name, 0) + int((index == i).sum())
    if sums:
        names = sorted(sums)
        yield pa.RecordBatch.from_pydict({"lang": names, "n": [rows[x] for x in names], "classes": [np.asarray(sums[x], dtype=np.float64).tobytes() for x in names]})


def _add(group):
    import pandas as pd

    total = np.zeros(BUCKETS)
    for block in group.classes:
        total += np.frombuffer(block, dtype=np.float64)
    return pd.DataFrame({"lang": [group.lang.iloc[0]], "n": [int(group.n.sum())], "classes": [total.tobytes()]})


def score(texts: list[bytes], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    if not model.langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    classes, whose, has = features(texts)
    logs = np.empty((len(texts), len(model.langs)))
    for i in range(len(model.langs)):
        logs[:, i] = np.bincount(whose, weights=model.logs[i][classes], minlength=len(texts)) + model.prior[i]
    best = logs.argmax(axis=1)
    sure = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, sure, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replaced if there)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = packed.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    return packed.mapInArrow(_predict(shared), schema).select("row.*", "lang_pred", "score")


def _predict(shared):
    def run(stream):
        for batch in batches(stream, most=SLICE):
            langs, sure = score(clean(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["row", "lang_pred", "score"])

    return run
