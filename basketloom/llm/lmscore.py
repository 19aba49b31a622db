"""Language-model scoring: cross-entropy difference of a target and a background bigram model.

Both models read words (see ``words``), count words and pairs of words exactly, by 64-bit hashes, share one vocabulary
and are smoothed alike: P(w | h) = (c(h, w) + K P(w)) / (c(h) + K) with P(w) = (c(w) + 1) / (N + V), where V is the
number of distinct words counted, ``WORDS`` at least. The background is counted over all documents, the target over
those marked. A document's score is the mean of -ln P_target + ln P_background over its words; low scores are like the
target. A document that was counted is scored by what the others add up to: its own words and pairs are taken off first.

Tasks cut their rows into batches of about ``BATCH`` bytes of text. A batch sends each of its distinct keys once, with
its counts, to the range of hashes the key is in; there are more ranges for more text, so that a range stays small.
Each range adds up its keys and sends every batch the sums of the keys it asked for, and the sums of a batch meet its
texts again. Everything that moves or is held grows with the rows; a common key is one key of a batch like any other.

Defined cases: a text that is null or has no word has 0 tokens and null losses and score. Rows without mark (null)
belong to the background only. Without any target row the target model is uniform over the vocabulary. Null or
repeated ids are rows of their own; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Scratch, batches, raw, small_batches
from .words import mix, word_hashes

#: The least size of the vocabulary in the smoothing.
WORDS = 1 << 18
K = 2.0
#: The least number of ranges of hashes, and the bytes of text for each where there are more.
FAN = 512
RANGE = 8 << 20
#: Bytes of text of a batch, and of those hashed at a time.
BATCH, PIECE = 12 << 20, 1 << 20
START = np.uint64(0x5851F42D4C957F2D)


def classes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, of the word before it and of both, and the number of words of each text."""
    words, counts = word_hashes(texts)
    before = np.empty_like(words)
    if len(words):
        before[1:] = words[:-1]
        first = (np.cumsum(counts) - counts)[counts > 0]
        before[first] = START
    with np.errstate(over="ignore"):
        pair = mix(mix(before + np.uint64(0x9E3779B97F4A7C55)) + words)
    return words, before, pair, counts


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, pairs and numbers of words as of ``classes``, of many texts, piece by piece."""
    pieces, start, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE or i == len(texts) - 1:
            words, _, pair, counts = classes(texts[start : i + 1])
            pieces.append((words, pair, counts))
            start, size = i + 1, 0
    return tuple(np.concatenate(x) for x in zip(*pieces))


def _pack(parts: list[np.ndarray]) -> bytes:
    """Ascending keys of each part: their numbers, then the differences by byte planes, compressed."""
    gaps = np.concatenate([np.diff(p, prepend=np.uint64(0)) for p in parts]).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return np.array([len(p) for p in parts], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u4", 2)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(8, -1)
    gaps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return [np.cumsum(x, dtype=np.uint64) for x in np.split(gaps, np.cumsum(sizes)[:-1])]


def _narrow(counts: np.ndarray) -> bytes:
    """The width in bytes, then the counts by byte planes, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    planes = np.ascontiguousarray(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def _gathered(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of about ``BATCH`` bytes of text."""
    held, size = [], 0
    for batch in batches(stream, most=2 << 20):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BATCH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


#: One row for a batch's keys in a range, with the counts it adds; one row, of a negative range, for its texts.
ASKED = "batch long, range long, wants boolean, keys binary, everything binary, target binary, docs binary"
#: The sums for a batch's keys in a range; the texts, passed on; and one row of totals for each range, of batch -1.
TOLD = "batch long, range long, n_keys binary, everything binary, target binary, docs binary, vocabulary long, total long, total_target long"


def _placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and the place of each value among them."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    places = np.empty(len(x), dtype=np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], places


def _keys(word: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct words, as such or as the word before, and distinct pairs; places of words, words before and pairs."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    words, at = _placed(np.append(word, START) if len(word) else word)
    before = np.empty(len(word), dtype=np.int32)
    if len(word):
        before[1:] = at[:-2]
        before[starts] = at[-1]
        at = at[:-1]
    pairs, of_pair = _placed(pair)
    return [words, pairs], [at, before, of_pair]


def _own(places: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """How often each place stands in its own text."""
    _, same = _placed(text_of * np.int64(int(places.max(initial=0)) + 1) + places)
    return np.bincount(same).astype(np.int32)[same] if len(same) else same


def _split(data: bytes, sizes: np.ndarray) -> list[np.ndarray]:
    """Counts of words, of words before and of pairs, for the given numbers of words and pairs."""
    return np.split(_wide(data), np.cumsum([sizes[0], sizes[0]]))


def _asker(ranges: int):
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def ask(stream):
        task, made = TaskContext.get().partitionId(), 0
        for table in _gathered(stream):
            word, pair, counts = _hashed(raw(table.column("text").combine_chunks()))
            flag = lambda name: np.array(table.column(name).to_pylist(), dtype=bool)
            scored = flag("scored")
            counted, chosen = np.repeat(flag("counted"), counts), np.repeat(flag("chosen") & flag("counted"), counts)
            docs = _ipc(table.filter(pa.array(scored)).select(["id", "text", "counted", "chosen"])) if scored.any() else None
            mark = hashlib.blake2b(f"{task} {made} ".encode() + pair.data, digest_size=8).digest()
            batch = int.from_bytes(mark, "little") >> 1
            made += 1
            keys, places = _keys(word, pair, counts)
            del word, pair
            sums = [[np.bincount(x[which], minlength=len(k)) for k, x in zip((keys[0], *keys), places)] for which in (counted, chosen)]
            del counted, chosen, places
            # the keys of a range stand together, as ranges are cut by the leading bits
            ends = [np.searchsorted(k >> shift, np.arange(ranges + 1, dtype=np.uint64)) for k in keys]
            rows = []
            for r in range(ranges):
                at = [slice(e[r], e[r + 1]) for e in ends]
                if any(a.stop > a.start for a in at):
                    rows.append((batch, r, bool(docs), _pack([k[a] for k, a in zip(keys, at)]), *[_narrow(np.concatenate([c[a] for c, a in zip(s, (at[0], *at))])) for s in sums], None))
            if docs:
                rows.append((batch, -1 - (batch >> 1), True, None, None, None, docs))
            schema = pa.schema([("batch", pa.int64()), ("range", pa.int64()), ("wants", pa.bool_()), *[(c, pa.binary()) for c in ("keys", "everything", "target", "docs")]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return ask


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    """The sums over all batches of one range's keys, for each batch that wants them."""
    names = [x.split()[0] for x in TOLD.split(", ")]
    first = int(group.range.iloc[0])
    if first < 0:
        return pd.DataFrame([(b, first, None, None, None, d, 0, 0, 0) for b, d in zip(group.batch, group.docs)], columns=names)
    parts = [_unpack(x) for x in group["keys"]]
    sizes = np.array([[len(k) for k in p] for p in parts])
    given = [[_split(x, n) for x, n in zip(group[c], sizes)] for c in ("everything", "target")]
    back, totals = [[[] for _ in parts] for _ in given], []
    vocabulary = 0
    for part in range(2):
        _, place = _placed(np.concatenate([p[part] for p in parts]))
        ends = np.cumsum(sizes[:, part])[:-1]
        for kind in ((0, 1), (2,))[part]:
            for which, of in enumerate(given):
                added = np.bincount(place, weights=np.concatenate([x[kind] for x in of])).astype(np.int64)
                for i, x in enumerate(np.split(added[place], ends)):
                    back[which][i].append(x)
                if kind == 0:
                    totals.append(int(added.sum()))
                    vocabulary = vocabulary or int((added > 0).sum())
    out = [(-1, first, None, None, None, None, vocabulary, *totals)]
    for i, (batch, wants) in enumerate(zip(group.batch, group.wants)):
        if wants:
            out.append((batch, first, sizes[i].astype("<u4").tobytes(), _narrow(np.concatenate(back[0][i])), _narrow(np.concatenate(back[1][i])), None, 0, 0, 0))
    return pd.DataFrame(out, columns=names)


def _judge(group: pd.DataFrame, vocabulary: int, totals: tuple[int, int]) -> pd.DataFrame:
    """The texts of one batch by the sums of its keys."""
    docs = group[group.range < 0].docs
    told = group[group.range >= 0].sort_values("range")
    if len(docs) != 1:
        raise ValueError("a batch of texts was lost")
    table = pa.ipc.open_stream(docs.iloc[0]).read_all()
    word, pair, counts = _hashed(raw(table.column("text").combine_chunks()))
    keys, places = _keys(word, pair, counts)
    del word, pair
    sizes = [np.frombuffer(x, "<u4") for x in told.n_keys]
    if [sum(int(n[i]) for n in sizes) for i in range(2)] != [len(k) for k in keys]:
        raise ValueError("the sums of a batch differ from its keys")
    del keys
    text_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    counted = np.array(table.column("counted").to_pylist(), dtype=bool)
    chosen = counted & np.array(table.column("chosen").to_pylist(), dtype=bool)
    own = [_own(x, text_of) for x in places]
    none = counts == 0
    columns = []
    for name, total, held in zip(("target", "everything"), totals, (chosen, counted)):
        pieces = [_split(x, n) for x, n in zip(told[name], sizes)] or [[np.zeros(0, np.int64)] * 3]
        sums = [np.concatenate([x[kind] for x in pieces]) for kind in range(3)]
        del pieces
        # a text is scored as if it hadn't been counted itself
        mine = held[text_of]
        left = lambda kind: (sums[kind][places[kind]] - own[kind] * mine).astype(np.float64)  # noqa: B023, E731
        losses = left(0)
        losses += 1
        losses *= K / ((total - counts * held)[text_of] + vocabulary)
        losses += left(2)
        np.log(losses, out=losses)
        losses = np.log(left(1) + K) - losses
        columns.append(np.bincount(text_of, weights=losses, minlength=len(counts)) / np.maximum(counts, 1))
    columns.append(columns[0] - columns[1])
    masked = [pa.array(x, pa.float64(), mask=none) for x in columns]
    return pa.table([table.column("id"), pa.array(counts.astype(np.int64)), *masked], names=["id", "n_tokens", "target_loss", "background_loss", "score"])


@dataclass
class Models:
    """What the target and the background model are counted over; they are counted as they are met by the scored keys."""

    docs: DataFrame
    chosen: Column
    text_col: str
    text_bytes: int


def fit(docs: DataFrame, chosen: Column, text_col: str = "text", text_bytes: int | None = None) -> Models:
    """Target and background model. ``text_bytes``, the length of all texts, is found if it is not given."""
    if text_bytes is None:
        text_bytes = length(docs, text_col)
    return Models(docs, chosen, text_col, text_bytes)


def length(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0


def _keep_alone(scratch: Scratch, df: DataFrame) -> DataFrame:
    """The written table, without the shuffle files it was made from."""
    conf, name = scratch.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return scratch.keep(df, "sums")
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``.

    Where ``docs`` is what the models are counted over, each row is read once for both.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    kind = dict(docs.dtypes)[id_col]
    same = docs is models.docs and text_col == models.text_col
    mark = F.coalesce(models.chosen.cast("boolean"), F.lit(False)).alias("chosen")
    yes, no = F.lit(True), F.lit(False)
    own = (F.col(f"`{id_col}`") if same else F.lit(None).cast(kind)).alias("id")
    rows = models.docs.select(own, F.col(f"`{models.text_col}`").alias("text"), mark, yes.alias("counted"), F.lit(same).alias("scored"))
    size = models.text_bytes
    if not same:
        rows = rows.union(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), no, no, yes))
        size += length(docs, text_col)
    ranges = 1 << max(FAN - 1, size // RANGE, 1).bit_length()
    asked = rows.mapInArrow(_asker(ranges), ASKED)
    told = _keep_alone(scratch, asked.groupBy("range").applyInPandas(_sum, TOLD))
    vocabulary, total, total_target = (x or 0 for x in told.agg(F.sum("vocabulary"), F.sum("total"), F.sum("total_target")).first())
    vocabulary = max(vocabulary, WORDS)

    def judge(group: pa.Table) -> pa.Table:
        columns = group.select(["range", "n_keys", "everything", "target", "docs"]).to_pandas()
        return _judge(columns, vocabulary, (total_target, total))

    out = told.where("batch >= 0").groupBy("batch").applyInArrow(judge, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", id_col)
