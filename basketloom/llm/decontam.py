"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and cut into words at every ASCII character that is no letter or digit. Runs of ``LEAST`` words
that a document shares with a benchmark item are seeds. Where the seeds cover enough of the item, the two are tiled:
again and again the longest matches of words not yet marked, found by hashing all windows of a length (running
Karp-Rabin) and compared word by word, are marked in both, until none of ``LEAST`` words is left. The share of the
item's words in tiles, in whatever order they stand, is its coverage; a document is contaminated by an item whose
coverage is at least ``THRESHOLD``.

The items are broadcast in portions of bounded size; further portions are further passes over the rows as the one
before wrote them, without a shuffle, so one portion is held at a time.

Defined cases: a null or empty document is clean. Items without words match nothing; items shorter than ``LEAST``
words must be found whole. Each row is judged by itself, so null or repeated ids are kept as they are. An item's id may
be of any type that sorts; an item without id contaminates like any other, under a null id. Ties between items go to
the one that stands first by id, nulls last. Empty tables give no rows, or clean rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, batches, small_batches
from .words import BASE, INVERSE, powers, shingle_hashes, word_hashes

LEAST = 4
THRESHOLD = 0.5
#: Characters of benchmark text in one portion.
PORTION = 8_000_000
GAP = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
FILTER_BITS = 20


def normal(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.lower().encode() for x in column.to_pylist()]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, gap=GAP)


class _Sequence:
    """Words of one side of a tiling, their marks, and Karp-Rabin hashes of their windows."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.marked = np.zeros(len(words), bool)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)))))
        # brought to one power, so that equal windows have equal hashes wherever they stand
        self.down = powers(INVERSE, len(words) + 1)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of ``length`` unmarked words, and their hashes."""
        if length > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        covered = np.concatenate(([0], np.cumsum(self.marked)))
        at = np.flatnonzero(covered[length:] == covered[:-length])
        with np.errstate(over="ignore"):
            return at, (self.total[at + length] - self.total[at]) * self.down[at]

    def longest(self) -> int:
        """Length of the longest stretch of unmarked words."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.marked, [True])).astype(np.int8)))
        return int((edge[1::2] - edge[::2]).max(initial=0))


def _share(item: _Sequence, doc: _Sequence, length: int) -> bool:
    a, b = item.windows(length)[1], doc.windows(length)[1]
    return bool(len(a) and len(b) and np.isin(a, b).any())


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, words) of two word sequences; ties go to the first places.

    A window that both share holds shorter ones that both share, so the greatest length is found by halving; places of
    that length are then taken in order. No pairs of places are listed, however repetitive the texts are.
    """
    x, y = _Sequence(item), _Sequence(doc)
    tiles: list[tuple[int, int, int]] = []
    high = max(len(item), len(doc))
    while True:
        high = min(high, x.longest(), y.longest())
        low = least - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if _share(x, y, middle) else (low, middle - 1)
        if high < least:
            return tiles
        at_x, hash_x = x.windows(high)
        at_y, hash_y = y.windows(high)
        order = np.argsort(hash_y, kind="stable")
        sorted_y, places = hash_y[order], at_y[order]
        begin = np.searchsorted(sorted_y, hash_x, "left").tolist()
        end = np.searchsorted(sorted_y, hash_x, "right").tolist()
        # of each run of equal hashes, the first place that may still be free; marks only grow
        free: dict[int, int] = {}
        before = len(tiles)
        for i, lo, hi in zip(at_x.tolist(), begin, end):
            if lo == hi or x.marked[i] or x.marked[i + high - 1]:
                continue
            k = free.get(lo, lo)
            # tiles of one round are of one length, so a window is touched only at its ends
            while k < hi and (y.marked[places[k]] or y.marked[places[k] + high - 1] or (item[i : i + high] != doc[places[k] : places[k] + high]).any()):
                k += 1
            free[lo] = k
            if k < hi:
                j = int(places[k])
                x.marked[i : i + high] = True
                y.marked[j : j + high] = True
                tiles.append((i, j, high))
        if len(tiles) == before:  # only hashes were equal
            high -= 1


class Index:
    """Seeds of a portion of the items, by width: sorted hashes, their items and places."""

    def __init__(self, texts: list[bytes], least: int):
        hashes, counts = words_of(texts)
        ends = np.cumsum(counts)
        self.items = [hashes[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
        self.least = least
        self.seeds = {}
        for width in sorted({min(least, len(x)) for x in self.items} - {0}):
            mine = [k for k, x in enumerate(self.items) if min(least, len(x)) == width]
            sizes = np.array([len(self.items[k]) for k in mine])
            h, n = shingle_hashes(np.concatenate([self.items[k] for k in mine]), sizes, width)
            owner = np.repeat(np.array(mine), n)
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds[width] = (h[order], owner[order], place[order], bits)

    def covered(self, texts: list[bytes], threshold: float) -> list[list[tuple[int, float]]]:
        """For each text the items (by number) covered to at least ``threshold``, with their coverage."""
        words, counts = words_of(texts)
        first = np.cumsum(counts) - counts
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        for width, (seeds, owner, place, bits) in self.seeds.items():
            h, n = shingle_hashes(words, counts, width)
            at = np.flatnonzero(bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(seeds, h[at], "left"), np.searchsorted(seeds, h[at], "right")
            hit = high > low
            at, low, many = at[hit], low[hit], (high - low)[hit]
            text_of = np.searchsorted(np.cumsum(n), at, "right")
            pick = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            pairs = np.unique(np.stack((np.repeat(text_of, many), owner[pick], place[pick])), axis=1)
            for t, k, places in _grouped(pairs):
                item = self.items[k]
                mask = np.zeros(len(item) + width, bool)
                for w in range(width):
                    mask[places + w] = True
                if mask[: len(item)].sum() < threshold * len(item):
                    continue
                doc = words[first[t] : first[t] + counts[t]]
                share = sum(x[2] for x in tile(item, _around(doc, item), width)) / len(item)
                if share >= threshold:
                    out[t].append((k, share))
        return out


def _around(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """``doc`` with each stretch of words that the item lacks cut to one word, which no match can cross."""
    known = np.isin(doc, item)
    return doc[known | np.concatenate(([True], known[:-1]))]


def _grouped(pairs: np.ndarray):
    if pairs.shape[1]:
        change = np.flatnonzero((np.diff(pairs[0]) != 0) | (np.diff(pairs[1]) != 0)) + 1
        for block in np.split(pairs, change, axis=1):
            yield int(block[0, 0]), int(block[1, 0]), block[2]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = THRESHOLD, least: int = LEAST, text_col: str = "text", item_col: str = "item_id", portion: int = PORTION) -> DataFrame:
    """``row`` (a struct of the columns ``keep``) and ``found``: item and coverage, the greatest coverage first."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col("text").alias("item")).where("item is not null")
    kind = dict(items.dtypes)["item_id"]
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    portions = max(1, math.ceil(total / portion))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("found", F.expr(f"cast(array() as array<struct<item_id:{kind},coverage:double>>)"))
    for p in range(portions):
        mine = items.where(F.pmod(F.xxhash64("item", "item_id"), F.lit(portions)) == p).orderBy("item_id", "item").collect()
        if not mine:
            continue
        ids = [r[0] for r in mine]
        shared = spark.sparkContext.broadcast(Index([r[1].lower().encode() for r in mine], least))

        def run(stream, ids=ids, shared=shared):
            for batch in batches(stream, most=1 << 20):
                found = batch.column("found").to_pylist()
                for mine, hits in zip(found, shared.value.covered(normal(batch.column("text")), threshold)):
                    mine.extend({"item_id": ids[k], "coverage": share} for k, share in hits)
                    mine.sort(key=lambda x: (-x["coverage"], x["item_id"] is None, x["item_id"]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(found, batch.schema.field("found").type)], names=["row", "text", "found"])

        rows = rows.mapInArrow(run, rows.schema)
        if portions > 1:
            # written, so that no two portions are held at once
            rows = scratch.keep(rows, f"portion-{p}")
            shared.destroy()
    return rows.select("row", "found")


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per row: id, ``contaminated``, the best ``item_id`` with its ``coverage`` (else null and 0), and all ``item_ids``."""
    found = scan(docs, benchmark, [id_col], **how)
    return found.select(
        f"row.`{id_col}`",
        (F.size("found") > 0).alias("contaminated"),
        F.get("found", F.lit(0))["item_id"].alias("item_id"),
        F.coalesce(F.get("found", F.lit(0))["coverage"], F.lit(0.0)).alias("coverage"),
        F.array_sort(F.array_distinct("found.item_id")).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    return scan(docs, benchmark, docs.columns, **how).where(F.size("found") == 0).select("row.*")
