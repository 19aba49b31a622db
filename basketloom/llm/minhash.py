"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

A document's set holds its distinct shingles of ``width`` words (see ``words``) as 64-bit hashes. The signature needs
two permutations of the 32-bit universe only: the first scatters the shingles, the second, shifted circularly by k,
gives the k-th coordinate. ``rows_per_band`` coordinates make a band; sets that share a band are candidates.

Equal sets are one class, represented by its first document, so copies are never paired. Candidates that hang together
through shared bands form a family. Families are packed into tiles of bounded size; tiles are compared on the full
sets inside a task, which emits a forest of the links it finds and never their pairs. At first each tile is compared
with itself and with its family's first tile. Where a family of several tiles is then not yet one component, all its
members outside its largest component are packed anew and compared with each other and with that component, so every
pair of candidates is compared or known to be in one component, and no link is lost.

Defined cases: a null or wordless text has an empty set, is linked with nothing and kept. Null or repeated ids are
rows of their own, ordered by id (nulls last) and text; a component's id is that of its first row. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import Scratch, batches, keyed, raw
from .words import mix, shingle_hashes, word_hashes

#: Bytes of text whose shingles are held at once.
SLICE = 1 << 18
WIDTH = 5
PERCENT = 80
BANDS = 24
ROWS = 4
#: With 24 bands of 4 a pair at the threshold is missed with probability (1 - 0.8 ** 4) ** 24 = 3e-6.


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xD35A2D97)
    x ^= x >> np.uint32(15)
    return x


def signatures(sets: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of each set; ``starts`` are the sets' first places, none empty."""
    out = np.empty((len(starts), size), dtype=np.uint32)
    seen = _scatter((sets & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    x, y = np.empty_like(seen), np.empty_like(seen)
    with np.errstate(over="ignore"):
        for k in range(size):
            # the second permutation of the shifted place
            np.add(seen, np.uint32(k), out=x)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[:, k] = np.minimum.reduceat(x, starts)
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    hashes, sizes = shingle_hashes(*word_hashes(texts), width)
    ends = np.cumsum(sizes)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]


def _signed(width: int, bands: int, rows: int):
    def run(stream):
        for batch in batches(stream, most=SLICE):
            sets = shingle_sets(raw(batch.column("text")), width)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            prints: list = [None] * len(sets)
            if len(full):
                picked = [sets[i] for i in full]
                starts = np.cumsum(sizes[full]) - sizes[full]
                coordinates = signatures(np.concatenate(picked), starts, bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
                with np.errstate(over="ignore"):
                    h = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
                    for r in range(rows):
                        h = mix(h + coordinates[:, :, r] + np.uint64(r))
                for i, k, s in zip(full.tolist(), h.view(np.int64).tolist(), picked):
                    keys[i], prints[i] = k, hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["key", "id", "n", "print", "bands"],
            )

    return run


def _sets(width: int):
    def run(stream):
        for batch in batches(stream, most=SLICE):
            sets = shingle_sets(raw(batch.column("text")), width)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["rep", "members"])

    return run


def group(rows: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """``key``, ``id``, ``n`` (set size) and ``component`` (the least key reachable) of rows with key, id and text."""
    kind = dict(rows.dtypes)["id"]
    signed = rows.select("key", "id", "text").mapInArrow(_signed(width, bands, band_rows), f"key long, id {kind}, n long, print binary, bands array<long>")
    signed = scratch.keep(signed, "signed")
    classes = scratch.keep(signed.where("n > 0").groupBy("print").agg(F.min("key").alias("rep")), "classes")
    members = scratch.keep(signed.select("key", "id", "n", "print").join(classes, "print", "left").select("key", "id", "n", F.coalesce("rep", "key").alias("rep")), "members")
    banded = signed.join(classes.select(F.col("rep").alias("key")), "key", "left_semi").select(F.col("key").alias("rep"), "n", F.explode("bands").alias("bucket"))
    banded = scratch.keep(banded, "banded")
    shared = scratch.keep(banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min("rep").alias("a")).where("c > 1").select("bucket", "a"), "shared")
    stars = banded.join(shared, "bucket").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    family = scratch.keep(components(stars, scratch).toDF("rep", "family"), "families")
    scratch.drop(signed, banded, shared)
    wanted = family.select(F.col("rep").alias("key"))
    sets = scratch.keep(rows.select("key", "text").join(wanted.hint("merge"), "key", "left_semi").mapInArrow(_sets(width), "rep long, members array<long>"), "sets")
    known = scratch.keep(family.join(sets, "rep").select("family", "rep", F.size("members").cast("long").alias("n")), "known")
    held = scratch.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    scratch.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        links = _first_links(known, sets, percent, scratch)
        more = _other_links(known, sets, links, percent, scratch)
    finally:
        scratch.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    labels = scratch.keep(components(links if more is None else links.union(more), scratch).toDF("rep", "comp"), "labels")
    scratch.drop(sets, family, known)
    return members.join(labels, "rep", "left").select("key", "id", "n", F.coalesce("comp", "rep").alias("component"))


#: Shingles in a tile, about, and sets.
TILE_SHINGLES, TILE_SETS = 100_000, 400


def _tiles(placed: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Members of each group ``by`` with their sets as lists ``tile`` of bounded size, numbered ``slot``."""
    sizes = placed.groupBy(*by).agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    slots = F.greatest(F.ceil(F.col("shingles") / TILE_SHINGLES), F.ceil(F.col("sets") / TILE_SETS))
    dealt = placed.join(sizes.select(*by, slots.alias("slots")), by).select(*by, "slots", F.pmod(F.xxhash64("rep"), F.col("slots")).alias("slot"), "rep")
    return dealt.join(sets, "rep").groupBy(*by, "slots", "slot").agg(F.collect_list(F.struct("rep", "members")).alias("tile"))


def _first_links(known: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links within each tile, and between each tile and the first of its family."""
    tiles = scratch.keep(_tiles(known, sets, ["family"]), "tiles")
    many = tiles.where("slots > 1").select("family", "slot", "tile")
    first = many.groupBy("family").agg(F.min("slot").alias("pivot"))
    pivots = many.join(first, "family").where("slot = pivot").select("family", "pivot", F.col("tile").alias("other"))
    crossed = many.join(pivots, "family").where("slot <> pivot").select("tile", "other")
    none = F.lit(None).cast(tiles.schema["tile"].dataType)
    work = tiles.select("tile", none.alias("other")).union(crossed)
    out = scratch.keep(work.mapInArrow(_compare(percent), "a long, b long"), "links")
    scratch.drop(tiles)
    return out


def _other_links(known: DataFrame, sets: DataFrame, links: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links of members outside the largest component of families of several tiles."""
    sizes = known.groupBy("family").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    large = scratch.keep(sizes.where(f"shingles > {TILE_SHINGLES} or sets > {TILE_SETS}").select("family"), "large")
    if not large.head(1):
        return None
    labels = components(links, scratch).toDF("rep", "comp")
    now = scratch.keep(known.join(large, "family").join(labels, "rep", "left").select("family", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "labelled")
    counts = now.groupBy("family", "comp").agg(F.count("*").alias("c"))
    main = scratch.keep(counts.groupBy("family").agg(F.max(F.struct("c", "comp")).alias("x")).select("family", F.col("x.comp").alias("main")), "main")
    placed = scratch.keep(now.join(main, "family").select("family", (F.col("comp") == F.col("main")).alias("inside"), "rep", "n"), "placed")
    tiles = scratch.keep(_tiles(placed, sets, ["family", "inside"]).select("family", "inside", "slot", "tile"), "tiles")
    rest = tiles.where("not inside").select("family", F.col("slot").alias("own"), F.col("tile").alias("other"))
    pairs = tiles.join(rest, "family").where("inside or slot < own").select("tile", "other")
    none = F.lit(None).cast(tiles.schema["tile"].dataType)
    work = pairs.union(tiles.where("not inside").select("tile", none.alias("other")))
    out = scratch.keep(work.mapInArrow(_compare(percent), "a long, b long"), "more-links")
    scratch.drop(tiles, placed, main, now, large)
    return out


def common_sizes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    names = np.concatenate(a + b)
    owner = np.concatenate((np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])))
    right = np.arange(len(names)) >= sum(len(x) for x in a)
    _, column = np.unique(names, return_inverse=True)
    width = int(column.max()) + 1
    in_a, in_b = np.bincount(column[~right], minlength=width), np.bincount(column[right], minlength=width)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    shared = np.flatnonzero((in_a > 0) & (in_b > 0))
    place = np.full(width, -1)
    place[shared] = np.arange(len(shared))
    at, left = place[column], ~right
    for start in range(0, len(shared), 2048):
        stop = min(start + 2048, len(shared))
        use = (at >= start) & (at < stop)
        x, y = np.zeros((len(a), stop - start), np.float32), np.zeros((len(b), stop - start), np.float32)
        x[owner[use & left], at[use & left] - start] = 1
        y[owner[use & right], at[use & right] - start] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _compare(percent: int):
    def unpack(tile):
        keys = tile.field("rep").to_numpy(zero_copy_only=False)
        lists = tile.field("members")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        return keys, [values[x:y] for x, y in zip(ends[:-1], ends[1:])]

    def run(stream):
        for batch in stream:
            for r in range(batch.num_rows):
                ka, a = unpack(batch.column("tile")[r].values)
                same = not batch.column("other")[r].is_valid
                kb, b = (ka, a) if same else unpack(batch.column("other")[r].values)
                na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
                common = common_sizes(a, b)
                linked = 100 * common >= percent * (na[:, None] + nb[None, :] - common)
                if same:
                    linked = np.triu(linked, 1)
                i, j = np.nonzero(linked)
                if len(i):
                    names = np.concatenate((ka, kb))
                    label = spanning(len(a), len(b), i, j, same)
                    off = names != names[label]
                    yield pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[label][off])], names=["a", "b"])

    return run


def spanning(n: int, m: int, i: np.ndarray, j: np.ndarray, same: bool = False) -> np.ndarray:
    """For ``n`` rows and ``m`` columns (counted on from ``n``) linked at (i, j), i ascending: the least place that
    each is connected with, by passes of least labels; ``same``: columns are the rows."""
    label = np.arange(n + m)
    if same:
        label[n:] = label[:n]
    order = np.argsort(j, kind="stable")
    rows, row_at = np.unique(i, return_index=True)
    cols, col_at = np.unique(j[order], return_index=True)
    while True:
        new = label.copy()
        new[rows] = np.minimum(new[rows], np.minimum.reduceat(new[n + j], row_at))
        new[n + cols] = np.minimum(new[n + cols], np.minimum.reduceat(new[i[order]], col_at))
        if same:
            new[:n] = new[n:] = np.minimum(new[:n], new[n:])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the id of the first row reachable) and ``kept``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, plain = keyed(docs, scratch, id_col, text_col)
    out = group(rows, scratch, width, percent, **how)
    if plain:
        first = out.withColumn("component_id", F.col("component").cast(dict(rows.dtypes)["id"]))
    else:
        first = out.join(rows.select(F.col("key").alias("component"), F.col("id").alias("component_id")), "component", "left")
    return first.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("key") == F.col("component")).alias("kept"))


def first_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are the first of their component."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, _ = keyed(docs, scratch, id_col, text_col, with_row=True)
    out = group(rows.select("key", "id", "text"), scratch, width, percent, **how)
    gone = scratch.keep(out.where("key <> component").select("key"), "gone")
    return rows.join(gone.hint("merge"), "key", "left_anti").select("row.*")
