"""Near-duplicate embeddings: all pairs by cosine, in PCA-ordered tiles.

Unit vectors are turned into the principal axes of the table, so leading dimensions hold most of a product. Rows fall
into cells of the first two axes as wide as the largest distance that the threshold allows, so partners lie in the
same or an adjacent cell; cells are cut into tiles of bounded size. A pair of tiles first multiplies the leading
dimensions; these plus the product of the suffix norms bound the cosine, and rows and columns that cannot reach the
threshold drop out before the next dimensions. What is left is compared by the cosine of the given vectors in double
precision.

Equal vectors are one class, represented by its first row and weighted by its rows, so copies are never paired. Tiles
hold the vectors as given, floats as floats. The meetings of tiles are dealt into rounds that each move a bounded part
of the table, and a round's shuffle files go with it, so the disk in use stays in proportion to the table however
many tiles meet; the time does not, as each tile meets all of its own and adjacent cells.

Defined cases: vectors that are null, zero, or hold null or non-finite components are linked with nothing and kept.
Shorter vectors count as ending in zeros. Null or repeated ids are rows of their own, ordered by id (nulls last); a
component's id is that of its first row. Labels and other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import row_by_row, shuffles_dropped
from .components import components
from .util import Scratch, keyed

THRESHOLD = 0.95
#: Bytes of vectors in a tile, about, and the most rows.
TILE_BYTES, TILE_ROWS = 2 << 20, 8192
#: Bytes of tiles that a round may move at least; a round moves half of the table if that is more.
ROUND_BYTES = 256 << 20
STEPS = (16, 32)
SUB = 1024
SLACK = 1e-5


def _values(column: pa.Array, width: int) -> np.ndarray:
    """Components as double rows of ``width``; rows that can't be compared are zero."""
    out = np.zeros((len(column), width))
    lists = column.cast(pa.list_(pa.float64()))
    flat, ends = lists.values, lists.offsets.to_numpy()
    size = np.diff(ends)
    values = flat.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]  # a null component is not a number here
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)] = values
    finite = np.isfinite(out).all(axis=1)
    if column.null_count:
        finite &= column.is_valid().to_numpy(zero_copy_only=False)
    out[~finite] = 0
    return out


def _units(out: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    width = out.shape[1]
    largest = np.abs(out).max(axis=1, keepdims=True) if width else np.zeros((len(out), 1))
    out = np.divide(out, largest, out=np.zeros_like(out), where=largest > 0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return _units(_values(column, width))


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, by falling eigenvalue."""

    def moments(stream):
        total = np.zeros((width, width))
        for batch in stream:
            x = _matrix(batch.column("text"), width)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "row": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(group):
        return pd.DataFrame({"i": [group.i.iloc[0]], "row": [sum(np.frombuffer(x) for x in group.row).tobytes()]})

    parts = rows.select("text").mapInArrow(moments, "i int, row binary").groupBy("i").applyInPandas(add, "i int, row binary").collect()
    matrix = np.zeros((width, width))
    for i, row in parts:
        matrix[i] = np.frombuffer(row)
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1].copy()


def linked(a: np.ndarray, b: np.ndarray, threshold: float, steps=STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of ``a`` and ``b``, unit vectors on principal axes, that may reach the threshold.

    Each step's product holds one more column, the suffix norms, so that it is the bound itself.
    """
    width = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    for step in [s for s in steps if s < width] + [width]:
        bound = np.hstack((a[rows, :step], np.linalg.norm(a[rows, step:], axis=1, keepdims=True))).astype(np.float32)
        other = np.hstack((b[cols, :step], np.linalg.norm(b[cols, step:], axis=1, keepdims=True))).astype(np.float32)
        open_ = bound @ other.T >= threshold - SLACK
        if step == width:
            i, j = np.nonzero(open_)
            return rows[i], cols[j]
        live = open_.any(axis=1)
        if not live.any():
            break
        rows, cols = rows[live], cols[open_.any(axis=0)]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _spread(n: int, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least linked place of each of ``n`` rows and ``m`` columns (counted on from ``n``), by min-label passes."""
    label = np.arange(n + m)
    order = np.argsort(j, kind="stable")
    row_at, row_of = np.unique(i, return_index=True)
    col_at, col_of = np.unique(j[order], return_index=True)
    while True:
        new = label.copy()
        new[row_at] = np.minimum(new[row_at], np.minimum.reduceat(new[n + j], row_of))
        new[n + col_at] = np.minimum(new[n + col_at], np.minimum.reduceat(new[i[order]], col_of))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(keys_a, a, keys_b, b, axes: np.ndarray, threshold: float, same: bool, rows_a=None, rows_b=None):
    """Link counts per key and edges that span the links of two tiles; a vector counts as ``rows_a`` or ``rows_b`` rows."""
    rows_a = np.ones(len(a), np.int64) if rows_a is None else rows_a
    rows_b = np.ones(len(b), np.int64) if rows_b is None else rows_b
    ra, rb = a @ axes, b @ axes
    ka, kb, edges_a, edges_b = [], [], [], []
    for x in range(0, len(a), SUB):
        for y in range(x if same else 0, len(b), SUB):
            i, j = linked(ra[x : x + SUB], rb[y : y + SUB], threshold)
            for s in range(0, len(i), 1 << 18):
                p, q = i[s : s + (1 << 18)] + x, j[s : s + (1 << 18)] + y
                sure = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
                if same:
                    sure &= p < q
                p, q = p[sure], q[sure]
                if len(p):
                    # exact, as rows are far fewer than 2^53
                    ka.append(np.bincount(p, rows_b[q], minlength=len(a)).astype(np.int64))
                    kb.append(np.bincount(q, rows_a[p], minlength=len(b)).astype(np.int64))
                    rows, at_p = np.unique(p, return_inverse=True)
                    cols, at_q = np.unique(q, return_inverse=True)
                    names = np.concatenate((keys_a[rows], keys_b[cols]))
                    order = np.argsort(at_p, kind="stable")
                    label = _spread(len(rows), len(cols), at_p[order], at_q[order])
                    edges_a.append(names)
                    edges_b.append(names[label])
    if not ka:
        return None
    na, nb = sum(ka), sum(kb)
    counts = pd.concat([pd.Series(na[na > 0], keys_a[na > 0]), pd.Series(nb[nb > 0], keys_b[nb > 0])]).groupby(level=0).sum()
    edges = pd.DataFrame({"a": np.concatenate(edges_a), "b": np.concatenate(edges_b)}).query("a != b").drop_duplicates()
    return counts, edges


def _signed(width: int):
    def run(stream):
        for batch in stream:
            values = _values(batch.column("text"), width)
            good = values.any(axis=1)
            # one sign of zero
            prints = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in values[good] + 0.0]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").filter(pa.array(good)), "print": pa.array(prints, pa.binary())})

    return run


def _moved_in_rounds(meetings: DataFrame, tiles: DataFrame, meet, schema: str, scratch: Scratch) -> DataFrame:
    """What ``meet`` finds in every meeting; each round moves a bounded part of the tiles to their meetings."""
    spark = scratch.spark
    weight = tiles.select("cell", "slot", (F.octet_length("keys") * 2 + F.octet_length("units")).cast("long").alias("bytes"))
    member = meetings.select(F.array_distinct(F.array(*meetings.columns)).alias("sides"))
    all_bytes = weight.agg(F.sum("bytes")).first()[0] or 0
    met = member.select(F.explode("sides").alias("tile")).groupBy("tile.cell", "tile.slot").agg(F.count("*").alias("n"))
    moved = met.join(weight, ["cell", "slot"]).agg(F.sum(F.col("n") * F.col("bytes"))).first()[0] or 0
    rounds = max(1, -(-moved // max(ROUND_BYTES, all_bytes // 2)))
    path = scratch.path("found")
    with shuffles_dropped(spark), row_by_row(spark):
        for r in range(rounds):
            mine = member.where(F.pmod(F.xxhash64("sides"), F.lit(rounds)) == r).select("sides", F.explode("sides").alias("tile"))
            work = mine.select("sides", "tile.cell", "tile.slot").join(tiles, ["cell", "slot"]).select("sides", "keys", "rows", "units")
            work.groupBy("sides").applyInArrow(meet, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int | None = None) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` (the id of the first row reachable) and ``kept``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows, plain = keyed(vectors, scratch, id_col, vec_col)
    width = rows.agg(F.max(F.size("text"))).first()[0] or 0
    width = max(width, 1)
    kind = np.dtype("f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "f8")
    tile_rows = tile_rows or min(TILE_ROWS, max(1, TILE_BYTES // (width * kind.itemsize)))
    axes = principal_axes(rows, width)
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    dims = min(2, width)

    signed = scratch.keep(rows.select("key", "text").mapInArrow(_signed(width), "key long, print binary"), "signed")
    classes = scratch.keep(signed.groupBy("print").agg(F.min("key").alias("rep"), F.count("*").alias("rows")), "classes")
    copies = signed.count() > classes.count()
    given = rows.select("key", "text")
    if copies:
        given = given.join(classes.select(F.col("rep").alias("key"), "rows"), "key")
    else:
        given = given.withColumn("rows", F.lit(1).cast("long"))

    def place(stream):
        for batch in stream:
            values = _values(batch.column("text"), width)
            good = values.any(axis=1)
            values = values[good]
            cell = np.floor(_units(values) @ axes[:, :dims] / reach).astype(np.int64)
            names = cell[:, 0] * 100_003 + (cell[:, 1] if dims > 1 else 0)
            keys, weights = (batch.column(c).filter(pa.array(good)) for c in ("key", "rows"))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(names, pa.int64()), "key": keys, "rows": weights, "unit": pa.array([v.tobytes() for v in values.astype(kind)], pa.binary())})

    placed = given.mapInArrow(place, "cell long, key long, rows long, unit binary")
    # at most ((2 / reach) + 2) ** 2 cells
    tiles_of = {c: -(-n // tile_rows) for c, n in placed.groupBy("cell").count().collect()}
    cells = F.create_map(*[F.lit(x).cast("long") for c, n in tiles_of.items() for x in (c, n)]) if tiles_of else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"cell": group["cell"][:1], "slot": group["slot"][:1], "keys": [group["key"].to_numpy().tobytes()], "rows": [group["rows"].to_numpy().tobytes()], "units": [b"".join(group["unit"].to_pylist())]})

    # placed is made anew here; a row that rounding puts into another cell is still within reach of its partners
    dealt = placed.withColumn("slot", F.pmod(F.xxhash64("key"), F.coalesce(F.element_at(cells, F.col("cell")), F.lit(1).cast("long"))))
    tiles = scratch.keep(dealt.groupBy("cell", "slot").applyInArrow(pack, "cell long, slot long, keys binary, rows binary, units binary"), "tiles")
    names = tiles.select("cell", "slot")
    steps = [(x * 100_003 + y) for x in (0, 1) for y in ((-1, 0, 1) if dims > 1 else (0,)) if x or y >= 0]
    near = names.select("cell", "slot", F.explode(F.array(*[(F.col("cell") + s).alias("c") for s in steps])).alias("cell2"))
    # names of tiles that meet; each tile then goes once to every meeting
    meetings = near.join(names.toDF("cell2", "slot2"), "cell2").where("cell2 <> cell or slot <= slot2")
    meetings = meetings.select(F.struct("cell", "slot").alias("one"), F.struct(F.col("cell2").alias("cell"), F.col("slot2").alias("slot")).alias("other"))

    def meet(group: pa.Table) -> pa.Table:
        keys, weights = ([np.frombuffer(x, np.int64) for x in group[c].to_pylist()] for c in ("keys", "rows"))
        units = [_units(np.frombuffer(x, kind).reshape(-1, width).astype(float)) for x in group["units"].to_pylist()]
        if len(keys) != len(group["sides"][0].as_py()):
            raise ValueError("a tile was lost")
        found = compare(keys[0], units[0], keys[-1], units[-1], axes, threshold, len(keys) == 1, weights[0], weights[-1])
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in "abn"})
        counts, edges = found
        a = np.concatenate((counts.index.to_numpy(np.int64), edges.a.to_numpy(np.int64)))
        b = np.concatenate((np.full(len(counts), -1, np.int64), edges.b.to_numpy(np.int64)))
        return pa.table({"a": a, "b": b, "n": np.concatenate((counts.to_numpy(np.int64), np.zeros(len(edges), np.int64)))})

    found = _moved_in_rounds(meetings, tiles, meet, "a long, b long, n long", scratch)
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    parts = components(found.where("n = 0").select("a", "b"), scratch)
    scratch.drop(tiles)
    out = rows.select("key", "id")
    if copies:
        member = scratch.keep(signed.join(classes, "print").select("key", "rep", "rows"), "members")
        out = out.join(member, "key", "left").select("key", "id", F.coalesce("rep", "key").alias("rep"), (F.coalesce("rows", F.lit(1)) - 1).alias("copies"))
    else:
        out = out.select("key", "id", F.col("key").alias("rep"), F.lit(0).cast("long").alias("copies"))
    scratch.drop(signed, classes)
    out = out.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("key", "id", (F.coalesce("n_links", F.lit(0)) + F.col("copies")).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component"))
    if plain:
        out = out.withColumn("component_id", F.col("component").cast("long"))
    else:
        out = out.join(rows.select(F.col("key").alias("component"), F.col("id").alias("component_id")), "component", "left")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("key") == F.col("component")).alias("kept"))
