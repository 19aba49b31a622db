"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a groupBy with partial aggregation and a join whose two sides are both dealt by key, so that a hub with
a third of all edges is split. Each round is written to the shared folder; nothing is collected but a count. Once
``SMALL`` edges or fewer are left, a bounded table, the driver finishes them itself in place of further rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch

#: Edges that the driver labels, 16 bytes each.
SMALL = 500_000


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), ascending, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # the roots of both ends as well, so that whole trees are hung below the smaller one
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) of every node of an edge, the component being its least node."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.keep(pairs, "edges")
    state = _state(now)
    while state[0]:
        if state[0] <= SMALL:
            table = now.toArrow()
            nodes, least = labels_of(*(table.column(c).to_numpy().astype(np.int64) for c in "uv"))
            scratch.drop(now)
            done = pa.table({"node": pa.array(nodes), "component": pa.array(least)})
            return scratch.keep(scratch.spark.createDataFrame(done), "components")
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-least")
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.keep(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(now, least, large, least2)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
