"""Sharding by proportional stratified interleaving.

Within each source the rows are ranked in a seeded shuffle. A row's fractional rank is (2 rank + 1) / (2 n) for the n
rows of its source; ordered by it, any stretch of rows holds the sources in the proportions of the whole. The order is
cut into shards whose row counts differ by one at most (law ``rows``).

Ranks come from range partitions whose counts are added up, so a source with a third of all rows is ranked by many
tasks. Only narrow rows (id, size, checksum, source) are moved, not texts.

Defined cases: a null text has no bytes (size 1, checksum 0); a null source is a source of its own; null ids go last
in ties; repeated rows are placed each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, ranked

SEED = "basketloom-1"


def interleave(docs: DataFrame, shards: int = 16, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``source``, ``place`` in the whole order, ``shard`` and ``slot``."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    rows = rows.withColumn("strat", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    rows = rows.withColumn("dice", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")))
    ordered = ranked(rows, scratch, ["strat", "dice", "id", "text_crc32"], "at")
    per_source = ordered.groupBy("strat").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    per_source = scratch.keep(per_source, "sources")
    ordered = ordered.join(per_source, "strat")
    ordered = ordered.withColumn("fraction", (2 * (F.col("at") - F.col("first")) + 1) / (2 * F.col("n")))
    placed = ranked(ordered.drop("at", "first", "n"), scratch, ["fraction", "strat", "dice", "id", "text_crc32"], "place")
    total = int(placed.count())
    shard = F.expr(f"cast((place * {shards}) div {max(total, 1)} as int)")
    # the first place of shard s is the least p with p * shards >= s * total
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "source", "place", "shard", "slot")
