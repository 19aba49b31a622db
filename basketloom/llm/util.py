"""Shared plumbing: the shared scratch folder, row keys, distributed ranks and Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import file_system, shared_folder


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, tag: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:04d}-{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(tag)
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for table in tables:
            self.remove(getattr(table, "_scratch_path", None))

    def remove(self, path: str | None) -> None:
        if path:
            files, target = file_system(self.spark, path)
            files.delete(target, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of ``rows`` rows at most, as rows are whole documents here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> tuple[DataFrame, bool]:
    """Rows with a unique, non-null long ``key`` that sorts as ``id_col`` does (nulls last).

    Where the ids are unique integers the id is the key and nothing is moved. Null or repeated ids make the rows
    be sorted by (id, text) and written once, so that the keys stay the same if a task runs again.
    Returns rows with ``key``, ``id``, ``text`` and, ``with_row``, all columns as struct ``row``; and whether ids are keys.
    """
    picked = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")]
    if with_row:
        picked.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = docs.select(*picked)
    integral = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    if integral and not rows.groupBy("id").count().where("`count` > 1 or id is null").head(1):
        return rows.withColumn("key", F.col("id").cast("long")), True
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    return scratch.keep(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed"), False


def ranked(df: DataFrame, scratch: Scratch, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in the total order.

    The rows are dealt by range, sorted and written with partition and position; the counts of the partitions, one
    row each, are added up at the driver and joined back. No task sees more than its range. The written rows are those
    that ``Scratch.drop`` deletes.
    """
    n = partitions_for(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt, f"{name}-ranges")
    per = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min("_pos").alias("first"))
    before, offsets = 0, []
    for part, count, first in sorted(map(tuple, per.collect())):
        offsets.append((part, before - first))
        before += count
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _shift long")
    out = dealt.join(F.broadcast(table), "_part").withColumn(name, F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift")
    out._scratch_path = dealt._scratch_path
    return out


def batches(stream: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``most`` bytes of ``column``, one row at least."""
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Hands free memory to the system: a Python worker stays for the tasks and stages after this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
