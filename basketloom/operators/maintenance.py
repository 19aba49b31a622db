"""Cascading deletes as surviving rows, the checks after them, and the swap that makes them take effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import file_system


def survivors(child: DataFrame, parents: DataFrame, foreign: list[str], key: str) -> DataFrame:
    """Rows of ``child`` whose foreign keys all point to surviving parents; null keys point to none and stay."""
    out = child
    for column in foreign:
        gone = out.where(F.col(column).isNotNull()).select(column).distinct().join(parents.select(F.col(key).alias(column)), column, "left_anti")
        out = out.join(gone, column, "left_anti")
    return out


def orphans(child: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Number of rows whose parent is missing."""
    return child.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti").agg(F.count("*").alias("orphans"))


def cascade(keep: DataFrame, tables: list[tuple[str, DataFrame, str, list[str], str]]) -> dict[str, DataFrame]:
    """Survivors of each table, root first.

    ``tables`` lists (name, rows, key, foreign keys, parent name); a table may be the parent of several others, and have
    several foreign keys to its parent. The root has no foreign key and keeps the ids of ``keep`` (one column). An
    empty keep-list is an error, as it would delete everything.
    """
    if not keep.head(1):
        raise ValueError("the keep-list is empty")
    out: dict[str, DataFrame] = {}
    keys = {name: key for name, _, key, _, _ in tables}
    for name, rows, key, foreign, parent in tables:
        out[name] = survivors(rows, out[parent], foreign, keys[parent]) if foreign else rows.join(keep.toDF(key), key, "left_semi")
    return out


def doomed(rows: DataFrame, keep: DataFrame, key: str) -> tuple[int, int]:
    """Rows of the root table, and how many of them the keep-list lacks; without any, nothing is to be done."""
    total = rows.count()
    return total, total - rows.join(keep.toDF(key), key, "left_semi").count()


def swap(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Replace the Parquet tables of ``folder`` by the given ones, all or none.

    All are written beside the folder first; an error up to there leaves it as it was. Then the folder is renamed away
    and the new one into its place; if that fails, the old one is put back. Tables that aren't given are carried over.
    """
    files, old = file_system(spark, folder)
    mark = uuid.uuid4().hex
    staging, backup = f"{folder}.staging-{mark}", f"{folder}.backup-{mark}"
    _, new = file_system(spark, staging)
    _, aside = file_system(spark, backup)
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{staging}/{name}.parquet")
        for status in files.listStatus(old):
            name = status.getPath().getName()
            if name.removesuffix(".parquet") not in tables:
                spark.read.parquet(f"{folder}/{name}").write.parquet(f"{staging}/{name}")
        if not files.rename(old, aside):
            raise OSError(f"{folder} can't be moved")
        if not files.rename(new, old):
            files.rename(aside, old)
            raise OSError(f"{staging} can't be moved")
    except BaseException:
        files.delete(new, True)
        raise
    files.delete(aside, True)
