"""Item-to-item association for all anchors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import association


def scores(cooc: DataFrame, counts: DataFrame, digits: int | None = 6) -> DataFrame:
    """(a, b, cnt, score)."""
    left = counts.select(F.col("product_id").alias("a"), F.col("cnt").alias("count_a"))
    right = counts.select(F.col("product_id").alias("b"), F.col("cnt").alias("count_b"))
    score = association(F.col("cnt"), F.col("count_a"), F.col("count_b"))
    out = cooc.join(left, "a").join(right, "b")
    return out.select("a", "b", "cnt", (F.round(score, digits) if digits is not None else score).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "a", item: str = "b", score: str = "score", positive: bool = True, rank: str = "rank") -> DataFrame:
    """The ``k`` best items of each key, ties by ascending item; without self and, if asked, without scores of 0 or less."""
    kept = scored.where(F.col(key) != F.col(item))
    if positive:
        kept = kept.where(F.col(score) > 0)
    order: list[Column] = [F.col(score).desc(), F.col(item).asc()]
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)
