"""Evaluation of ranked lists against ground-truth pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import f1


def common_keys(truth: DataFrame, vocabularies: list[DataFrame]) -> DataFrame:
    """Ground-truth anchors that every model knows."""
    return reduce(lambda keys, v: keys.join(v.select(F.col("product_id").alias("a")), "a", "left_semi"), vocabularies, truth.select("a").distinct())


def per_key(truth: DataFrame, ranked: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(a, n_true, n_recs, hits, precision, recall, f1, hit) of each key."""
    gt = truth.select("a", "b").distinct().join(keys, "a", "left_semi")
    size = gt.groupBy("a").agg(F.count("*").alias("n_true"))
    recs = ranked.where(F.col("rank") <= k).select("a", "b")
    hits = recs.join(gt.withColumn("ok", F.lit(1)), ["a", "b"], "left").groupBy("a").agg(F.count("*").alias("n_recs"), F.count("ok").alias("hits"))
    out = size.join(hits, "a", "left").na.fill(0, ["n_recs", "hits"])
    p, r = F.col("hits") / F.lit(float(k)), F.col("hits") / F.col("n_true").cast("double")
    return out.select("a", "n_true", "n_recs", "hits", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), (F.col("hits") > 0).cast("double").alias("hit"))


def _means(k: int) -> list:
    return [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"{c}_at_{k}") for c in ("precision", "recall", "f1", "hit")]


def fair(truth: DataFrame, ranked: DataFrame, keys: DataFrame, k: int, model: str) -> DataFrame:
    """Every key counts; one without recommendations counts as zeros."""
    rows = per_key(truth, ranked, keys, k)
    return rows.agg(F.lit(model).alias("model"), F.count("*").alias("test_set_size"), F.count(F.when(F.col("n_recs") == 0, 1)).alias("n_errors"), *_means(k))


def skipping(truth: DataFrame, ranked: DataFrame, keys: DataFrame, k: int, model: str) -> DataFrame:
    """Unknown keys, and those without recommendations, are left out of the means."""
    targets = truth.select("a").distinct()
    rows = per_key(truth, ranked, keys, k).where("n_recs > 0")
    total = targets.agg(F.count("*").alias("n_targets"))
    means = rows.agg(F.count("*").alias("n_evaluated"), *_means(k))
    return total.join(F.broadcast(means)).select(F.lit(model).alias("model"), "n_targets", "n_evaluated", (F.col("n_targets") - F.col("n_evaluated")).alias("n_skipped"), *[f"{c}_at_{k}" for c in ("precision", "recall", "f1", "hit")])


def compare(truth: DataFrame, panel: DataFrame, keys: DataFrame, k: int, models: tuple[str, ...]) -> DataFrame:
    """``fair`` of several models at once, over one panel (model, a, b, rank)."""
    gt = truth.select("a", "b").distinct().join(keys, "a", "left_semi")
    size = gt.groupBy("a").agg(F.count("*").alias("n_true")).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    recs = panel.where(F.col("rank") <= k).select("model", "a", "b").join(keys, "a", "left_semi")
    hits = recs.join(gt.withColumn("ok", F.lit(1)), ["a", "b"], "left").groupBy("model", "a").agg(F.count("*").alias("n_recs"), F.count("ok").alias("hits"))
    rows = size.join(hits, ["model", "a"], "left").na.fill(0, ["n_recs", "hits"])
    p, r = F.col("hits") / F.lit(float(k)), F.col("hits") / F.col("n_true").cast("double")
    rows = rows.select("model", "n_recs", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), (F.col("hits") > 0).cast("double").alias("hit"))
    return rows.groupBy("model").agg(F.count("*").alias("test_set_size"), F.count_if(F.col("n_recs") == 0).alias("n_errors"), *_means(k))
