"""Product dimension, category exclusion and profile reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_dimension(products: DataFrame, aisles: DataFrame, departments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Products with aisle and department names; translated names win where there are any; null texts become ''."""
    out = products.join(aisles, "aisle_id", "left").join(departments, "department_id", "left")
    if names is not None:
        out = out.join(names, "product_id", "left").withColumn("product_name", F.coalesce("product_name_vi", "product_name")).drop("product_name_vi")
    return out.na.fill("", ["product_name", "aisle", "department"])


def excluded_products(dimension: DataFrame, departments: list[str]) -> DataFrame:
    return dimension.where(F.col("department").isin(departments)).select("product_id")


def without(rows: DataFrame, excluded: DataFrame, key: str = "product_id") -> DataFrame:
    """Anti join, so null keys stay and a null in the list removes nothing."""
    return rows.join(excluded, key, "left_anti")


def filter_stats(dimension: DataFrame, lines: DataFrame, departments: list[str]) -> DataFrame:
    """One row: products and lines before and after the exclusion; the removed share is of the kept lines."""
    gone = excluded_products(dimension, departments)
    a = dimension.agg(F.count("*").alias("products"), F.count_if(F.col("department").isin(departments)).alias("products_excluded"))
    b = lines.join(gone.withColumn("x", F.lit(1)), "product_id", "left").agg(F.count("*").alias("lines"), F.count("x").alias("lines_removed"))
    out = a.join(F.broadcast(b))
    kept = F.col("lines") - F.col("lines_removed")
    return out.select("products", "products_excluded", (F.col("products") - F.col("products_excluded")).alias("products_kept"), "lines", "lines_removed", kept.alias("lines_kept"), F.round(F.coalesce(F.try_divide(100.0 * F.col("lines_removed"), kept), F.lit(0.0)), 6).alias("removed_pct_of_kept"))


def basket_profile(lines: DataFrame) -> DataFrame:
    size = lines.groupBy("order_id").agg(F.count("*").alias("n"))
    quantile = lambda p: F.expr(f"percentile(n, {p})")
    return size.agg(F.count("*").alias("orders"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("min"), quantile(0.25).alias("p25"), quantile(0.5).alias("p50"), quantile(0.75).alias("p75"), F.max("n").alias("max"))


def product_tail(counts: DataFrame, bounds: tuple[int, ...] = (10, 30, 50)) -> DataFrame:
    """Products seen fewer times than each bound, and their share in percent."""
    return counts.agg(F.count("*").alias("products"), *[x for b in bounds for x in (F.count_if(F.col("cnt") < b).alias(f"below_{b}"), F.round(100.0 * F.count_if(F.col("cnt") < b) / F.count("*"), 6).alias(f"pct_below_{b}"))])


def lookup(dimension: DataFrame, ids: list[int]) -> DataFrame:
    """(product_id, product_name, department) of a few given ids; unknown ones are named Unknown(id)."""
    asked = dimension.sparkSession.createDataFrame([(i,) for i in ids], "product_id long")
    # the given ids are the small side, so the dimension isn't moved
    out = dimension.select("product_id", "product_name", "department").join(F.broadcast(asked), "product_id", "right")
    return out.select("product_id", F.coalesce("product_name", F.concat(F.lit("Unknown("), F.col("product_id").cast("string"), F.lit(")"))).alias("product_name"), F.coalesce("department", F.lit("")).alias("department"))
