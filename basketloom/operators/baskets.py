"""Baskets and ordered co-occurrence.

A basket line is (order_id, pos, product_id). Pairs are counted per direction: for i < j in one order with different
products, (item i, item j) counts once, so repeated products multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(lines: DataFrame, order: list[str], order_id: str = "order_id") -> DataFrame:
    """``pos``, 1-based in each order."""
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy(order_id).orderBy(*order)))


def known_only(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of products in the dimension."""
    return lines.join(products.select("product_id"), "product_id", "left_semi")


def sentences(lines: DataFrame, least: int = 2) -> DataFrame:
    """Product ids of each order in cart order; shorter baskets are dropped. A basket is bounded by its order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "product_id"))), lambda x: x["product_id"])
    return lines.groupBy("order_id").agg(items.alias("items")).where(F.size("items") >= least)


def directed_pairs(lines: DataFrame) -> DataFrame:
    """(a, b, cnt): one exchange by order serves grouping; pairs are made in the row and summed map-side first."""
    items = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("pos", "product_id"))).alias("x")).where(F.size("x") > 1)
    firsts = items.select(F.col("x").alias("all"), F.posexplode("x").alias("i", "one"))
    pairs = firsts.select(F.col("one.product_id").alias("a"), F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("two"))
    return pairs.select("a", F.col("two.product_id").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("cnt"))


def supported(pairs: DataFrame, min_support: int) -> DataFrame:
    """Directed pairs with enough support; a bound of 0 or less keeps all."""
    return pairs.where(F.col("cnt") >= min_support) if min_support > 0 else pairs


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of each surviving pair, counts of surviving directions added."""
    both = pairs.select("a", "b", "cnt").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cnt"))
    return both.groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))


def cooccurrence(lines: DataFrame, min_support: int, mode: str = "directed") -> DataFrame:
    """Symmetric counts; ``mode`` tells whether support holds for each direction or for their sum."""
    if mode == "directed":
        return symmetric(supported(directed_pairs(lines), min_support))
    return supported(symmetric(directed_pairs(lines)), min_support)


def item_counts(lines: DataFrame) -> DataFrame:
    """Rows per product, repeats included."""
    return lines.groupBy("product_id").agg(F.count("*").alias("cnt"))
