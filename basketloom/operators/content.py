"""Content similarity: multi-field TF-IDF, overlap coefficient and the substitute filter.

Vectors are long tables (product_id, field, term, weight); similarities are computed for given candidate pairs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import overlap
from ..functions.text import clean_text, ngrams, tokens


def terms(products: DataFrame, column: str, longest: int = 1) -> DataFrame:
    """(product_id, term, tf) of one text field."""
    words = products.select("product_id", ngrams(tokens(clean_text(F.col(column))), longest).alias("w"))
    return words.select("product_id", F.explode("w").alias("term")).groupBy("product_id", "term").agg(F.count("*").alias("tf"))


def capped(term_table: DataFrame, cap: int) -> DataFrame:
    """Only the ``cap`` terms that are most frequent in the corpus, ties by term."""
    frequency = term_table.groupBy("term").agg(F.sum("tf").alias("cf"))
    # a global top-k: each task keeps its own k rows before one merges them
    kept = frequency.orderBy(F.col("cf").desc(), "term").limit(cap).select("term")
    return term_table.join(kept, "term", "left_semi")


def tfidf(products: DataFrame, column: str, longest: int = 1, cap: int = 15000, field: str | None = None, weight: float = 1.0) -> DataFrame:
    """Smooth idf, L2-normalised per product after the cap, times the field's weight."""
    counted = capped(terms(products, column, longest), cap)
    n = products.agg(F.count("*").alias("n"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("product_id")))
    return raw.select("product_id", F.lit(field or column).alias("field"), "term", (F.col("w") / length * weight).alias("weight"))


def multi_field(products: DataFrame, fields: list[tuple[str, int, int, float]]) -> DataFrame:
    """Union of the fields (column, longest n-gram, cap, weight); not normalised again."""
    out = None
    for column, longest, cap, weight in fields:
        one = tfidf(products, column, longest, cap, column, weight)
        out = one if out is None else out.unionByName(one)
    return out


def count_vectors(products: DataFrame, column: str = "product_name", cap: int = 15000) -> DataFrame:
    """(product_id, term) presence."""
    return capped(terms(products, column), cap).select("product_id", "term", "tf")


def tfidf_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, sim): dot products of candidate pairs, 0 without a shared term."""
    left = vectors.select(F.col("product_id").alias("a"), "field", "term", F.col("weight").alias("wa"))
    right = vectors.select(F.col("product_id").alias("b"), "field", "term", F.col("weight").alias("wb"))
    hit = pairs.select("a", "b").join(left, "a").join(right, ["b", "field", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return pairs.select("a", "b").join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def overlap_similarity(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, common, ovl) of candidate pairs over distinct capped tokens."""
    sets = counts.groupBy("product_id").agg(F.collect_set("term").alias("t"))
    left, right = sets.select(F.col("product_id").alias("a"), F.col("t").alias("ta")), sets.select(F.col("product_id").alias("b"), F.col("t").alias("tb"))
    none = F.expr("cast(array() as array<string>)")
    both = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce("ta", none).alias("ta"), F.coalesce("tb", none).alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", common.cast("long").alias("common"), overlap(common, F.size("ta"), F.size("tb")).alias("ovl"))


def ensemble_similarity(pairs: DataFrame, vectors: DataFrame, counts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(a, b, sim): alpha x overlap + (1 - alpha) x TF-IDF."""
    both = tfidf_similarity(pairs, vectors).join(overlap_similarity(pairs, counts), ["a", "b"])
    return both.select("a", "b", (alpha * F.col("ovl") + (1 - alpha) * F.col("sim")).alias("sim"))


def substitute_filter(candidates: DataFrame, similarity: DataFrame, has_vector: DataFrame, threshold: float) -> DataFrame:
    """``candidates`` (a, b, ...) without those as similar as ``threshold``; pairs lacking a vector pass.

    Adds ``sim`` (null where a or b has none) and ``is_cold``.
    """
    known = has_vector.select("product_id").distinct()
    flagged = candidates.join(known.select(F.col("product_id").alias("a"), F.lit(True).alias("ka")), "a", "left").join(known.select(F.col("product_id").alias("b"), F.lit(True).alias("kb")), "b", "left")
    cold = F.col("ka").isNull() | F.col("kb").isNull()
    joined = flagged.withColumn("is_cold", cold).join(similarity.select("a", "b", F.col("sim").alias("s")), ["a", "b"], "left")
    return joined.withColumn("sim", F.when(~F.col("is_cold"), F.coalesce("s", F.lit(0.0)))).where(F.col("is_cold") | (F.col("sim") < threshold)).drop("ka", "kb", "s")
