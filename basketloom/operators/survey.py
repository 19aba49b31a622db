"""Survey samples, ground-truth filtering and the overlap study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_tokens


def safe_pool(counts: DataFrame, least: int, vocabularies: list[DataFrame]) -> DataFrame:
    """(product_id, cnt) of products seen ``least`` times that all models know."""
    out = counts.where(F.col("cnt") >= least)
    for v in vocabularies:
        out = out.join(v.select("product_id").distinct(), "product_id", "left_semi")
    return out


#: The seed of the fixed arithmetic orders below.
SEED = 42


def targets(pool: DataFrame, number: int, popular_share: float = 1.0) -> DataFrame:
    """(product_id, chosen, place): up to ``number`` products of a pool (product_id, cnt), shuffled.

    The share ``popular_share`` of them are those with the greatest counts, the rest is drawn from all others: a sample
    of stated size is the feature. Both are top lists, so each task sends ``number`` rows at most.
    """
    n = min(number, pool.count())
    first = int(n * popular_share)
    popular = pool.orderBy(F.col("cnt").desc(), "product_id").limit(first).select("product_id", F.lit("popular").alias("chosen"))
    drawn = F.pmod(F.col("product_id") * 7919 + SEED * 104729, F.lit(1000003))
    rest = pool.join(popular, "product_id", "left_anti").orderBy(drawn, "product_id").limit(n - first).select("product_id", F.lit("random").alias("chosen"))
    order = [F.pmod(F.col("product_id") * 104729 + SEED * 7919, F.lit(1000003)), F.col("product_id")]
    return popular.union(rest).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def shuffled(pairs: DataFrame) -> DataFrame:
    """(a, b, place): the candidates of each target in a fixed arithmetic order."""
    order = [F.pmod(F.col("b") * 104729 + F.col("a") * 31 + SEED * 7919, F.lit(1000003)), F.col("b")]
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(*order)))


def summary(pairs: DataFrame) -> DataFrame:
    """One row: suggestions, targets that have any, and suggestions per target."""
    out = pairs.agg(F.count("*").alias("suggestions"), F.countDistinct("a").alias("targets"))
    return out.select("*", F.round(F.try_divide(F.col("suggestions"), F.col("targets")), 6).alias("per_target"))


def candidates(ranked: list[DataFrame], k: int) -> DataFrame:
    """Distinct (a, b) of the models' top lists."""
    out = None
    for r in ranked:
        one = r.where(F.col("rank") <= k).select("a", "b")
        out = one if out is None else out.union(one)
    return out.distinct()


def samples(targets: DataFrame, pairs: DataFrame, dimension: DataFrame) -> DataFrame:
    """Candidate pairs of the targets with names and departments; unknown products are named so."""
    side = lambda p: dimension.select(F.col("product_id").alias(p), F.col("product_name").alias(f"{p}_name"), F.col("department").alias(f"{p}_dept"))
    out = pairs.join(targets.select(F.col("product_id").alias("a")), "a", "left_semi").join(side("a"), "a", "left").join(side("b"), "b", "left")
    name = lambda p: F.coalesce(f"{p}_name", F.concat(F.lit("Unknown("), F.col(p).cast("string"), F.lit(")")))
    return out.select(F.col("a").alias("product_a_id"), name("a").alias("product_a_name"), F.coalesce("a_dept", F.lit("")).alias("product_a_dept"), F.col("b").alias("product_b_id"), name("b").alias("product_b_name"), F.coalesce("b_dept", F.lit("")).alias("product_b_dept"))


def classify(truth: DataFrame, similarity: DataFrame, has_vector: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim, kind): substitute (at least ``threshold`` alike), complementary, or cold (a or b without vector)."""
    known = has_vector.select("product_id").distinct()
    out = truth.join(known.select(F.col("product_id").alias("a"), F.lit(True).alias("ka")), "a", "left").join(known.select(F.col("product_id").alias("b"), F.lit(True).alias("kb")), "b", "left").join(similarity, ["a", "b"], "left")
    cold = F.col("ka").isNull() | F.col("kb").isNull()
    return out.select("a", "b", F.when(~cold, F.coalesce("sim", F.lit(0.0))).alias("sim"), F.when(cold, "cold").when(F.coalesce("sim", F.lit(0.0)) >= threshold, "substitute").otherwise("complementary").alias("kind"))


#: The fixed arithmetic order of sampled pairs: (a * LEFT + b * RIGHT) modulo PRIME, then a, then b.
LEFT, RIGHT, PRIME = 7919, 104729, 1000003


def overlap_classes(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products by their distinct token sets, and pairs of sets that share a token.

    Members: (product_id, c), ``c`` being the least product with the same set. Pairs: (p, q, overlap, common) for
    p <= q by an inverted index over sets, so that equal names are compared once; p = q stands for pairs within a set.
    """
    sets = products.select("product_id", F.array_sort(F.array_distinct(name_tokens(F.col("product_name")))).alias("t")).where(F.size("t") > 0)
    members = sets.select("product_id", F.min("product_id").over(Window.partitionBy("t")).alias("c"), "t")
    tokens = members.where("product_id = c").select("c", F.explode("t").alias("token"))
    hit = tokens.select(F.col("c").alias("p"), "token").join(tokens.select(F.col("c").alias("q"), "token"), "token").where("p <= q")
    pairs = hit.groupBy("p", "q").agg(F.count("*").alias("overlap"), F.array_join(F.array_sort(F.collect_list("token")), ", ").alias("common"))
    return members.select("product_id", "c"), pairs


def sample_per_overlap(products: DataFrame, most: int = 1000, levels: tuple[int, int] = (1, 10)) -> DataFrame:
    """(a, b, overlap, common): up to ``most`` unordered product pairs of each exact overlap: sampling is the feature.

    The first pairs in the fixed order are taken. The number of pairs of each overlap follows from the sizes of the
    sets, and with it how far into the order the sample reaches; a and b are joined by bands of that width of their
    parts of the order, so pairs beyond it aren't made. Where a band turns out too narrow, it is widened fourfold.
    """
    members, pairs = overlap_classes(products)
    members, pairs = members.persist(), pairs.where(F.col("overlap").between(*levels)).persist()
    size = members.groupBy("c").agg(F.count("*").alias("n"))
    counted = pairs.join(size.toDF("p", "np"), "p").join(size.toDF("q", "nq"), "q")
    number = F.when(F.col("p") == F.col("q"), F.expr("np * (np - 1) div 2")).otherwise(F.col("np") * F.col("nq"))
    # one row for each overlap
    wanted = {r[0]: r[1] for r in counted.groupBy("overlap").agg(F.sum(number)).collect() if r[1]}
    done, out = set(), None
    factor = 2
    while set(wanted) - done:
        bands = {x: min(PRIME, -(-PRIME * most * factor // wanted[x])) for x in wanted if x not in done}
        found = _in_bands(members, pairs, bands, products.sparkSession).persist()
        got = {r[0]: r[1] for r in found.groupBy("overlap").count().collect()}
        full = [x for x in bands if got.get(x, 0) >= min(most, wanted[x])]
        done |= set(full)
        kept = found.where(F.col("overlap").isin(full))
        out = kept if out is None else out.union(kept)
        factor *= 4
    if out is None:
        return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), "overlap", "common").where("false")
    order = [F.expr(f"(a * {LEFT} + b * {RIGHT}) % {PRIME}"), F.col("a"), F.col("b")]
    return out.withColumn("r", F.row_number().over(Window.partitionBy("overlap").orderBy(*order))).where(F.col("r") <= most).drop("r")


def _in_bands(members: DataFrame, pairs: DataFrame, bands: dict[int, int], spark) -> DataFrame:
    """Pairs a < b of each overlap whose place in the fixed order lies below the overlap's band."""
    band = spark.createDataFrame(sorted(bands.items()), "overlap long, band long")
    known = pairs.join(F.broadcast(band), "overlap")
    both = known.union(known.where("p <> q").select("overlap", F.col("q").alias("p"), F.col("p").alias("q"), "common", "band"))
    # the parts of a and of b add up to the place; b's stands twice, as the sum is taken modulo the prime
    left = members.select(F.col("c").alias("p"), F.col("product_id").alias("a"), F.pmod(-F.col("product_id") * LEFT, F.lit(PRIME)).alias("low"))
    right = both.select("q", "band").distinct().join(members.select(F.col("c").alias("q"), F.col("product_id").alias("b"), F.pmod(F.col("product_id") * RIGHT, F.lit(PRIME)).alias("r")), "q")
    right = right.select("q", "band", "b", F.explode(F.array("r", F.col("r") + PRIME)).alias("r")).withColumn("slot", F.expr("r div band"))
    asked = both.join(left, "p").select("overlap", "common", "q", "band", "a", "low", F.explode(F.array(F.expr("low div band"), F.expr("low div band + 1"))).alias("slot"))
    return asked.join(right, ["q", "band", "slot"]).where("a < b and r >= low and r < low + band").select("a", "b", "overlap", "common")


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, label, n) over [0, 1]; the last bin is closed and values outside are left out."""
    inside = values.where(F.col(column).between(0, 1))
    bucket = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n")).select("bin", F.format_string("%.1f-%.1f", F.col("bin") / float(bins), (F.col("bin") + 1) / float(bins)).alias("label"), "n")
