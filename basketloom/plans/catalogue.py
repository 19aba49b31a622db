"""Every reference operator as a query over the fixture tables, with DuckDB SQL beside it.

Parts are products, brands aisles and part types departments; orders with status O, F and P are the prior, train and
test splits; ``embeddings`` are product vectors, whose first and last 32 dimensions serve as two models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import baskets, catalog, content, itemcf

QUERIES: dict = {}
SQL: dict[str, str] = {}
EXCLUDED = ["PROMO", "ECONOMY"]
FIELDS = [("product_name", 2, 15000, 1.0), ("aisle", 1, 500, 0.8), ("department", 1, 100, 0.6)]
PART_SUPPORT = 2


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- fixture views


def dimension(s, d) -> DataFrame:
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.regexp_replace("p_brand", "#", "").alias("aisle"), F.regexp_replace("p_brand", "Brand#", "").cast("long").alias("aisle_id"), F.col("p_type").alias("department"))


def part_lines(s, d, statuses: list[str] | None = None) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber", F.col("l_partkey").alias("product_id"))
    if statuses:
        o = table(s, d, "orders").where(F.col("o_orderstatus").isin(statuses)).select(F.col("o_orderkey").alias("order_id"))
        li = li.join(o, "order_id", "left_semi")
    return baskets.with_position(li, ["l_linenumber", "product_id"]).select("order_id", "pos", "product_id")


def brand_lines(s, d) -> DataFrame:
    brand = dimension(s, d).select("product_id", "aisle_id")
    return part_lines(s, d).join(brand, "product_id").select("order_id", "pos", F.col("aisle_id").alias("product_id"))


DIM = """dim AS (SELECT p_partkey AS product_id, p_name AS product_name, replace(p_brand, '#', '') AS aisle,
  CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS aisle_id, p_type AS department FROM part)"""
PART_LINES = """lines AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos,
  l_partkey AS product_id FROM lineitem)"""
SPLIT_LINES = """lines AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos,
  l_partkey AS product_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ({})))"""
BRAND_LINES = """lines AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos,
  CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DIRECTED = """directed AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS cnt FROM lines x JOIN lines y
  ON x.order_id = y.order_id AND x.pos < y.pos AND x.product_id <> y.product_id GROUP BY 1, 2)"""


def _cooc(support: int) -> str:
    return f"""{DIRECTED}, kept AS (SELECT * FROM directed WHERE cnt >= {support}),
cooc AS (SELECT a, b, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT a, b, cnt FROM kept UNION ALL SELECT b, a, cnt FROM kept) GROUP BY 1, 2)"""


SCORED = """items AS (SELECT product_id, count(*) AS c FROM lines GROUP BY 1),
scored AS (SELECT a, b, cnt, round(cnt / sqrt(CAST(p.c AS DOUBLE) * q.c) * (CAST(cnt AS DOUBLE) / p.c) * ln(1 + cnt), 6) AS score
  FROM cooc JOIN items p ON a = p.product_id JOIN items q ON b = q.product_id)"""


def _top(source: str, k: int, name: str = "ranked", positive: bool = True) -> str:
    more = "AND score > 0" if positive else ""
    return f"""{name} AS (SELECT * FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM {source} WHERE a <> b {more}) WHERE rank <= {k})"""


def item_cf(s, d, lines: DataFrame | None = None, support: int = PART_SUPPORT) -> DataFrame:
    lines = part_lines(s, d) if lines is None else lines
    return itemcf.scores(baskets.cooccurrence(lines, support), baskets.item_counts(lines))


# ---------------------------------------------------------------- dimension, filter, profile


@query(f"WITH {DIM} SELECT product_id, CASE WHEN product_id % 3 = 0 THEN upper(product_name) ELSE product_name END AS product_name, aisle, department FROM dim")
def product_dim(s, d):
    p = table(s, d, "part")
    products = p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("aisle_id"), F.col("p_type").alias("department_id"))
    aisles = p.select(F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("aisle_id"), F.regexp_replace("p_brand", "#", "").alias("aisle")).distinct()
    departments = p.select(F.col("p_type").alias("department_id"), F.col("p_type").alias("department")).distinct()
    names = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("product_id"), F.upper("p_name").alias("product_name_vi"))
    return catalog.product_dimension(products, aisles, departments, names).select("product_id", "product_name", "aisle", "department")


@query("SELECT l_orderkey AS order_id, l_linenumber, l_partkey AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type NOT IN ('PROMO', 'ECONOMY')")
def category_exclusion(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber", F.col("l_partkey").alias("product_id"))
    return catalog.without(li, catalog.excluded_products(dimension(s, d), EXCLUDED)).select("order_id", "l_linenumber", "product_id")


@query("""SELECT p.n AS products, p.x AS products_excluded, p.n - p.x AS products_kept, l.n AS lines, l.x AS lines_removed, l.n - l.x AS lines_kept,
round(100.0 * l.x / (l.n - l.x), 6) AS removed_pct_of_kept FROM
(SELECT count(*) AS n, count(*) FILTER (WHERE p_type IN ('PROMO', 'ECONOMY')) AS x FROM part) p,
(SELECT count(*) AS n, count(*) FILTER (WHERE p_type IN ('PROMO', 'ECONOMY')) AS x FROM lineitem JOIN part ON l_partkey = p_partkey) l""")
def filter_stats(s, d):
    return catalog.filter_stats(dimension(s, d), table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id")), EXCLUDED)


@query("SELECT p_type AS department, count(*) AS products FROM part WHERE p_type IN ('PROMO', 'ECONOMY') GROUP BY 1")
def excluded_by_department(s, d):
    dim = dimension(s, d)
    return dim.join(catalog.excluded_products(dim, EXCLUDED), "product_id", "left_semi").groupBy("department").agg(F.count("*").alias("products"))


SPLIT = "CASE o_orderstatus WHEN 'O' THEN 'prior' WHEN 'F' THEN 'train' ELSE 'test' END"


@query(f"""SELECT eval_set, count(*) AS orders, count(DISTINCT o_custkey) AS users, round(count(*) / CAST(count(DISTINCT o_custkey) AS DOUBLE), 6) AS orders_per_user,
round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT *, {SPLIT} AS eval_set FROM orders) GROUP BY 1""")
def orders_by_split(s, d):
    o = table(s, d, "orders").withColumn("eval_set", F.expr(SPLIT))
    g = o.groupBy("eval_set").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("users"))
    total = g.agg(F.sum("orders").alias("total"))
    return g.join(F.broadcast(total)).select("eval_set", "orders", "users", F.round(F.col("orders") / F.col("users").cast("double"), 6).alias("orders_per_user"), F.round(100.0 * F.col("orders") / F.col("total"), 6).alias("share"))


@query("""SELECT count(*) AS users, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def orders_per_user(s, d):
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("users"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query("""SELECT l_orderkey AS order_id, l_partkey AS product_id, o_orderstatus AS split FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'F')""")
def union_prior_train(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    one = lambda x: li.join(o.where(F.col("o_orderstatus") == x), li.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.lit(x).alias("split"))
    return one("O").unionByName(one("F"))


@query("""SELECT count(*) AS orders, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS p25,
quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS max FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def basket_profile(s, d):
    return catalog.basket_profile(table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id")))


@query("""SELECT count(*) AS products, """ + ", ".join(f"count(*) FILTER (WHERE c < {b}) AS below_{b}, round(100.0 * count(*) FILTER (WHERE c < {b}) / count(*), 6) AS pct_below_{b}" for b in (10, 30, 50)) + """
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey)""")
def product_tail(s, d):
    return catalog.product_tail(baskets.item_counts(table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"))))


@query(f"WITH {DIM} SELECT aisle, count(*) AS lines FROM lineitem JOIN dim ON l_partkey = product_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_aisles(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"))
    return li.join(dimension(s, d), "product_id").groupBy("aisle").agg(F.count("*").alias("lines")).orderBy(F.col("lines").desc(), "aisle").limit(10)


@query(f"WITH {DIM} SELECT department, count(*) AS lines, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem JOIN dim ON l_partkey = product_id GROUP BY 1")
def department_distribution(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"))
    g = li.join(dimension(s, d), "product_id").groupBy("department").agg(F.count("*").alias("lines"))
    return g.join(F.broadcast(g.agg(F.sum("lines").alias("t")))).select("department", "lines", F.round(100.0 * F.col("lines") / F.col("t"), 6).alias("share"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
x AS (SELECT o_custkey, l_partkey, k, min(k) OVER (PARTITION BY o_custkey, l_partkey) AS first FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT count(*) AS lines, count(*) FILTER (WHERE k > first) AS reordered, round(avg(CASE WHEN k > first THEN 1.0 ELSE 0.0 END), 6) AS reorder_rate FROM x""")
def reorder_rate(s, d):
    o = table(s, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).select("o_orderkey", "o_custkey", "k")
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.withColumn("again", F.col("k") > F.min("k").over(Window.partitionBy("o_custkey", "l_partkey")))
    return x.agg(F.count("*").alias("lines"), F.count_if("again").alias("reordered"), F.round(F.avg(F.col("again").cast("double")), 6).alias("reorder_rate"))


@query("""SELECT o_orderkey AS order_id, row_number() OVER w AS order_number, CAST(dayofweek(o_orderdate) AS INTEGER) AS order_dow, CAST(hour(o_orderdate) AS INTEGER) AS order_hour,
coalesce(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)), -1) AS days_since_prior FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_times(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.row_number().over(w).cast("long").alias("order_number"), (F.dayofweek("o_orderdate") - 1).alias("order_dow"), F.hour("o_orderdate").alias("order_hour"), F.coalesce(F.date_diff("o_orderdate", F.lag("o_orderdate").over(w)), F.lit(-1)).cast("long").alias("days_since_prior"))


# ---------------------------------------------------------------- baskets and association


@query("SELECT l_partkey AS product_id, count(*) AS cnt, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def item_counts(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
    return li.groupBy("product_id").agg(F.count("*").alias("cnt"), F.countDistinct("order_id").alias("orders"))


@query("SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)")
def vocabulary(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"))
    return baskets.known_only(li, dimension(s, d)).distinct()


@query(f"WITH {PART_LINES} SELECT order_id, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY pos) AS sentence FROM lines GROUP BY 1 HAVING count(*) >= 2")
def basket_sentences(s, d):
    return baskets.sentences(part_lines(s, d)).select("order_id", F.array_join(F.col("items").cast("array<string>"), " ").alias("sentence"))


@query(f"WITH {PART_LINES}, {DIRECTED} SELECT a, b, cnt FROM directed")
def pair_counts_directed(s, d):
    return baskets.directed_pairs(part_lines(s, d))


@query(f"WITH {PART_LINES}, {_cooc(PART_SUPPORT)} SELECT a, b, cnt FROM cooc")
def cooc_symmetric(s, d):
    return baskets.cooccurrence(part_lines(s, d), PART_SUPPORT)


@query(f"WITH {BRAND_LINES}, {DIRECTED}, summed AS (SELECT a, b, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT a, b, cnt FROM directed UNION ALL SELECT b, a, cnt FROM directed) GROUP BY 1, 2) SELECT a, b, cnt FROM summed WHERE cnt >= 300")
def cooc_undirected_support(s, d):
    return baskets.cooccurrence(brand_lines(s, d), 300, mode="undirected")


@query(f"WITH {BRAND_LINES}, {DIRECTED} SELECT count(*) AS pairs, CAST(sum(cnt) AS BIGINT) AS emitted, max(cnt) AS largest, count(DISTINCT a) AS items FROM directed")
def pair_diagnostics(s, d):
    return baskets.directed_pairs(brand_lines(s, d)).agg(F.count("*").alias("pairs"), F.sum("cnt").alias("emitted"), F.max("cnt").alias("largest"), F.countDistinct("a").alias("items"))


@query(f"""WITH {PART_LINES}, {_cooc(PART_SUPPORT)} SELECT (SELECT count(*) FROM cooc) AS nnz, (SELECT count(DISTINCT product_id) FROM lines) AS shape,
round((SELECT count(*) FROM cooc) / (CAST((SELECT count(DISTINCT product_id) FROM lines) AS DOUBLE) * (SELECT count(DISTINCT product_id) FROM lines)), 9) AS density""")
def matrix_diagnostics(s, d):
    """Entries, side and density of the co-occurrence matrix."""
    lines = part_lines(s, d)
    nnz = baskets.cooccurrence(lines, PART_SUPPORT).agg(F.count("*").alias("nnz"))
    shape = lines.agg(F.countDistinct("product_id").alias("shape"))
    return nnz.join(F.broadcast(shape)).select("nnz", "shape", F.round(F.col("nnz") / (F.col("shape").cast("double") * F.col("shape")), 9).alias("density"))


@query(f"WITH {PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED} SELECT a, b, cnt, score FROM scored")
def item_cf_scores(s, d):
    return item_cf(s, d)


@query(f"WITH {BRAND_LINES}, {_cooc(10)}, {SCORED}, {_top('scored', 10)} SELECT a, b, score, rank FROM ranked")
def item_cf_topk(s, d):
    scored = item_cf(s, d, brand_lines(s, d), 10)
    return itemcf.top_k(scored, 10).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', 10)} SELECT a, b, score, rank FROM ranked")
def item_cf_topk_parts(s, d):
    return itemcf.top_k(item_cf(s, d), 10).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- text and content

LABEL = "concat(p_name, ' & ', p_brand, ' 500ml ', cast(p_size as string), ' pack, size ', cast(p_size as string), ' cho ', p_type)"
CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat(p_name, ' & ', p_brand, ' 500ml ', CAST(p_size AS VARCHAR), ' pack, size ', CAST(p_size AS VARCHAR), ' cho ', p_type)),
 '\b\d+([.,]\d+)?\s*(ml|pack|l|g)\b|\bsize\s*\d+\b', '', 'g'), '&', '', 'g'), '\b(cho)\b', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT p_partkey AS product_id, {CLEAN_SQL} AS cleaned FROM part")
def clean_text(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("product_id"), T.clean_text(F.expr(LABEL)).alias("cleaned"))


@query(r"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id,
regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS t FROM documents)""")
def tokens(s, d):
    t = table(s, d, "documents").select("doc_id", T.tokens(F.lower(F.coalesce("text", F.lit("")))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


TOK = "regexp_extract_all(lower({}), '[a-z0-9_]{{2,}}')"


@query(f"""WITH t AS (SELECT p_partkey AS product_id, {TOK.format('p_name')} AS w FROM part),
g AS (SELECT product_id, unnest(w) AS term FROM t UNION ALL SELECT product_id, w[i] || ' ' || w[i + 1] FROM (SELECT product_id, w, unnest(range(1, len(w))) AS i FROM t))
SELECT product_id, term, count(*) AS tf FROM g GROUP BY 1, 2""")
def bigrams(s, d):
    return content.terms(dimension(s, d), "product_name", 2)


def _field_sql(name: str, column: str, longest: int, cap: int, weight: float) -> str:
    grams = f"SELECT product_id, unnest(w) AS term FROM {name}_t"
    if longest == 2:
        grams += f" UNION ALL SELECT product_id, w[i] || ' ' || w[i + 1] FROM (SELECT product_id, w, unnest(range(1, len(w))) AS i FROM {name}_t)"
    return f"""{name}_t AS (SELECT product_id, {TOK.format(column)} AS w FROM dim),
{name}_f AS (SELECT product_id, term, count(*) AS tf FROM ({grams}) GROUP BY 1, 2),
{name}_c AS (SELECT term FROM {name}_f GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {cap}),
{name}_k AS (SELECT f.* FROM {name}_f f JOIN {name}_c USING (term)),
{name}_i AS (SELECT term, ln((1 + (SELECT count(*) FROM dim)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM {name}_k GROUP BY 1),
{name}_v AS (SELECT product_id, '{column}' AS field, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY product_id)) * {weight} AS weight FROM {name}_k JOIN {name}_i USING (term))"""


VECTORS = f"{DIM}, " + ", ".join(_field_sql(f"x{i}", *f) for i, f in enumerate(FIELDS)) + ", vectors AS (SELECT * FROM x0_v UNION ALL SELECT * FROM x1_v UNION ALL SELECT * FROM x2_v)"
COUNTS = f"""cw AS (SELECT product_id, term, count(*) AS tf FROM (SELECT product_id, unnest({TOK.format('product_name')}) AS term FROM dim) GROUP BY 1, 2),
counts AS (SELECT * FROM cw WHERE term IN (SELECT term FROM cw GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 15000))"""
PAIRS = f"{PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', 100)}"
SIMS = """tsim AS (SELECT a, b, coalesce(sum(l.weight * r.weight), 0) AS sim FROM ranked LEFT JOIN vectors l ON l.product_id = a
  LEFT JOIN vectors r ON r.product_id = b AND r.field = l.field AND r.term = l.term GROUP BY 1, 2),
sizes AS (SELECT product_id, count(*) AS n FROM counts GROUP BY 1),
osim AS (SELECT a, b, count(r.term) AS common, CASE WHEN coalesce(min(p.n), 0) = 0 OR coalesce(min(q.n), 0) = 0 THEN 0 ELSE count(r.term) / CAST(least(min(p.n), min(q.n)) AS DOUBLE) END AS ovl
  FROM ranked LEFT JOIN counts l ON l.product_id = a LEFT JOIN counts r ON r.product_id = b AND r.term = l.term
  LEFT JOIN sizes p ON p.product_id = a LEFT JOIN sizes q ON q.product_id = b GROUP BY 1, 2),
esim AS (SELECT a, b, 0.5 * ovl + 0.5 * sim AS sim FROM tsim JOIN osim USING (a, b))"""
CONTENT = f"WITH {VECTORS}, {COUNTS}, {PAIRS}, {SIMS}"


def candidates(s, d, k: int = 100) -> DataFrame:
    return itemcf.top_k(item_cf(s, d), k).select("a", "b", "score", "rank")


def similarity(s, d, pairs: DataFrame) -> DataFrame:
    dim = dimension(s, d)
    return content.ensemble_similarity(pairs, content.multi_field(dim, FIELDS), content.count_vectors(dim))


@query(f"WITH {DIM}, {_field_sql('x0', *FIELDS[0])} SELECT product_id, term, round(weight, 6) AS weight FROM x0_v")
def tfidf_single(s, d):
    return content.tfidf(dimension(s, d), *FIELDS[0][:3]).select("product_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {VECTORS} SELECT product_id, field, term, round(weight, 6) AS weight FROM vectors")
def tfidf_multifield(s, d):
    return content.multi_field(dimension(s, d), FIELDS).select("product_id", "field", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {DIM}, {COUNTS} SELECT product_id, term, tf FROM counts")
def count_vectors(s, d):
    return content.count_vectors(dimension(s, d))


@query(f"{CONTENT} SELECT a, b, common, round(ovl, 6) AS ovl FROM osim")
def overlap_similarity(s, d):
    return content.overlap_similarity(candidates(s, d), content.count_vectors(dimension(s, d))).select("a", "b", "common", F.round("ovl", 6).alias("ovl"))


@query(f"{CONTENT} SELECT a, b, round(sim, 6) AS sim FROM tsim")
def cb_similarity(s, d):
    return content.tfidf_similarity(candidates(s, d), content.multi_field(dimension(s, d), FIELDS)).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"{CONTENT} SELECT a, b, round(sim, 6) AS sim FROM esim")
def cb_ensemble_similarity(s, d):
    return similarity(s, d, candidates(s, d)).select("a", "b", F.round("sim", 6).alias("sim"))


def _filtered(s, d, known: DataFrame | None = None) -> DataFrame:
    pairs = candidates(s, d)
    dim = dimension(s, d) if known is None else known
    return content.substitute_filter(pairs, similarity(s, d, pairs), dim, 0.25)


@query(f"{CONTENT} SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY rank) AS rank FROM ranked JOIN esim USING (a, b) WHERE sim < 0.25 QUALIFY row_number() OVER (PARTITION BY a ORDER BY rank) <= 10")
def cb_filter(s, d):
    w = Window.partitionBy("a").orderBy("rank")
    return _filtered(s, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("a", "b", "score", F.col("r").cast("long").alias("rank"))


@query(f"""{CONTENT} SELECT a, b, round(sim, 6) AS sim, is_cold, row_number() OVER (PARTITION BY a ORDER BY is_cold, rank) AS rank FROM
(SELECT a, b, rank, (a % 7 = 0 OR b % 7 = 0) AS is_cold, CASE WHEN a % 7 = 0 OR b % 7 = 0 THEN NULL ELSE sim END AS sim FROM ranked JOIN esim USING (a, b)) WHERE is_cold OR sim < 0.25""")
def cb_filter_df(s, d):
    out = _filtered(s, d, dimension(s, d).where("product_id % 7 <> 0"))
    return out.select("a", "b", F.round("sim", 6).alias("sim"), "is_cold", F.row_number().over(Window.partitionBy("a").orderBy("is_cold", "rank")).cast("long").alias("rank"))


@query(f"{CONTENT} SELECT a, b, round(sim, 6) AS sim, CASE WHEN sim >= 0.25 THEN 'Substitute' ELSE 'Complementary' END AS label FROM esim")
def cb_detail(s, d):
    return similarity(s, d, candidates(s, d)).select("a", "b", F.round("sim", 6).alias("sim"), F.when(F.col("sim") >= 0.25, "Substitute").otherwise("Complementary").alias("label"))


@query("SELECT p_partkey AS product_id, CASE WHEN length(p_partkey || ' - ' || p_name) > 16 THEN substr(p_partkey || ' - ' || p_name, 1, 16) || '...' ELSE p_partkey || ' - ' || p_name END AS label FROM part")
def picker_labels(s, d):
    label = F.concat_ws(" - ", F.col("p_partkey").cast("string"), "p_name")
    return table(s, d, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.length(label) > 16, F.concat(F.substring(label, 1, 16), F.lit("..."))).otherwise(label).alias("label"))


@query(f"""WITH {DIM}, asked AS (SELECT unnest([0, 1, 7, -5, 1000000000]) AS product_id)
SELECT asked.product_id, coalesce(product_name, 'Unknown(' || asked.product_id || ')') AS product_name, coalesce(department, '') AS department FROM asked LEFT JOIN dim USING (product_id)""")
def product_lookup(s, d):
    """Names of given ids; unknown ones are named so."""
    return catalog.lookup(dimension(s, d), [0, 1, 7, -5, 1000000000])


@query(f"WITH {PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', 5)} SELECT a, b, printf('%.4f', score) AS score, rank FROM ranked WHERE a IN (0, 20, 40, 60)")
def picked_preview(s, d):
    """The five best of chosen products, with scores as text."""
    picked = item_cf(s, d).where(F.col("a").isin(0, 20, 40, 60))
    return itemcf.top_k(picked, 5).select("a", "b", F.format_string("%.4f", "score").alias("score"), F.col("rank").cast("long").alias("rank"))
