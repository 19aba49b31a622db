"""Queries over sources, sinks, stored models, survey targets and maintenance.

What is written goes to a fresh path below the session's shared folder and is read back through the readers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import baskets, maintenance, survey
from ..operators.embed import vectors_of
from ..recommenders import ContentFilter, Ensemble, Item2Vec, ItemCF, KGMetapath
from ..sources import readers
from ..sources.shared import fresh, written
from .catalogue import _cooc, _top, DIM, dimension, DIRECTED, PART_LINES, part_lines, PART_SUPPORT, query, SCORED, SPLIT, table
from .models import GT, GT_CONTENT, safe_pool, SHORT_WALKS, truth

# ---------------------------------------------------------------- sources and sinks

ORDERS = f"""SELECT o_orderkey AS order_id, o_custkey AS user_id, {SPLIT} AS eval_set, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS order_number FROM orders"""


def _orders(s, d) -> DataFrame:
    table(s, d, "orders").createOrReplaceTempView("bl_orders")
    return s.sql(ORDERS.replace("FROM orders", "FROM bl_orders"))


def _lines(s, d, status: str) -> DataFrame:
    return part_lines(s, d, [status]).select("order_id", "product_id", F.col("pos").cast("int").alias("add_to_cart_order"), F.lit(0).alias("reordered"))


@query(f"SELECT order_id, user_id, eval_set, order_number FROM ({ORDERS}) WHERE eval_set = 'prior'")
def source_orders(s, d):
    folder = fresh(s, "csv")
    none = [F.lit(None).cast("int").alias(c) for c in ("order_dow", "order_hour_of_day")]
    readers.write_csv(_orders(s, d).select("*", *none, F.lit(None).cast("double").alias("days_since_prior_order")), f"{folder}/orders.csv")
    return readers.read_orders(s, folder, "prior").select("order_id", "user_id", "eval_set", "order_number")


@query("""SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS add_to_cart_order, 0 AS reordered
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F'))""")
def source_order_products(s, d):
    folder = fresh(s, "csv")
    readers.write_csv(_lines(s, d, "O"), f"{folder}/order_products__prior.csv")
    readers.write_csv(_lines(s, d, "F"), f"{folder}/order_products__train.csv")
    return readers.read_order_products(s, folder)


@query(f"WITH {DIM} SELECT product_id, CASE WHEN product_id % 3 = 0 THEN upper(product_name) ELSE product_name END AS product_name, aisle, department FROM dim")
def source_dimension(s, d):
    """From CSV files; translations of aisles and departments aren't there and are skipped."""
    folder, dim = fresh(s, "csv"), dimension(s, d)
    # a handful of rows
    number = F.dense_rank().over(Window.orderBy("department"))
    departments = dim.select("department").distinct().select(number.cast("int").alias("department_id"), "department")
    readers.write_csv(departments, f"{folder}/departments.csv")
    readers.write_csv(dim.select(F.col("aisle_id").cast("int").alias("aisle_id"), "aisle").distinct(), f"{folder}/aisles.csv")
    readers.write_csv(dim.join(departments, "department").select("product_id", "product_name", F.col("aisle_id").cast("int").alias("aisle_id"), "department_id"), f"{folder}/products.csv")
    readers.write_csv(dim.where("product_id % 3 = 0").select("product_id", F.upper("product_name").alias("product_name_vi")), f"{folder}/products_vi.csv")
    return readers.read_dimension(s, folder).select("product_id", "product_name", "aisle", "department")


@query(f"WITH {GT} SELECT DISTINCT a AS id FROM gt UNION SELECT b FROM gt")
def source_ids(s, d):
    """Ids of a ground-truth file, written one a line and read back."""
    folder = fresh(s, "ids")
    readers.write_csv(truth(s, d).select(F.col("a").alias("product_A_id"), F.col("b").alias("product_B_id"), F.lit("by test orders, \"quoted\"").alias("description")), f"{folder}/truth.csv")
    pairs = readers.read_ground_truth(s, f"{folder}/truth.csv")
    readers.write_ids(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{folder}/ids.txt")
    return readers.read_ids(s, f"{folder}/ids.txt")


@query("SELECT product_id, cnt FROM (SELECT l_partkey AS product_id, count(*) AS cnt FROM lineitem GROUP BY 1)")
def source_counts(s, d):
    """The counts table as a row-dict CSV: all columns are read as text, and cast."""
    path = f"{fresh(s, 'csv')}/counts.csv"
    readers.write_csv(baskets.item_counts(part_lines(s, d)), path)
    rows = readers.read_rows(s, path)
    return rows.select(F.col("product_id").cast("long").alias("product_id"), F.col("cnt").cast("long").alias("cnt"))


# ---------------------------------------------------------------- stored models


@query(f"WITH {PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', 10)} SELECT a, b, score, rank FROM ranked")
def stored_item_cf(s, d):
    """Fitted on known products, saved, loaded, asked for all products."""
    path = fresh(s, "item-cf")
    ItemCF(min_support=PART_SUPPORT, top_k=10).fit(part_lines(s, d), dimension(s, d)).save(path)
    return ItemCF.load(s, path).recommend().select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{GT_CONTENT} SELECT a, b, round(sim, 6) AS sim FROM esim")
def stored_content(s, d):
    path = fresh(s, "content")
    ContentFilter().fit(dimension(s, d)).save(path)
    return ContentFilter.load(s, path).similarity(truth(s, d)).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""WITH {PART_LINES} SELECT count(*) AS words, count(*) AS as_saved, {DEFAULT.item2vec_dim} AS dim FROM
(SELECT product_id FROM lines WHERE order_id IN (SELECT order_id FROM lines GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= {DEFAULT.item2vec_min_count})""")
def stored_item2vec(s, d):
    """Words of a model trained for one epoch, and how many have the same vector in the stored model and table."""
    path = fresh(s, "item2vec")
    Item2Vec(epochs=1).fit(part_lines(s, d)).save(path)
    back = Item2Vec.load(s, path)
    both = vectors_of(back.model).join(back.tables["vectors"].toDF("id", "vec2"), "id", "full")
    return both.agg(F.count("*").alias("words"), F.count_if(F.col("vec") == F.col("vec2")).alias("as_saved"), F.max(F.size("vec")).alias("dim"))


@query(f"""WITH RECURSIVE {SHORT_WALKS} SELECT (SELECT count(*) FROM kept) AS edges, (SELECT count(*) FROM dim) AS categories,
(SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(walk, ' ')) AS x FROM walked WHERE n > 1)) AS vectors, 0 AS zero_norms""")
def stored_kg(s, d):
    """The parts of a stored walk model (two walks of ten steps, one epoch); lengths of vectors are found on loading."""
    path = fresh(s, "kg")
    KGMetapath(num_walks=2, walk_length=10, epochs=1, edge_threshold=PART_SUPPORT, dim=8).fit(part_lines(s, d), dimension(s, d)).save(path)
    back = KGMetapath.load(s, path)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(back.tables["edges"], "edges"), n(back.tables["categories"], "categories"), n(back.tables["vectors"], "vectors"), back.norms().agg(F.count_if(F.col("norm") <= 1e-9).alias("zero_norms"))]
    # one row each
    return reduce(lambda x, y: x.join(F.broadcast(y)), parts).select("edges", "categories", "vectors", F.col("zero_norms").cast("int").alias("zero_norms"))


@query()
def stored_ensemble(s, d):
    """All models trained for one epoch, fused, stored with their settings, loaded, and asked with the filter."""
    path, dim, lines = fresh(s, "ensemble"), dimension(s, d), written(part_lines(s, d), "lines")
    # of the one support that both models ask for
    pairs = written(baskets.supported(baskets.directed_pairs(baskets.known_only(lines, dim)), PART_SUPPORT), "pairs")
    models = [ItemCF(min_support=PART_SUPPORT).fit(lines, dim, pairs), Item2Vec(epochs=1, dim=16).fit(lines), KGMetapath(num_walks=2, walk_length=10, epochs=1, edge_threshold=PART_SUPPORT, dim=16).fit(lines, dim, pairs=pairs)]
    Ensemble(final_k=5).fit(models, ContentFilter().fit(dim)).save(path)
    asked = dim.where("product_id % 20 = 0").select("product_id")
    return Ensemble.load(s, path).recommend(asked).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- survey targets

TARGETS = """pool AS (SELECT l_partkey AS product_id, count(*) AS cnt FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings) GROUP BY 1 HAVING count(*) >= 10),
sized AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, product_id) AS r, least((SELECT count(*) FROM pool), 100) AS n FROM pool),
popular AS (SELECT product_id, 'popular' AS chosen FROM sized WHERE r <= CAST(floor(n * 0.75) AS BIGINT)),
rest AS (SELECT product_id, row_number() OVER (ORDER BY (product_id * 7919 + 42 * 104729) % 1000003, product_id) AS r, n FROM sized WHERE r > CAST(floor(n * 0.75) AS BIGINT)),
targets AS (SELECT * FROM popular UNION ALL SELECT product_id, 'random' FROM rest WHERE r <= n - CAST(floor(n * 0.75) AS BIGINT))"""


@query(f"WITH {TARGETS} SELECT product_id, chosen, row_number() OVER (ORDER BY (product_id * 104729 + 42 * 7919) % 1000003, product_id) AS place FROM targets")
def survey_targets(s, d):
    """A hundred targets, three quarters of them the most popular, in shuffled order."""
    return survey.targets(safe_pool(s, d), 100, 0.75).select("product_id", "chosen", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TARGETS}, {PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', 10)}
SELECT count(*) AS suggestions, count(DISTINCT a) AS targets, round(count(*) / CAST(nullif(count(DISTINCT a), 0) AS DOUBLE), 6) AS per_target FROM ranked WHERE a IN (SELECT product_id FROM targets)""")
def survey_summary(s, d):
    path = fresh(s, "item-cf")
    ItemCF(min_support=PART_SUPPORT, top_k=10).fit(part_lines(s, d), dimension(s, d)).save(path)
    asked = survey.targets(safe_pool(s, d), 100, 0.75)
    return survey.summary(ItemCF.load(s, path).recommend(asked))


@query(f"""WITH {TARGETS}, {PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', 10)}
SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY (b * 104729 + a * 31 + 42 * 7919) % 1000003, b) AS place FROM ranked WHERE a IN (SELECT product_id FROM targets)""")
def survey_shuffled(s, d):
    """The candidates of each target, shuffled so that their order tells nothing of the model."""
    asked = survey.targets(safe_pool(s, d), 100, 0.75)
    found = ItemCF(min_support=PART_SUPPORT, top_k=10).fit(part_lines(s, d), dimension(s, d)).recommend(asked)
    return survey.shuffled(found.select("a", "b")).select("a", "b", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- maintenance

KEPT = """n AS (SELECT * FROM nation WHERE n_nationkey % 5 <> 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
su AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))"""


def _nation_cascade(s, d, keep: DataFrame) -> dict[str, DataFrame]:
    n, c, su, o, li = (table(s, d, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    return maintenance.cascade(keep, [("nation", n, "n_nationkey", [], ""), ("customer", c, "c_custkey", ["c_nationkey"], "nation"), ("supplier", su, "s_suppkey", ["s_nationkey"], "nation"), ("orders", o, "o_orderkey", ["o_custkey"], "customer"), ("lineitem", li, "l_linenumber", ["l_orderkey"], "orders")])


NAMES = ("nation", "customer", "supplier", "orders", "lineitem")


@query(f"WITH {KEPT} " + " UNION ALL ".join(f"SELECT '{t}' AS tab, (SELECT count(*) FROM {t}) AS before, (SELECT count(*) FROM {x}) AS after" for t, x in zip(NAMES, ("n", "c", "su", "o", "l"))))
def cascade_swapped(s, d):
    """A cascade over four levels by a keep-list from a file, swapped into a copy of the tables, and counted there."""
    folder = fresh(s, "database")
    readers.write_ids(table(s, d, "nation").where("n_nationkey % 5 <> 2").select("n_nationkey"), f"{folder}/keep.txt")
    keep = readers.read_ids(s, f"{folder}/keep.txt")
    for name in (*NAMES, "region"):
        table(s, d, name).write.parquet(f"{folder}/tables/{name}.parquet")
    if maintenance.doomed(table(s, d, "nation"), keep, "n_nationkey")[1]:
        maintenance.swap(s, _nation_cascade(s, f"{folder}/tables", keep), f"{folder}/tables")
    count = lambda sf, name, out: table(s, sf, name).agg(F.count("*").alias(out))
    rows = [count(d, name, "before").join(F.broadcast(count(f"{folder}/tables", name, "after"))).select(F.lit(name).alias("tab"), "before", "after") for name in NAMES]
    return reduce(DataFrame.unionByName, rows)


@query(f"""WITH {PART_LINES}, {DIRECTED}, kept AS (SELECT * FROM directed WHERE cnt >= {PART_SUPPORT}), p AS (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)
SELECT a AS buy_id, b AS free_id, cnt FROM kept WHERE a IN (SELECT p_partkey FROM p) AND b IN (SELECT p_partkey FROM p)""")
def cascade_two_keys(s, d):
    """Children with two foreign keys to one parent: a row stays if both of them do."""
    offers = baskets.supported(baskets.directed_pairs(part_lines(s, d)), PART_SUPPORT).toDF("buy_id", "free_id", "cnt")
    part = table(s, d, "part")
    left = maintenance.cascade(part.where("p_partkey % 10 <> 3").select("p_partkey"), [("part", part, "p_partkey", [], ""), ("offers", offers, "buy_id", ["buy_id", "free_id"], "part")])
    return left["offers"].select("buy_id", "free_id", "cnt")


@query(f"""WITH {KEPT} SELECT 'before' AS state, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'after', count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'customers before', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM n)""")
def orphans_left(s, d):
    """Rows without a parent when only the parents' tables are cut, and none after the whole cascade."""
    left = _nation_cascade(s, d, table(s, d, "nation").where("n_nationkey % 5 <> 2").select("n_nationkey"))
    count = lambda state, child, parents, foreign, key: maintenance.orphans(child, parents, foreign, key).select(F.lit(state).alias("state"), "orphans")
    rows = [count("before", table(s, d, "lineitem"), left["orders"], "l_orderkey", "o_orderkey"), count("after", left["lineitem"], left["orders"], "l_orderkey", "o_orderkey"), count("customers before", table(s, d, "customer"), left["nation"], "c_nationkey", "n_nationkey")]
    return reduce(DataFrame.unionByName, rows)
