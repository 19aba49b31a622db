"""Queries over graph, embeddings, fusion, evaluation, survey, reports and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scores import norm
from ..operators import baskets, catalog, content, embed, evaluate, fusion, graph, itemcf, maintenance, survey
from .catalogue import (
    _cooc,
    _top,
    BRAND_LINES,
    candidates,
    CONTENT,
    DIM,
    dimension,
    DIRECTED,
    FIELDS,
    item_cf,
    part_lines,
    PART_LINES,
    PART_SUPPORT,
    query,
    SCORED,
    similarity,
    SPLIT_LINES,
    table,
    VECTORS,
    COUNTS,
    SIMS,
)

NUM_WALKS, WALK_LENGTH = 2, 10


def edges(s, d) -> DataFrame:
    return baskets.supported(baskets.directed_pairs(part_lines(s, d)), PART_SUPPORT)


EDGES = f"{PART_LINES}, {DIRECTED}, kept AS (SELECT * FROM directed WHERE cnt >= {PART_SUPPORT}), links AS (SELECT a AS src, b AS dst FROM kept UNION ALL SELECT b, a FROM kept)"

# ---------------------------------------------------------------- graph


@query(f"WITH {EDGES} SELECT src, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS neighbours, count(*) AS degree FROM links GROUP BY 1")
def adjacency(s, d):
    return graph.adjacency(edges(s, d)).select("src", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"), F.size("neighbours").cast("long").alias("degree"))


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS degree FROM links GROUP BY 1")
def node_degree(s, d):
    return graph.degrees(edges(s, d))


@query(f"WITH {DIM} SELECT aisle_id, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY product_id) AS members, count(*) AS n FROM dim GROUP BY 1")
def category_members(s, d):
    m = graph.members(dimension(s, d))
    return m.select("aisle_id", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), F.size("members").cast("long").alias("n"))


@query(f"WITH {DIM} SELECT product_id FROM (SELECT product_id, count(*) OVER (PARTITION BY aisle_id) AS n FROM dim) WHERE n >= 2")
def semantic_starts(s, d):
    return graph.semantic_starts(dimension(s, d))


def _walk_sentences(s, d, num: int = NUM_WALKS, length: int = WALK_LENGTH) -> DataFrame:
    return graph.walks(edges(s, d), dimension(s, d), num, length, DEFAULT.behavioral_ratio)


_DRAW = "((walk_id * 7919 + {step} * 104729 + 42) % 1000003)"
WALKS = f"""{EDGES}, {DIM},
adj AS (SELECT src, list(dst ORDER BY dst) AS nb FROM links GROUP BY 1),
cat AS (SELECT aisle_id, list(product_id ORDER BY product_id) AS mem FROM dim GROUP BY 1),
node AS (SELECT p.product_id, nb, coalesce(len(nb), 0) AS nn, list_filter(mem, lambda x: x <> p.product_id) AS oth, len(mem) - 1 AS no FROM dim p JOIN cat USING (aisle_id) LEFT JOIN adj ON src = p.product_id),
beh AS (SELECT src AS node, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n FROM adj),
sem AS (SELECT product_id AS node, row_number() OVER (ORDER BY product_id) - 1 AS i, count(*) OVER () AS n FROM node WHERE no > 0),
plan AS (SELECT unnest(range(0, (SELECT greatest(max(beh.n), max(sem.n)) FROM beh, sem) * {{num}})) AS walk_id),
first AS (SELECT walk_id, {_DRAW.format(step=0)} % 1000 < 500 AS beh, b.node AS b, s.node AS s FROM plan JOIN beh b ON b.i = walk_id % b.n JOIN sem s ON s.i = walk_id % s.n),
w AS (SELECT walk_id, CASE WHEN beh THEN b ELSE s END AS cur, 0 AS step, CAST(CASE WHEN beh THEN b ELSE s END AS VARCHAR) AS walk, beh, s FROM first
 UNION ALL
 SELECT walk_id, nxt, step, walk || ' ' || CAST(nxt AS VARCHAR), beh, s FROM (
  SELECT walk_id, w.step + 1 AS step, walk, beh, s,
   CASE WHEN NOT beh AND no > 0 THEN oth[1 + {_DRAW.format(step='(w.step + 1)')} % no]
        WHEN nn > 0 THEN nb[1 + {_DRAW.format(step='(w.step + 1)')} % nn]
        WHEN beh THEN s END AS nxt
  FROM w JOIN node ON node.product_id = cur WHERE w.step < {{length}} - 1) WHERE nxt IS NOT NULL),
walked AS (SELECT walk_id, arg_max(walk, step) AS walk, CAST(max(step) + 1 AS BIGINT) AS n FROM w GROUP BY 1)"""
SHORT_WALKS = WALKS.replace("{num}", str(NUM_WALKS)).replace("{length}", str(WALK_LENGTH))


@query(f"WITH RECURSIVE {SHORT_WALKS} SELECT walk_id, walk, n FROM walked WHERE n > 1")
def metapath_walks(s, d):
    return _walk_sentences(s, d).select("walk_id", F.array_join(F.col("items").cast("array<string>"), " ").alias("walk"), F.size("items").cast("long").alias("n"))


@query(f"WITH RECURSIVE {SHORT_WALKS} SELECT count(*) AS walks, round(avg(n), 6) AS mean_length, (SELECT max(d) FROM (SELECT count(*) AS d FROM links GROUP BY src)) AS max_degree, count(*) FILTER (WHERE n > 1) AS sentences FROM walked")
def walk_stats(s, d):
    """Walks that end at once are counted too: their number is the budget less the sentences."""
    e, dim = edges(s, d), dimension(s, d)
    told = graph.walks(e, dim, NUM_WALKS, WALK_LENGTH, DEFAULT.behavioral_ratio, least=1)
    most = graph.degrees(e).agg(F.max("degree").alias("max_degree"))
    size = F.size("items")
    return told.agg(F.count("*").alias("walks"), F.round(F.avg(size), 6).alias("mean_length"), F.count_if(size > 1).alias("sentences")).join(F.broadcast(most)).select("walks", "mean_length", "max_degree", "sentences")


# ---------------------------------------------------------------- embeddings


def vectors(s, d, first: int = 1, many: int = 64) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), first, many).alias("vec"))


def anchors(s, d, *part) -> DataFrame:
    """The stated query set: ids divisible by 20."""
    return vectors(s, d, *part).where("id % 20 = 0")


def _neighbours_sql(name: str, low: int, high: int, k: int, positive: bool = True) -> str:
    return f"""{name}_v AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[{low}:{high}] AS v FROM embeddings),
{name}_s AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) AS score
  FROM {name}_v x JOIN {name}_v y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0), {_top(f'{name}_s', k, name, positive)}"""


def neighbours(s, d, first: int, many: int, k: int, positive: bool = True) -> DataFrame:
    return embed.cosine_top_k(anchors(s, d, first, many), vectors(s, d, first, many), k, positive)


@query(f"WITH {_neighbours_sql('m', 1, 64, 10)} SELECT a, b, score, rank FROM m")
def embedding_topk(s, d):
    return neighbours(s, d, 1, 64, 10).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def embedding_norms(s, d):
    return vectors(s, d).select(F.col("id").alias("vec_id"), F.round(F.when(norm(F.col("vec")) == 0, 1e-9).otherwise(norm(F.col("vec"))), 6).alias("norm"))


def _trained(sentences: DataFrame, window: int, min_count: int) -> DataFrame:
    return embed.word2vec(sentences, dim=DEFAULT.item2vec_dim, window=window, min_count=min_count, epochs=DEFAULT.epochs, partitions=DEFAULT.train_partitions)


@query()
def item2vec_vectors(s, d):
    return _trained(baskets.sentences(part_lines(s, d)), DEFAULT.item2vec_window, DEFAULT.item2vec_min_count)


@query()
def item2vec_topk(s, d):
    v = item2vec_vectors(s, d)
    return embed.cosine_top_k(v.where("id % 20 = 0"), v, 10, positive=False)


@query()
def kg_embeddings(s, d):
    return _trained(_walk_sentences(s, d, DEFAULT.num_walks, DEFAULT.walk_length), DEFAULT.walk_window, 1)


# ---------------------------------------------------------------- fusion


MODEL_K, FINAL_K = 100, 10
FUSED = f"""{PART_LINES}, {_cooc(PART_SUPPORT)}, {SCORED}, {_top('scored', MODEL_K, 'icf')},
{_neighbours_sql('i2v', 1, 32, MODEL_K, False)}, {_neighbours_sql('kg', 33, 64, MODEL_K)},
u AS (SELECT a, b, max(CASE WHEN m = 0 THEN score END) AS s0, max(CASE WHEN m = 1 THEN score END) AS s1, max(CASE WHEN m = 2 THEN score END) AS s2 FROM
  (SELECT a, b, score, 0 AS m FROM icf WHERE a % 20 = 0 UNION ALL SELECT a, b, score, 1 FROM i2v UNION ALL SELECT a, b, score, 2 FROM kg) GROUP BY 1, 2),
f AS (SELECT a, b, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM u),
z AS (SELECT *, {', '.join(f"CASE WHEN min(s{i}) OVER (PARTITION BY a) = max(s{i}) OVER (PARTITION BY a) THEN 0.5 ELSE (s{i} - min(s{i}) OVER (PARTITION BY a)) / (max(s{i}) OVER (PARTITION BY a) - min(s{i}) OVER (PARTITION BY a) + 1e-9) END AS z{i}" for i in range(3))} FROM f),
fused AS (SELECT a, b, s0, s1, s2, round(0.5 * z0 + 0.25 * z1 + 0.25 * z2, 6) AS score FROM z)"""


def models(s, d, k: int = MODEL_K) -> list[DataFrame]:
    """ItemCF lists of all products; embedding lists of the stated query set."""
    return [itemcf.top_k(item_cf(s, d), k), neighbours(s, d, 1, 32, k, positive=False), neighbours(s, d, 33, 32, k)]


def fused(s, d, lists: list[DataFrame] | None = None) -> DataFrame:
    """Of the products that all models are asked for: those of the query set."""
    lists = lists or models(s, d)
    return fusion.fuse([lists[0].where("a % 20 = 0"), *lists[1:]], [0.5, 0.25, 0.25])


@query(f"WITH {FUSED} SELECT a, b, s0, s1, s2, score FROM fused WHERE score > 0")
def ensemble_candidates(s, d):
    return fused(s, d)


@query(f"WITH {FUSED}, {_top('fused', FINAL_K, 'best')} SELECT a, b, score, rank FROM best")
def ensemble_topk(s, d):
    return itemcf.top_k(fused(s, d), FINAL_K).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


FUSED_CB = f"WITH {VECTORS}, {COUNTS}, {FUSED}, ranked AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM fused WHERE a <> b AND score > 0), {SIMS}"
CB_KEPT = """ranked LEFT JOIN esim USING (a, b) WHERE a NOT IN (SELECT product_id FROM dim) OR b NOT IN (SELECT product_id FROM dim) OR sim < 0.25"""


KEPT_CB = f"kept_cb AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY rank) AS rank FROM {CB_KEPT} QUALIFY row_number() OVER (PARTITION BY a ORDER BY rank) <= 10)"


def _fused_kept(s, d, found: DataFrame | None = None) -> DataFrame:
    """The best that the content filter leaves, ranked anew; nothing is cut before the filter."""
    found = fused(s, d) if found is None else found
    kept = content.substitute_filter(found, similarity(s, d, found), dimension(s, d), 0.25)
    return itemcf.top_k(kept, FINAL_K)


@query(f"{FUSED_CB} SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY rank) AS rank FROM {CB_KEPT} QUALIFY row_number() OVER (PARTITION BY a ORDER BY rank) <= 10")
def ensemble_cb_topk(s, d):
    return _fused_kept(s, d).select("a", "b", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""{FUSED_CB}, cb_kept AS (SELECT a, b FROM {CB_KEPT} QUALIFY row_number() OVER (PARTITION BY a ORDER BY rank) <= 10),
plain AS (SELECT a, b FROM ranked WHERE rank <= 10)
SELECT a, b, 'only_without_filter' AS side FROM (SELECT * FROM plain EXCEPT SELECT * FROM cb_kept) UNION ALL SELECT a, b, 'only_with_filter' FROM (SELECT * FROM cb_kept EXCEPT SELECT * FROM plain)""")
def compare_filter(s, d):
    found = fused(s, d).persist()
    return fusion.differences(itemcf.top_k(found, FINAL_K), _fused_kept(s, d, found))


FIVE = ("ItemCF", "Item2Vec", "KGMetapath", "Ensemble", "Ensemble+CB")


@query(f"""{FUSED_CB}, {_top('fused', FINAL_K, 'best')}, {KEPT_CB}
SELECT 'ItemCF' AS model, a, b, score, rank FROM icf WHERE rank <= 10 UNION ALL SELECT 'Item2Vec', a, b, score, rank FROM i2v WHERE rank <= 10
UNION ALL SELECT 'KGMetapath', a, b, score, rank FROM kg WHERE rank <= 10 UNION ALL SELECT 'Ensemble', a, b, score, rank FROM best UNION ALL SELECT 'Ensemble+CB', a, b, score, rank FROM kept_cb""")
def all_model_panel(s, d):
    """The lists of the three models are made once and serve themselves and both ensembles."""
    lists = [x.persist() for x in models(s, d)]
    found = fused(s, d, lists).persist()
    out = None
    for name, ranked in zip(FIVE, (*lists, itemcf.top_k(found, FINAL_K), _fused_kept(s, d, found))):
        one = ranked.where(F.col("rank") <= FINAL_K).select(F.lit(name).alias("model"), "a", "b", "score", F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- evaluation


def truth(s, d) -> DataFrame:
    """Ordered pairs bought together in test orders."""
    return baskets.symmetric(baskets.directed_pairs(part_lines(s, d, ["P"]))).select("a", "b")


def trained(s, d) -> DataFrame:
    return itemcf.top_k(item_cf(s, d, part_lines(s, d, ["O", "F"]), 1), 10)


GT_LINES = SPLIT_LINES.format("'P'").replace("lines AS", "gt_lines AS", 1)
GT = f"{GT_LINES}, gt AS (SELECT DISTINCT x.product_id AS a, y.product_id AS b FROM gt_lines x JOIN gt_lines y ON x.order_id = y.order_id AND x.product_id <> y.product_id)"
EVAL = f"""WITH {SPLIT_LINES.format("'O', 'F'")}, {_cooc(1)}, {SCORED}, {_top('scored', 10)}, {GT},
keys AS (SELECT DISTINCT a FROM gt WHERE a IN (SELECT product_id FROM lines) AND a IN (SELECT vec_id FROM embeddings)),
per AS (SELECT k.a, (SELECT count(*) FROM gt WHERE gt.a = k.a) AS n_true, count(r.b) AS n_recs, count(g.b) AS hits FROM keys k LEFT JOIN ranked r ON r.a = k.a LEFT JOIN gt g ON g.a = r.a AND g.b = r.b GROUP BY k.a),
m AS (SELECT *, hits / 10.0 AS p, hits / CAST(n_true AS DOUBLE) AS r FROM per)"""
MEANS = "round(coalesce(avg(p), 0), 6) AS precision_at_10, round(coalesce(avg(r), 0), 6) AS recall_at_10, round(coalesce(avg(2 * p * r / (p + r + 1e-10)), 0), 6) AS f1_at_10, round(coalesce(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit_at_10"


def _keys(s, d) -> DataFrame:
    known = part_lines(s, d, ["O", "F"]).select("product_id").distinct()
    return evaluate.common_keys(truth(s, d), [known, table(s, d, "embeddings").select(F.col("vec_id").alias("product_id"))])


@query(f"WITH {GT} SELECT a, count(*) AS n_true, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS b_list FROM gt GROUP BY 1")
def ground_truth(s, d):
    g = truth(s, d).groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("x"))
    return g.select("a", F.size("x").cast("long").alias("n_true"), F.array_join(F.col("x").cast("array<string>"), " ").alias("b_list"))


@query(f"{EVAL} SELECT a FROM keys")
def fair_benchmark_keys(s, d):
    return _keys(s, d)


@query(f"{EVAL} SELECT 'ItemCF' AS model, count(*) AS test_set_size, count(*) FILTER (WHERE n_recs = 0) AS n_errors, {MEANS} FROM m")
def eval_fair(s, d):
    return evaluate.fair(truth(s, d), trained(s, d), _keys(s, d), 10, "ItemCF")


@query(f"{EVAL} SELECT 'ItemCF' AS model, (SELECT count(DISTINCT a) FROM gt) AS n_targets, count(*) AS n_evaluated, (SELECT count(DISTINCT a) FROM gt) - count(*) AS n_skipped, {MEANS} FROM m WHERE n_recs > 0")
def eval_skip(s, d):
    return evaluate.skipping(truth(s, d), trained(s, d), _keys(s, d), 10, "ItemCF")


@query(f"""{FUSED_CB}, {_top('fused', 10, 'best')}, {KEPT_CB}, {GT}, rec AS (SELECT 'ItemCF' AS model, a, b FROM icf WHERE rank <= 10 UNION ALL SELECT 'Item2Vec', a, b FROM i2v WHERE rank <= 10
 UNION ALL SELECT 'KGMetapath', a, b FROM kg WHERE rank <= 10 UNION ALL SELECT 'Ensemble', a, b FROM best UNION ALL SELECT 'Ensemble+CB', a, b FROM kept_cb),
keys AS (SELECT DISTINCT a FROM gt WHERE a % 20 = 0 AND a IN (SELECT vec_id FROM embeddings)),
per AS (SELECT mm.model, k.a, (SELECT count(*) FROM gt WHERE gt.a = k.a) AS n_true, count(r.b) AS n_recs, count(g.b) AS hits FROM keys k CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in FIVE)}) mm(model)
 LEFT JOIN rec r ON r.a = k.a AND r.model = mm.model LEFT JOIN gt g ON g.a = r.a AND g.b = r.b GROUP BY 1, 2),
m AS (SELECT *, hits / 10.0 AS p, hits / CAST(n_true AS DOUBLE) AS r FROM per)
SELECT model, count(*) AS test_set_size, count(*) FILTER (WHERE n_recs = 0) AS n_errors, {MEANS} FROM m GROUP BY 1""")
def eval_comparison(s, d):
    gt = truth(s, d)
    keys = evaluate.common_keys(gt, [anchors(s, d).select(F.col("id").alias("product_id"))])
    return evaluate.compare(gt, all_model_panel(s, d), keys, 10, FIVE)


# ---------------------------------------------------------------- survey, reports, study


GT_CONTENT = f"WITH {VECTORS}, {COUNTS}, {GT}, ranked AS (SELECT a, b FROM gt), {SIMS}"
KINDS = "CASE WHEN a % 7 = 0 OR b % 7 = 0 THEN 'cold' WHEN sim >= 0.3 THEN 'substitute' ELSE 'complementary' END"


def _classified(s, d) -> DataFrame:
    gt = truth(s, d)
    return survey.classify(gt, similarity(s, d, gt), dimension(s, d).where("product_id % 7 <> 0"), 0.3)


@query(f"{GT_CONTENT} SELECT a, b, kind FROM (SELECT a, b, {KINDS} AS kind FROM esim) WHERE kind <> 'substitute'")
def gt_filter(s, d):
    return _classified(s, d).where("kind <> 'substitute'").select("a", "b", "kind")


@query(f"{GT_CONTENT} SELECT kind, count(*) AS n FROM (SELECT {KINDS} AS kind FROM esim) GROUP BY 1")
def gt_filter_stats(s, d):
    return _classified(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS product_id, count(*) AS cnt FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings) GROUP BY 1 HAVING count(*) >= 10")
def safe_pool(s, d):
    counts = baskets.item_counts(table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id")))
    return survey.safe_pool(counts, 10, [table(s, d, "embeddings").select(F.col("vec_id").alias("product_id"))])


@query(f"""WITH {FUSED}, {DIM}, pairs AS (SELECT a, b FROM icf WHERE rank <= 10 UNION SELECT a, b FROM i2v WHERE rank <= 10 UNION SELECT a, b FROM kg WHERE rank <= 10)
SELECT a AS product_a_id, coalesce(x.product_name, 'Unknown(' || a || ')') AS product_a_name, coalesce(x.department, '') AS product_a_dept,
b AS product_b_id, coalesce(y.product_name, 'Unknown(' || b || ')') AS product_b_name, coalesce(y.department, '') AS product_b_dept
FROM pairs LEFT JOIN dim x ON x.product_id = a LEFT JOIN dim y ON y.product_id = b WHERE a IN (SELECT product_id FROM items WHERE c >= 10) AND a IN (SELECT vec_id FROM embeddings)""")
def survey_samples(s, d):
    return survey.samples(safe_pool(s, d), survey.candidates(models(s, d), 10), dimension(s, d))


@query(f"WITH {FUSED}, {GT} SELECT a, b, CASE WHEN (a, b) IN (SELECT (a, b) FROM gt) THEN 1 ELSE 0 END AS llm_label FROM icf WHERE rank <= 10")
def survey_labeled(s, d):
    """The ItemCF lists of all products, labelled."""
    pairs = itemcf.top_k(item_cf(s, d), 10).select("a", "b")
    return pairs.join(truth(s, d).withColumn("ok", F.lit(1)), ["a", "b"], "left").select("a", "b", F.coalesce("ok", F.lit(0)).alias("llm_label"))


OVERLAP = """tok AS (SELECT DISTINCT p_partkey AS product_id, unnest(string_split(lower(trim(p_name)), ' ')) AS token FROM part),
ov AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS overlap, string_agg(x.token, ', ' ORDER BY x.token) AS common FROM tok x JOIN tok y USING (token) WHERE x.product_id < y.product_id GROUP BY 1, 2),
study AS (SELECT a, b, overlap, common FROM (SELECT *, row_number() OVER (PARTITION BY overlap ORDER BY (a * 7919 + b * 104729) % 1000003, a, b) AS r FROM ov) WHERE r <= 1000)"""


def _study(s, d) -> DataFrame:
    return survey.sample_per_overlap(dimension(s, d))


@query(f"WITH {OVERLAP} SELECT a, b, overlap, common FROM study")
def overlap_pairs(s, d):
    return _study(s, d)


STUDY = f"WITH {VECTORS}, {COUNTS}, {OVERLAP}, ranked AS (SELECT a, b FROM study), {SIMS}, sims AS (SELECT s.overlap, t.sim AS tfidf, o.ovl, e.sim AS blend FROM study s JOIN tsim t USING (a, b) JOIN osim o USING (a, b) JOIN esim e USING (a, b))"


def _study_sims(s, d) -> DataFrame:
    pairs, dim = _study(s, d).persist(), dimension(s, d)
    v, c = content.multi_field(dim, FIELDS), content.count_vectors(dim)
    both = content.tfidf_similarity(pairs, v).withColumnRenamed("sim", "tfidf").join(content.overlap_similarity(pairs, c).select("a", "b", "ovl"), ["a", "b"])
    return both.withColumn("blend", 0.5 * F.col("ovl") + 0.5 * F.col("tfidf")).join(pairs.select("a", "b", "overlap"), ["a", "b"])


@query(f"{STUDY} SELECT overlap, count(*) AS pairs, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("tfidf", "ovl", "blend")) + " FROM sims GROUP BY 1")
def overlap_stats(s, d):
    return _study_sims(s, d).groupBy("overlap").agg(F.count("*").alias("pairs"), *[x for c in ("tfidf", "ovl", "blend") for x in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))])


@query(f"{STUDY}, long AS (SELECT unnest([{{'m': 'tfidf', 'v': round(tfidf, 9)}}, {{'m': 'ovl', 'v': round(ovl, 9)}}, {{'m': 'blend', 'v': round(blend, 9)}}]) AS x FROM sims) "
       "SELECT measure, bin, format('{:.1f}-{:.1f}', bin / 10.0, (bin + 1) / 10.0) AS label, count(*) AS n FROM (SELECT x.m AS measure, CAST(least(floor(x.v * 10), 9) AS INTEGER) AS bin FROM long WHERE x.v BETWEEN 0 AND 1) GROUP BY 1, 2")
def similarity_histogram(s, d):
    """Of all three measures over the whole study."""
    sims = _study_sims(s, d).persist()
    out = None
    for measure in ("tfidf", "ovl", "blend"):
        one = survey.histogram(sims.select(F.round(measure, 9).alias("v")), "v").select(F.lit(measure).alias("measure"), "bin", "label", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {GT} SELECT a AS product_id FROM gt UNION SELECT b FROM gt")
def unique_ids(s, d):
    gt = truth(s, d)
    return gt.select(F.col("a").alias("product_id")).union(gt.select("b")).distinct()


@query(f"WITH {GT} SELECT row_number() OVER (ORDER BY n DESC, a) AS rank, a AS product_id, coalesce(p_name, '?') AS product_name, n FROM (SELECT a, count(*) AS n FROM gt GROUP BY 1) LEFT JOIN part ON p_partkey = a ORDER BY n DESC, a LIMIT 100")
def top_suggested(s, d):
    top = truth(s, d).groupBy("a").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "a").limit(100)
    named = top.join(dimension(s, d).select(F.col("product_id").alias("a"), "product_name"), "a", "left")
    # a report of 100 rows
    return named.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "a")).cast("long").alias("rank"), F.col("a").alias("product_id"), F.coalesce("product_name", F.lit("?")).alias("product_name"), "n")


# ---------------------------------------------------------------- maintenance


KEEP = "c_custkey % 10 <> 3"


def _cascade(s, d) -> dict[str, DataFrame]:
    c, o, li = (table(s, d, t) for t in ("customer", "orders", "lineitem"))
    return maintenance.cascade(c.where(KEEP).select("c_custkey"), [("customer", c, "c_custkey", [], ""), ("orders", o, "o_orderkey", ["o_custkey"], "customer"), ("lineitem", li, "l_linenumber", ["l_orderkey"], "orders")])


@query(f"""WITH c AS (SELECT * FROM customer WHERE {KEEP}), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS tab, (SELECT count(*) FROM customer) AS before, (SELECT count(*) FROM c) AS after UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM l)""")
def cascade_delete_survivors(s, d):
    out = None
    for name, left in _cascade(s, d).items():
        one = table(s, d, name).agg(F.count("*").alias("before")).join(F.broadcast(left.agg(F.count("*").alias("after")))).select(F.lit(name).alias("tab"), "before", "after")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH c AS (SELECT * FROM customer WHERE {KEEP}), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'orders' AS tab, count(*) AS orphans FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c) UNION ALL SELECT 'lineitem', count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'lineitem, all', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def orphan_check(s, d):
    """None after the cascade; lines of the uncut table whose order is gone."""
    left = _cascade(s, d)
    checks = [("orders", left["orders"], left["customer"], "o_custkey", "c_custkey"), ("lineitem", left["lineitem"], left["orders"], "l_orderkey", "o_orderkey"), ("lineitem, all", table(s, d, "lineitem"), left["orders"], "l_orderkey", "o_orderkey")]
    out = None
    for name, child, parents, foreign, key in checks:
        one = maintenance.orphans(child, parents, foreign, key).select(F.lit(name).alias("tab"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out
