"""Worked examples and edge cases of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from basketloom.functions import scores, text
from basketloom.operators import baskets, catalog, content, embed, evaluate, fusion, graph, itemcf, maintenance, survey
from basketloom.recommenders import ContentFilter, Ensemble, Item2Vec, ItemCF, KGMetapath
from basketloom.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def lines(spark, orders):
    data = [(o, i + 1, p) for o, items in enumerate(orders) for i, p in enumerate(items)]
    return spark.createDataFrame(data, "order_id long, pos int, product_id long")


def test_support_holds_for_each_direction(spark):
    x = lines(spark, [[1, 2]] * 12 + [[2, 1]] * 9)
    assert rows(baskets.cooccurrence(x, 10)) == [(1, 2, 12), (2, 1, 12)]
    assert rows(baskets.cooccurrence(x, 10, mode="undirected")) == [(1, 2, 21), (2, 1, 21)]
    assert len(rows(baskets.cooccurrence(x, 0))) == 2


def test_repeats_multiply_and_equal_items_make_no_pair(spark):
    assert rows(baskets.directed_pairs(lines(spark, [[1, 1, 2], [3, 3, 3]]))) == [(1, 2, 2)]
    assert rows(baskets.item_counts(lines(spark, [[1, 1, 2]]))) == [(1, 2), (2, 1)]


def test_association_score(spark):
    df = spark.createDataFrame([(30, 100, 500), (1, 0, 5), (60_000, 2_000_000_000, 2_000_000_000)], "c long, a long, b long")
    got = [r[0] for r in df.select(scores.association(F.col("c"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(30 / math.sqrt(50000) * 0.3 * math.log(31), abs=1e-12) and got[1] == 0 and got[2] > 0


def test_top_k_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 4, 0.0), (1, 1, 9.0)], "a long, b long, score double")
    assert [tuple(r)[:2] for r in itemcf.top_k(df, 2).orderBy("rank").collect()] == [(1, 2), (1, 3)]


@pytest.mark.parametrize(
    "given, wanted",
    [("Sữa 500ml & Bánh mì", "sữa bánh mì"), ("a&b c-d", "ab c d"), (None, ""), ("", ""), ("Cỡ 5 TÁO với mật", "táo mật"), ("2,5 kg gạo", "gạo"), ("size 3 pad 12 count", "pad")],
)
def test_cleaner(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == wanted


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("sữa chua nguyên chất vinamilk",), ("dầu ô liu",), ("x",)], "t string")
    got = [r[0] for r in df.select(text.ngrams(text.tokens(F.col("t")), 2)).collect()]
    assert len(got[0]) == 9 and "nguyên chất" in got[0]
    assert got[1] == ["dầu", "liu", "dầu liu"] and got[2] == []


def test_overlap_coefficient(spark):
    p = spark.createDataFrame([(1, "Sữa tươi Vinamilk"), (2, "Sữa tươi TH True Milk"), (3, "Sữa tươi Vinamilk đường"), (4, "Sữa tươi"), (5, "")], "product_id long, product_name string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 5)], "a long, b long")
    got = {(r.a, r.b): r.ovl for r in content.overlap_similarity(pairs, content.count_vectors(p)).collect()}
    assert got[1, 2] == pytest.approx(2 / 3) and got[3, 4] == 1 and got[1, 5] == 0


def test_same_aisle_floor(spark):
    p = spark.createDataFrame([(1, "táo", "trái cây"), (2, "lê", "trái cây"), (3, "vải", "khác")], "product_id long, product_name string, aisle string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    v = content.multi_field(p, [("product_name", 2, 15000, 1.0), ("aisle", 1, 500, 0.8)])
    sim = content.ensemble_similarity(pairs, v, content.count_vectors(p))
    assert {(r.a, r.b): round(r.sim, 6) for r in sim.collect()} == {(1, 2): 0.32, (1, 3): 0.0}
    given = pairs.withColumn("rank", F.lit(1))
    assert [(r.a, r.b) for r in content.substitute_filter(given, sim, p, 0.25).collect()] == [(1, 3)]
    cold = content.substitute_filter(given, sim, p.where("product_id <> 2"), 0.25)
    assert sorted((r.a, r.b, r.is_cold) for r in cold.collect()) == [(1, 2, True), (1, 3, False)]


def test_vocabulary_cap(spark):
    p = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "product_id long, product_name string")
    assert {r.term for r in content.count_vectors(p, cap=2).collect()} == {"aa", "bb"}


def test_fusion_min_max(spark):
    one = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.0)], "a long, b long, score double")
    none = spark.createDataFrame([], "a long, b long, score double")
    got = {r.b: r.score for r in fusion.fuse([one, none], [0.5, 0.25]).collect()}
    assert got[2] == pytest.approx(0.5 + 0.125, abs=1e-6) and got[3] == pytest.approx(0.125, abs=1e-6)


def test_metrics(spark):
    assert spark.range(1).select(scores.f1(F.lit(0.8), F.lit(0.2)), scores.f1(F.lit(0.5), F.lit(0.5))).first() == pytest.approx((0.32, 0.5), abs=1e-6)
    truth = spark.createDataFrame([(1, b) for b in range(10, 30)] + [(2, 5)], "a long, b long")
    recs = spark.createDataFrame([(1, b, i + 1) for i, b in enumerate(range(24, 34))], "a long, b long, rank int")
    keys = truth.select("a").distinct()
    row = evaluate.per_key(truth, recs, keys, 10).where("a = 1").first()
    assert (row.precision, row.recall, row.hit) == (0.6, 0.3, 1.0)
    fair = evaluate.fair(truth, recs, keys, 10, "m").first()
    assert (fair.test_set_size, fair.n_errors, fair.precision_at_10) == (2, 1, 0.3)
    skip = evaluate.skipping(truth, recs, keys, 10, "m").first()
    assert (skip.n_targets, skip.n_evaluated, skip.n_skipped, skip.precision_at_10) == (2, 1, 1, 0.6)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 1, 4), (2, 3, 9)], "a long, b long, cnt long")
    assert rows(graph.adjacency(edges)) == [(1, [2, 2]), (2, [1, 1, 3]), (3, [2])]
    products = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "product_id long, aisle_id long")
    assert rows(graph.semantic_starts(products)) == [(1,), (2,)]
    assert graph.hops(edges, products)[0].where("node = 2").first()[1:] == (3, "7", 1, 2)


def walked(edges, products, num, length, ratio):
    """Walks by definition, with the same draws."""
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    cat = {p: c for p, c in products if c is not None}
    fellows = lambda p: sorted(q for q in cat if p in cat and cat[q] == cat[p] and q != p)
    beh, sem = sorted(near), sorted(p for p in cat if fellows(p))
    if not sem:
        sem, ratio = beh, 1.0
    out = {}
    for w in range(max(len(beh), len(sem)) * num):
        draw = lambda step, n: (w * 7919 + step * 104729 + 42) % 1000003 % n
        behavioural = draw(0, 1000) < ratio * 1000
        walk = [beh[w % len(beh)] if behavioural and beh else sem[w % len(sem)]]
        for step in range(1, length):
            here = walk[-1]
            others, links = fellows(here), sorted(near.get(here, []))
            if not behavioural and others:
                walk.append(others[draw(step, len(others))])
            elif links:
                walk.append(links[draw(step, len(links))])
            elif behavioural:
                walk.append(sem[w % len(sem)])
            else:
                break
        if len(walk) > 1:
            out[w] = walk
    return out


@pytest.mark.parametrize(
    "edges, products",
    [
        ([(1, 2, 5), (2, 1, 4), (2, 3, 9)], [(1, 7), (2, 7), (3, 8), (4, 9)]),
        ([(1, 2, 5), (5, 2, 1)], [(1, 7), (2, 8), (3, None), (4, 9), (5, 7), (9, 9)]),  # ids without a product, without a category
        ([(1, 2, 5), (3, 4, 1)], [(1, 1), (2, 2), (3, 3), (4, 4)]),  # no semantic start
        ([], [(1, 7), (2, 7), (3, 8)]),  # no edge: behavioural walks jump to their semantic start
        ([], [(1, 7), (2, 8)]),  # no start
        ([(1, i, 3) for i in range(2, 40)], [(i, 1) for i in range(1, 40)]),  # a hub and one category
    ],
)
def test_walks_against_brute_force(spark, edges, products):
    e = spark.createDataFrame(edges, "a long, b long, cnt long")
    p = spark.createDataFrame(products, "product_id long, aisle_id long")
    got = {r.walk_id: r["items"] for r in graph.walks(e, p, 3, 6).collect()}
    assert got == walked(edges, products, 3, 6, 0.5)


@pytest.mark.parametrize("most", [-1, 100])
def test_walks_in_memory_and_by_joins(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "SMALL_GRAPH", most)
    edges, products = [(i, i * i % 12, 3) for i in range(1, 11)], [(i, None if i % 5 == 0 else i % 3) for i in range(14)] + [(20, 9)]
    e, p = spark.createDataFrame(edges, "a long, b long, cnt long"), spark.createDataFrame(products, "product_id long, aisle_id long")
    got = graph.walks(e, p, 4, 7)
    plan = got._jdf.queryExecution().toString()
    assert ("MapInArrow" in plan) == (most > 0) and ("Join" in plan) == (most < 0)
    assert {r.walk_id: r["items"] for r in got.collect()} == walked(edges, products, 4, 7, 0.5)


def test_indexed_numbers_ids_in_order(spark):
    ids = [5, 5, None, -7, 10**12, 0, 3]
    got = graph.indexed(spark.createDataFrame([(i,) for i in ids], "node long"), "node", "i").orderBy("i").collect()
    assert [(r.node, r.i) for r in got] == [(-7, 0), (0, 1), (3, 2), (5, 3), (10**12, 4)]


def test_cosine_top_k(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [2.0, 2.0]), (6, None)], "id long, vec array<double>")
    got = [(r.b, r.score) for r in embed.cosine_top_k(v.where("id = 1"), v, 5).orderBy("rank").collect()]
    assert got == [(2, 0.707107), (5, 0.707107)]
    assert len(embed.cosine_top_k(v.where("id = 1"), v, 5, positive=False, block=2).collect()) == 3
    assert embed.cosine_top_k(v.where("id = 99"), v, 5).count() == 0


def test_exclusion_keeps_null_keys(spark):
    x = spark.createDataFrame([(1,), (2,), (None,)], "product_id long")
    assert rows(catalog.without(x, spark.createDataFrame([(1,), (None,)], "product_id long"))) == [(2,), (None,)]


def test_histogram_closes_last_bin(spark):
    x = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (1.2,), (None,)], "v double")
    assert rows(survey.histogram(x, "v")) == [(0, "0.0-0.1", 2), (9, "0.9-1.0", 1)]


def test_cascade(spark):
    c = spark.createDataFrame([(1,), (2,)], "c long")
    o = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "o long, c long")
    out = maintenance.cascade(c.where("c = 1"), [("c", c, "c", [], ""), ("o", o, "o", ["c"], "c")])
    assert rows(out["o"].select("o")) == [(10,), (12,)]
    with pytest.raises(ValueError):
        maintenance.cascade(c.where("c = 9"), [("c", c, "c", [], "")])


def test_sources(spark, tmp_path):
    (tmp_path / "order_products__prior.csv").write_text("order_id,product_id,add_to_cart_order,reordered\n1,2,1,0\n")
    got = readers.read_order_products(spark, str(tmp_path), train=False)
    assert rows(got) == [(1, 2, 1, 0)]
    assert readers.read_order_products(spark, str(tmp_path), False, False).count() == 0
    assert readers.read_optional(spark, str(tmp_path / "no.csv"), "aisles") is None
    (tmp_path / "words.txt").write_text(" Và \n\nvà\ncho\n")
    assert readers.read_words(spark, str(tmp_path / "words.txt")) == ["cho", "và"]
    (tmp_path / "gt.csv").write_text("product_A_id,product_B_id,description\n1,196,x\n1,27125,y\n4,24020,z\n1,196,x\n")
    assert rows(readers.read_ground_truth(spark, str(tmp_path / "gt.csv"))) == [(1, 196), (1, 27125), (4, 24020)]
    readers.save_model({"edges": got}, {"min_support": 10}, str(tmp_path / "model"))
    tables, settings = readers.load_model(spark, str(tmp_path / "model"), ["edges"])
    assert rows(tables["edges"]) == rows(got) and settings == {"min_support": 10}
    with pytest.raises(FileNotFoundError):
        readers.require(spark, str(tmp_path / "missing"))


def test_overlap_sample_is_the_first_of_all_pairs(spark, monkeypatch):
    """Also where bands turn out too narrow."""
    rng = random.Random(3)
    names = [" ".join(rng.choice(["red", "Red", "blue", "old", "new", "box", "cup"]) for _ in range(rng.randint(0, 4))) for _ in range(70)] + [None, " "]
    products = spark.createDataFrame([(i * 7, n) for i, n in enumerate(names)], "product_id long, product_name string")
    sets = {i * 7: set((n or "").lower().split()) for i, n in enumerate(names)}
    pairs = {}
    for a in sets:
        for b in sets:
            common = sets[a] & sets[b]
            if a < b and common:
                pairs.setdefault(len(common), []).append(((a * survey.LEFT + b * survey.RIGHT) % survey.PRIME, a, b, ", ".join(sorted(common))))
    for most, levels in ((20, (1, 10)), (10**6, (2, 3)), (1, (1, 10))):
        told = sorted((a, b, n, c) for n, found in pairs.items() if levels[0] <= n <= levels[1] for _, a, b, c in sorted(found)[:most])
        assert sorted(map(tuple, survey.sample_per_overlap(products, most, levels).collect())) == told
    assert survey.sample_per_overlap(products.where("false")).count() == 0


def test_swap_replaces_all_tables_or_none(spark, tmp_path):
    folder = f"file://{tmp_path}/db"
    spark.range(5).write.parquet(f"{folder}/a.parquet")
    spark.range(7).write.parquet(f"{folder}/b.parquet")
    with pytest.raises(Exception, match="(?i)divi"):
        maintenance.swap(spark, {"a": spark.range(2), "b": spark.range(3).select(F.expr("1 / (id - 1)").alias("id"))}, folder)
    count = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").count()
    assert (count("a"), count("b")) == (5, 7) and sorted(p.name for p in tmp_path.iterdir()) == ["db"]
    maintenance.swap(spark, {"a": spark.read.parquet(f"{folder}/a.parquet").where("id < 3")}, folder)
    assert (count("a"), count("b")) == (3, 7) and sorted(p.name for p in tmp_path.iterdir()) == ["db"]
    with pytest.raises(ValueError):
        maintenance.cascade(spark.range(0), [("a", spark.range(3), "id", [], "")])


def test_missing_optional_file_and_made_table(spark, tmp_path, caplog):
    assert readers.read_optional(spark, f"{tmp_path}/aisles_vi.csv", "aisles_vi") is None and "missing" in caplog.text
    assert readers.read_words(spark, f"{tmp_path}/words.txt") == []
    cleaned = spark.createDataFrame([("Sữa 500ml & Bánh",)], "t string").select(text.clean_text(F.col("t"), []).alias("c")).first().c
    assert cleaned == "sữa bánh"
    made = []
    for _ in range(2):
        table = readers.saved_or_made(spark, f"{tmp_path}/t", lambda: made.append(1) or spark.range(3))
    assert made == [1] and table.count() == 3
    with pytest.raises(FileNotFoundError, match="(?s)x.*settings"):
        readers.load_model(spark, f"{tmp_path}/none", ["x"])


def test_jdbc_source(spark):
    url = "jdbc:derby:memory:basketloom;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(4).withColumn("name", F.lit("x")).write.format("jdbc").options(url=url, dbtable="things", driver=driver).mode("overwrite").save()
    assert readers.read_jdbc(spark, url, "things", driver=driver).count() == 4


def test_settings_of_recommenders():
    assert ItemCF().settings == {"min_support": 10, "top_k": 100}
    assert ItemCF(min_support=2, top_k=None).settings == {"min_support": 2, "top_k": 100}
    assert (Item2Vec().settings["dim"], KGMetapath().settings["num_walks"], ContentFilter().settings["threshold"]) == (128, 20, 0.25)
    with pytest.raises(TypeError):
        Ensemble(min_support=1)


def test_vectors_of_missing_ids_are_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    got = embed.completed(v, spark.createDataFrame([(1,), (2,)], "product_id long"), 2)
    assert sorted(map(tuple, got.collect())) == [(1, [1.0, 2.0]), (2, [0.0, 0.0])]


def test_ensemble_keeps_its_models_when_stored(spark, tmp_path):
    lines = spark.createDataFrame([(o, p, x) for o in range(12) for p, x in enumerate(sorted({o % 3, 3, 4 + o % 2}))], "order_id long, pos int, product_id long")
    products = spark.createDataFrame([(i, f"name{i} thing", f"aisle{i % 2}", i % 2, "dep") for i in range(6)], "product_id long, product_name string, aisle string, aisle_id long, department string")
    models = [ItemCF(min_support=1).fit(lines, products), KGMetapath(num_walks=2, walk_length=4, epochs=1, edge_threshold=1, dim=4, partitions=1).fit(lines, products)]
    e = Ensemble(final_k=2, weights=(0.6, 0.4)).fit(models, ContentFilter(threshold=0.9).fit(products))
    e.save(f"{tmp_path}/e")
    back = Ensemble.load(spark, f"{tmp_path}/e")
    assert [type(m) for m in back.models] == [ItemCF, KGMetapath] and back.settings["final_k"] == 2 and back.filter.settings["threshold"] == 0.9
    asked = spark.createDataFrame([(3,), (99,)], "product_id long")
    assert rows(back.recommend(asked)) == rows(e.recommend(asked)) and {r.a for r in back.recommend(asked).collect()} == {3}
    assert back.recommend(asked, k=4).count() > 2 and back.compare(asked).count() >= 0
    assert Ensemble.load(spark, f"{tmp_path}/e", with_models=False).settings == e.settings


def test_pairs_counted_already_serve_both_models(spark, monkeypatch):
    lines = spark.createDataFrame([(o, i, p) for o in range(4) for i, p in enumerate((1, 2, 3 + o))], "order_id long, pos long, product_id long")
    products = spark.createDataFrame([(i, 7) for i in range(1, 5)], "product_id long, aisle_id long")
    pairs = baskets.directed_pairs(baskets.known_only(lines, products)).where("cnt >= 2")
    wanted = rows(ItemCF(min_support=2).fit(lines, products).tables["cooc"])
    monkeypatch.setattr(baskets, "directed_pairs", None)
    monkeypatch.setattr(KGMetapath, "_train", lambda self, sentences: None)
    assert rows(ItemCF(min_support=2).fit(lines, products, pairs).tables["cooc"]) == wanted == [(1, 2, 4), (2, 1, 4)]
    assert rows(KGMetapath(edge_threshold=2).fit(lines, products, pairs=pairs).tables["edges"]) == [(1, 2, 4)]
