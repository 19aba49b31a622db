import __spark_entry__ as entry


def test_contract(spark):
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and "item_cf_topk" in known
    assert set(entry.entry(spark).columns) == {"a", "b", "score", "rank"}
