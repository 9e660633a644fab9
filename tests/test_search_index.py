import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealerlens.operators.notes import global_search
from dealerlens.operators.search_index import build, needed, search
from dealerlens.session import scratch_path
from dealerlens.sources import fixtures as fx
from paths import SF001

COLUMNS = "customer_id long, full_name string, phone string, notes string"


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcİı ", k=9)), rng.choice([None, "", "555 12", "ab"]),
             "".join(rng.choices("abé😀\n.|", k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, "abcabc", None, "x"), (7, "again abca", None, None), (7, "again abca", None, None)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    return df, build(df, scratch_path(spark, "index"))


@pytest.mark.parametrize("query,literal", [
    ("abc", False), ("ABCA", True), ("ab.c", False), ("abca*b", False), ("^abc", False), ("none", False), ("None", True),
    ("abc|é", False), ("[ab]cab", False), ("a😀b", True), ("é😀\n", True), ("zzz", False), ("ab", False), ("", False),
    (None, False), ("abcab?", False), ("a.c.b", False), ("b\\.a", False), ("555 12", True), ("cabİ", True)])
def test_indexed_search_equals_the_scan(small, query, literal):
    df, index = small
    want = global_search(df, query, literal=literal)
    got = search(df, index, query, literal)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@settings(max_examples=300, deadline=None)
@given(st.text("abc.*?+^$", min_size=1, max_size=8), st.lists(st.text("abc", max_size=8), max_size=5))
def test_needed_trigrams_are_in_every_hit(pattern, texts):
    import re
    try:
        found = [t for t in texts if re.search(pattern, t)]
    except re.error:
        return
    assert all(g in t for t in found for g in needed(pattern))


def test_a_selective_query_filters_the_scan_by_key(spark):
    path = scratch_path(spark, "customers")
    df = fx.materialize_customers(spark, SF001, path)
    index = build(df, scratch_path(spark, "index"))
    out = search(df, index, "customer#000000012", literal=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0]
    assert "customer_id" in pushed and out.count() == global_search(df, "customer#000000012", literal=True).count() > 0
    assert search(df, index, "no such text anywhere", literal=True).count() == 0


def test_index_rows_are_lists_of_customers(spark):
    """A trigram of many customers fills a few rows, each customer once."""
    rows = [(i, f"customer {i}", "customer" if i % 2 else None, None) for i in range(3000)] + [(None, "customer", None, None)]
    df = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    index = build(df, scratch_path(spark, "index"))
    ust = index.where("gram = 'ust'").collect()
    assert len(ust) < 3000 / 100
    assert sorted(k for r in ust for k in r["keys"]) == list(range(3000))
    assert index.where("gram = 'non'").count() > 0  # what a null reads as
    assert index.where("exists(keys, k -> k IS NULL)").count() == 0
    for query in ("customer 299", "one"):
        assert sorted(map(str, search(df, index, query).collect())) == sorted(map(str, global_search(df, query).collect()))
    empty = df.limit(0)
    assert search(empty, build(empty, scratch_path(spark, "index")), "customer").count() == 0
    short = df.where("customer_id < 2").select("customer_id", F.lit("ab").alias("full_name"))
    index = build(short, scratch_path(spark, "index"))
    assert index.count() == 0 and search(short, index, "ab").count() == 2 and search(short, index, "abc").count() == 0
