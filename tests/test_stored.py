"""Stored forms: key ranges, exactly-once log, moved counts, stored pages."""

import os
import random

import pytest
from pyspark.sql import functions as F

from dealerlens.operators import mutations as M
from dealerlens.operators.ordering import page, store_sorted, stored_page
from dealerlens.plans.dashboard import (TeamPerformance, call_counts, cube_of_counts, moved_counts,
                                        performance_cube)
from dealerlens.session import scratch_path
from dealerlens.sources import audit, ranges
from dealerlens.sources import fixtures as fx
from paths import SF001

PATCH = "patch_ts timestamp_ntz, seq long, customer_id long, user_name string, reason string, reminder string, note string"
LOG = "log_ts string, user_name string, action_type string, detail string"


def rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet"))
            for d in os.listdir(path) if "=" in d}


def scan_metrics(df):
    """Rows and files read by the one scan of a plan without exchanges."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return {k: plan.apply(k).value() for k in ("numFiles", "numOutputRows")}


@pytest.fixture(scope="module")
def customers(spark):
    odd = fx.customers(spark, SF001).limit(2)
    base = fx.customers(spark, SF001)
    keyless = odd.withColumn("customer_id", F.lit(None).cast("long"))
    path = scratch_path(spark, "base")
    base.unionByName(keyless).unionByName(odd.withColumn("customer_id", -odd.customer_id)).write.parquet(path)
    return spark.read.parquet(path)


def saves(spark, seed, keys):
    import datetime as dt
    rng = random.Random(seed)
    day = dt.datetime(2001, 7, 1)
    out = [(day + dt.timedelta(days=rng.randint(0, 40), minutes=rng.randint(0, 900)), i, rng.choice(keys),
            rng.choice(["u1", "u2", None]), rng.choice([None, "", "r1", "r2"]), rng.choice([None, "", "2001-09-01T10:00"]),
            rng.choice([None, "", "called"])) for i in range(rng.randint(1, 12))]
    return spark.createDataFrame(out, PATCH)


def test_a_change_rewrites_only_the_ranges_it_touches(spark, customers):
    path = scratch_path(spark, "keyed")
    table = ranges.store(customers, path, width=10)
    assert rows(table.rows()) == rows(customers)
    was = files(f"{path}/rows")
    patches = saves(spark, 1, [3, 7, 25, 10**9, None])
    got = table.change(M.apply_outcome, patches)
    assert rows(got) == rows(M.apply_outcome(customers, patches)) and got.columns == customers.columns
    now = files(f"{path}/rows")
    hit = {f"key_range={r[0] // 10}" for r in patches.select("customer_id").collect() if r[0] is not None}
    changed = {d for d in now if now[d] != was.get(d)}
    assert changed and changed <= hit and set(now) == set(was)


def test_changes_of_every_kind_equal_the_whole_table_form(spark, customers):
    table = ranges.store(customers, scratch_path(spark, "keyed"), width=7)
    want = customers
    ids = spark.createDataFrame([(4,), (4,), (15,), (None,)], "customer_id long")
    dels = spark.createDataFrame([(3, 0), (9, 99), (None, 0)], "customer_id long, line_idx int")
    edits = saves(spark, 2, [1, 2, 30]).selectExpr("*", "'n' AS full_name", "cast(null as string) AS phone",
                                                   "reason AS close_reason")
    for update, patches in ((M.apply_outcome, saves(spark, 3, [3, 4, 9])), (M.delete_note, dels),
                            (M.apply_admin_edit, edits), (M.complete_reminder, ids),
                            (M.complete_reminder, ids.limit(0))):
        want = update(want, patches)
        assert rows(table.change(update, patches)) == rows(want)
    assert rows(ranges.KeyedTable(spark, table.path).rows()) == rows(want)  # another session's reader


def test_a_lookup_reads_one_range(spark, customers):
    table = ranges.store(customers, scratch_path(spark, "keyed"), width=10)
    for key in (7, -1, 60, 10**9):
        assert rows(table.at(key)) == rows(customers.where(customers.customer_id == key))
    one = [f for f in files(f"{table.path}/rows")["key_range=0"]]
    assert scan_metrics(table.at(7))["numFiles"] == len(one)
    assert scan_metrics(table.at(10**9))["numFiles"] == 0


def test_empty_table_and_wrong_use(spark, customers):
    path = scratch_path(spark, "keyed")
    table = ranges.store(customers.limit(0), path)
    assert table.rows().count() == table.at(1).count() == 0 and table.rows().columns == customers.columns
    assert table.change(M.complete_reminder, spark.createDataFrame([(1,)], "customer_id long")).count() == 0
    with pytest.raises(ValueError):
        ranges.store(customers, scratch_path(spark, "k"), width=0)
    with pytest.raises(ValueError):
        table.change(lambda df, p: df.drop("notes"), spark.createDataFrame([(1,)], "customer_id long"))


def test_moved_counts_equal_a_recount_after_every_batch(spark, customers):
    table = ranges.store(customers, scratch_path(spark, "keyed"), width=10)
    counts = call_counts(table.rows())
    for seed in range(4):
        patches = saves(spark, seed, [1, 2, 3, 20, 41, None, 10**9])
        path = scratch_path(spark, "counts")
        moved_counts(counts, table.touching(patches), patches, M.apply_outcome).write.parquet(path)
        counts = spark.read.parquet(path)
        whole = table.change(M.apply_outcome, patches)
        assert rows(counts) == rows(call_counts(whole))
        for as_of in ("2001-08-01 12:00:00", "2001-07-03 00:00:00"):
            assert rows(cube_of_counts(counts, as_of)) == rows(performance_cube(whole, as_of))
    a, b = TeamPerformance(whole), TeamPerformance.from_counts(counts)
    for f in (lambda t: t.calls_by_staff(30), lambda t: t.reasons_by_staff("u1"), lambda t: t.evaluation(365)):
        assert rows(f(a)) == rows(f(b))
    a.close(), b.close()


def test_a_repeated_batch_adds_nothing(spark):
    path = scratch_path(spark, "log")
    assert audit.newest(spark, path).count() == 0 and audit.last_day(spark, path) is None
    one = spark.createDataFrame([("2001-08-01 10:00:00", "a", "X", "1"), ("2001-08-01 10:00:00", "a", "X", "1"),
                                 ("2001-07-31 09:00:00", None, "X", None), (None, "b", "X", "2")], LOG)
    two = spark.createDataFrame([("2001-08-01 11:00:00", "b", "Y", "3")], LOG)
    for batch, df in (("1", one), ("2", two), ("1", one), ("2", two)):
        audit.append_once(df, path, batch)
    got = audit.newest(spark, path).collect()
    assert sorted(map(str, got)) == rows(one.union(two))
    assert [r["log_ts"] for r in got] == ["2001-08-01 11:00:00", "2001-08-01 10:00:00", "2001-08-01 10:00:00",
                                          "2001-07-31 09:00:00", None]
    assert audit.last_day(spark, path) == "2001-08-01"
    last = audit.newest(spark, path, since="2001-08-01")
    assert last.count() == 3 and audit.newest(spark, path, since="1999").count() == 4
    assert audit.newest(spark, path, since="2001-08-01 11:00:00").count() == 1
    plan = last._jdf.queryExecution().executedPlan().toString()
    months, pushed = plan.split("PartitionFilters")[1].split("PushedFilters")
    assert "log_month" in months and "GreaterThanOrEqual(log_ts,2001-08-01)" in pushed
    nameless = path + "-null"
    audit.append_once(one.where("log_ts IS NULL"), nameless, "1")
    assert audit.last_day(spark, nameless) is None and audit.newest(spark, nameless).count() == 1
    with pytest.raises(ValueError):
        audit.append_once(one, path, "")


def test_stored_pages_equal_offset_paging(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice([None, 1, 2, 3]), i, "x") for i in range(500)], "a long, b long, t string")
    path = scratch_path(spark, "sorted")
    store_sorted(df, path, ["a", "b"])
    for n, size in ((0, 12), (1, 12), (7, 60), (41, 12), (42, 12), (0, 500), (3, 130)):
        got = stored_page(spark, path, n, size)
        assert got.columns == df.columns
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in page(df, n, size, ["a", "b"]).collect()]
    store_sorted(df.limit(0), path + "-none", ["a", "b"])
    assert stored_page(spark, path + "-none", 0).count() == 0


def test_a_stored_page_reads_only_its_ranges(spark):
    path = scratch_path(spark, "sorted")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store_sorted(spark.range(100_000).withColumnRenamed("id", "k"), path, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    slices = spark.read.parquet(f"{path}/about").first()["slices"]
    got = stored_page(spark, path, 4000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(slices) > 4 and [r.k for r in got.collect()] == list(range(48_000, 48_012))
    assert "slice" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
