"""Sources and sinks: schema gate, fallback load, audit log, export,
station feed snapshots."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from paths import SF001, SF01
from dealerlens.session import scratch_path
from dealerlens.sources import fixtures as fx
from dealerlens.sources import stations as ST
from dealerlens.sources import tables as T


def test_schema_gate_empty_table(spark):
    c = fx.customers(spark, SF001).where(F.lit(False))
    rows = T.schema_gate(c).collect()
    assert all(r.present for r in rows) and not any(r.ok for r in rows)
    assert not T.gate_passes(c)


def test_load_with_fallback_paths(spark):
    # no fallback: empty frame of the required columns
    empty = T.load_with_fallback(spark, scratch_path(spark, "missing"))
    assert empty.count() == 0 and empty.columns == T.REQUIRED_COLUMNS
    # readable primary that passes the gate is returned as is
    path = scratch_path(spark, "customers")
    T.rebuild_table(fx.customers(spark, SF001), path)
    assert T.load_with_fallback(spark, path, fallback=lambda: 1 / 0).count() == 150
    # primary failing the gate is rebuilt from the fallback (rebuild errors swallowed)
    bad = scratch_path(spark, "bad")
    spark.createDataFrame([(1,)], "x int").write.parquet(bad)
    assert T.load_with_fallback(spark, bad, fallback=lambda: fx.customers(spark, SF001)).count() == 150


def test_strip_headers_on_csv(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, "a")], "id int, name string").toDF(" id ", "name  ") \
        .write.option("header", True).csv(path)
    df = T.load_customers(spark, path, fmt="csv", header=True)
    assert df.columns == ["id", "name"]


def test_audit_append_and_order(spark):
    logs = scratch_path(spark, "logs")
    T.rebuild_table(spark.createDataFrame([], "customer_id long"), scratch_path(spark, "c"), logs)
    T.rebuild_table(spark.createDataFrame([], "customer_id long"), scratch_path(spark, "c"), logs)  # kept
    rows = spark.createDataFrame(
        [("2001-08-01 10:00:00", "u", "t", "d1"), ("2001-08-01 11:00:00", "u", "t", "d2")], T.LOG_SCHEMA)
    assert T.audit_append(rows, logs)
    assert T.audit_append(rows.limit(1), logs)
    got = [r.detail for r in T.audit_log(spark, logs).collect()]
    assert got[0] == "d2" and len(got) == 3
    assert T.audit_log(spark, scratch_path(spark, "nolog")).count() == 0


def test_report_export_csv(spark):
    from dealerlens.plans.reports import report
    out = scratch_path(spark, "exports")
    logs = scratch_path(spark, "logs")
    df = report(fx.customers(spark, SF001), "low_quality")
    path = T.report_export(df, "low_quality", out, user="Ali", logs_path=logs)
    assert os.path.basename(path) == "Kalitesiz_Veri_Raporu_01_08_2001"
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["customer_id", "action_date", "full_name", "contact_channel", "close_reason"]
    assert back.count() == 39
    log = T.audit_log(spark, logs).first()
    assert log.user_name == "Ali" and "Kalitesiz_Veri_Raporu_01_08_2001.xlsx" in log.detail


def test_report_export_csv_round_trip_with_notes(spark):
    """Multi-line notes, quotes and padded values survive the CSV export."""
    from dealerlens.plans.reports import report
    df = report(fx.customers(spark, SF001), "trade_in")
    path = T.report_export(df, "trade_in", scratch_path(spark, "exports"))
    back = T.load_customers(spark, path, fmt="csv")
    assert back.count() == df.count() == 33
    cols = ["customer_id", "notes", "phone", "operator"]
    # empty strings come back as null (CSV has no empty-vs-null distinction)
    norm = df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if c != "customer_id" else F.col(c) for c in cols])
    assert norm.exceptAll(back.select(*cols)).count() == 0


def test_export_keeps_all_columns_when_none_listed_exist(spark):
    out = scratch_path(spark, "exports")
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    path = T.report_export(df, "trade_in", out, fmt="parquet")
    assert spark.read.parquet(path).columns == ["a", "b"]


def test_station_snapshots(spark):
    noon = dt.datetime(2001, 8, 1, 12, 0)
    good = '{"elements":[{"lat":40.0,"lon":30.0,"tags":{"amenity":"charging_station"}}]}'
    far = '{"elements":[{"lat":10.0,"lon":30.0,"tags":{"amenity":"charging_station"}}]}'
    empty, broken = '{"elements":[]}', '{"elements":[{"lon":30.0,"tags":{}}]}'

    def shown(*fetches):
        """(fetch, stale) shown at noon after (minutes ago, page...) fetches."""
        rows = [(k, p, noon - dt.timedelta(minutes=m), page)
                for k, (m, *pages) in enumerate(fetches) for p, page in enumerate(pages)]
        df = spark.createDataFrame(rows, "snapshot_id int, page long, fetched_at timestamp_ntz, json string")
        return {(r.snapshot_id, r.is_stale) for r in ST.latest_snapshot(df, noon).collect()}

    assert shown((30, good)) == {(0, False)}
    assert shown((30, good), (5, empty)) == {(0, False)}     # the cache is young enough
    assert shown((30, good), (5, far)) == {(0, False)}       # outside the box only: empty too
    assert shown((30, good), (20, good), (5, broken)) == {(1, False)}
    assert shown((180, good), (5, empty)) == set()           # a refresh that came back empty counts
    assert shown((180, good), (5, far)) == set()
    assert shown((180, good), (5, broken)) == {(0, True)}    # a refresh that failed does not
    assert shown((180, good), (5, good, broken)) == {(0, True)}  # one bad page spoils a fetch
    assert shown((180, good)) == {(0, True)}
    assert shown((5, broken)) == set() and shown((-5, good)) == set()


def test_failing_rebuild_leaves_the_table(spark):
    """A rebuild that fails while it runs, or reads the table it replaces,
    leaves the old files as they were."""
    def files(path):
        return {f: open(os.path.join(path, f), "rb").read() for f in os.listdir(path)}

    path = scratch_path(spark, "customers")
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(path)
    before = files(path)
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        T.rebuild_table(bad, path)
    assert files(path) == before
    with pytest.warns(UserWarning):
        assert T.load_with_fallback(spark, path, fallback=lambda: bad).columns == ["x", "y"]
    assert files(path) == before
    T.rebuild_table(spark.read.parquet(path).withColumn("z", F.lit(1)), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "a", 1)]


def test_read_errors_are_not_taken_for_a_missing_table(spark):
    with pytest.raises(Exception, match="no such format"):
        T.load_with_fallback(spark, "x", fallback=lambda: 1 / 0, fmt="no such format")
