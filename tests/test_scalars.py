"""Edge rows for the scalar operators; expected values worked out by hand
from the dashboard's pandas / Python semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealerlens import functions as X


def col_values(spark, values, expr_fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr_fn(F.col("v"))).collect()]


def test_norm_token(spark):
    vals = ["\t Evet\n", " HAYIR ", "BİLGİ", None, "Hayır", " YES "]
    assert col_values(spark, vals, X.norm_token) == [
        "evet", "hayir", "bi̇lgi̇", "none", "hayır", "yes"]


def test_to_number(spark):
    vals = ["1d", "1_000", "12,5", "NaN", "1e3", " 12 ", "", None, "-5.5", ".5", "inf", "-Infinity", " +inf "]
    got = col_values(spark, vals, lambda c: X.to_number(c, 0))
    assert got == [0.0, 0.0, 0.0, 0.0, 1000.0, 12.0, 0.0, 0.0, -5.5, 0.5,
                   float("inf"), float("-inf"), 0.0]


def test_format_phone(spark):
    vals = ["+90 532 123 45 67", "5321234567", "05321234567", "15321234567", "abc", "  ", None, "12345"]
    assert col_values(spark, vals, X.format_phone) == [
        "0 532 123 45 67", "0 532 123 45 67", "0 532 123 45 67", "15321234567", "abc", "-", "-", "12345"]


def test_warranty_label(spark):
    vals = ["1998", "1996", "1995.5", "1995", "1994", None, "abc"]
    got = col_values(spark, vals, lambda c: X.warranty_label(c, "2001-08-01 12:00:00"))
    assert got == ["3 Yıl Kaldı", "1 Yıl Kaldı", "0 Yıl Kaldı", "Bu Yıl Bitiyor", "Süresi Doldu", "-", "-"]
    status = col_values(spark, got, X.warranty_status)
    assert status == ["active", "active", "active", "ending", "expired", None, None]


def test_last_note_ts(spark):
    vals = [
        None,
        "no date here",
        "01.02.2001 10:00 | a | b",
        "05.03.2001 10:00 | a | b\n01.02.2001 09:00 | a | c",  # last by position, not max
        "31.02.2001 10:00 | a | b",  # invalid date
        "01.01.2001 10:00 | a | meet on 02.02.2001 11:30",  # date typed in the text
    ]
    assert col_values(spark, vals, X.last_note_ts) == [
        None, None, dt.datetime(2001, 2, 1, 10, 0), dt.datetime(2001, 2, 1, 9, 0), None,
        dt.datetime(2001, 2, 2, 11, 30)]


def test_clean_display_and_meaningful(spark):
    vals = ["1980-05-01 00:00:00", "  ", "nan", "NaT", None, " Konya ", "-"]
    assert col_values(spark, vals, X.clean_display) == ["1980-05-01", "-", "-", "-", "-", "Konya", "-"]
    ok = col_values(spark, vals, lambda c: F.coalesce(X.is_meaningful(c), F.lit(False)))
    assert ok == [True, False, False, True, False, True, False]


def test_normalize_city(spark):
    vals = [" İZMİR ", "ankara", "Şanlıurfa", None]
    assert col_values(spark, vals, X.normalize_city) == ["IZMIR", "ANKARA", "SANLIURFA", "NONE"]


def test_parse_and_format_dates(spark):
    vals = ["2001-08-01", "2001-08-01T10:30", "2001-08-01 10:30:05", "01.08.2001", "bad", "", None]
    got = col_values(spark, vals, X.parse_ts)
    assert got[:4] == [dt.datetime(2001, 8, 1), dt.datetime(2001, 8, 1, 10, 30),
                       dt.datetime(2001, 8, 1, 10, 30, 5), dt.datetime(2001, 8, 1)]
    assert got[4:] == [None, None, None]
    assert col_values(spark, vals, X.format_date) == [
        "01-08-2001", "01-08-2001", "01-08-2001", "01-08-2001", "-", "-", "-"]
    assert col_values(spark, ["2001-08-01T10:30", "nan"], X.format_reminder) == ["01-08-2001 10:30", None]


def test_goal_progress(spark):
    vals = [0, 7, 34, 35, 100]
    assert col_values(spark, vals, X.goal_progress, "long") == [0, 20, 97, 100, 100]
    assert col_values(spark, vals, X.goal_met, "long") == [False, False, False, True, True]


def test_station_name(spark):
    df = spark.createDataFrame(
        [({"operator": "op", "brand": "b"},), ({"brand": ""},), ({"name": "istasyon"},), ({},)],
        "tags map<string,string>")
    got = [r[0] for r in df.select(X.station_name("tags")).collect()]
    assert got == ["OP", "", "ISTASYON", "BILINMEYEN ŞARJ İSTASYONU"]


def test_note_line(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2001, 8, 1, 9, 5), "Ali", "  hello ", "2001-08-02T10:00"),
         (dt.datetime(2001, 8, 1, 9, 5), None, "x", "")],
        "ts timestamp_ntz, a string, t string, r string")
    got = [r[0] for r in df.select(X.note_line("ts", "a", "t", "r")).collect()]
    assert got == ["01.08.2001 09:05 | Ali | hello (⏰ Hatırlatıcı Kuruldu: 2001-08-02 10:00)",
                   "01.08.2001 09:05 | None | x"]


def test_geo_jitter_bound(spark):
    df = spark.range(2000).select(X.geo_jitter(F.col("id"), "lat").alias("j"))
    lo, hi = df.agg(F.min("j"), F.max("j")).first()
    assert -0.008 <= lo < 0 < hi < 0.008


@pytest.mark.parametrize("missing", ["occupation", "last_service_date"])
def test_safe_col_missing(spark, missing):
    df = spark.createDataFrame([(1,)], "customer_id long")
    assert df.select(X.col_or(df, missing, "-")).first()[0] == "-"
