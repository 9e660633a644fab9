"""Work-list selections (segments).  All are narrow filters: no shuffle,
pushed into the scan where the predicate allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import (as_text, col_or, current_year, is_meaningful, last_note_ts,
                         norm_token, parse_ts, to_number, ustrip, warranty_label,
                         format_reminder)
from ..session import as_of_col


def flag_token(df: DataFrame):
    """Normalised call flag; a missing column counts as '' (untouched)."""
    return norm_token(col_or(df, "called_flag", ""))


def not_done(df: DataFrame):
    return flag_token(df).isin(K.FLAG_NOT_DONE)


def notes_present(df: DataFrame):
    return ustrip(F.coalesce(col_or(df, "notes", "").cast("string"), F.lit(""))) != ""


def seg_processed(df: DataFrame) -> DataFrame:
    """Called (evet/yes/1) or has any note text."""
    return df.where(flag_token(df).isin(K.FLAG_DONE) | notes_present(df))


def seg_trade_in(df: DataFrame) -> DataFrame:
    """Odometer above 60,000 km and not yet called."""
    km = to_number(col_or(df, "odometer_km", 0), 0)
    return df.where((km > K.TRADE_IN_KM) & not_done(df))


def seg_warranty(df: DataFrame, as_of=None) -> DataFrame:
    """Model year at least three years back and not yet called (junk or
    missing year counts as this year)."""
    cy = current_year(as_of)
    year = to_number(col_or(df, "model_year", None), cy)
    return df.where((year <= cy - K.WARRANTY_SEGMENT_AGE) & not_done(df))


def with_warranty_label(df: DataFrame, as_of=None) -> DataFrame:
    return df.withColumn("warranty_label", warranty_label(F.col("model_year"), as_of))


def seg_untouched(df: DataFrame) -> DataFrame:
    """Not yet called.  A null flag is *not* untouched (it reads as 'none')."""
    return df.where(not_done(df))


def seg_low_quality(df: DataFrame) -> DataFrame:
    return df.where(norm_token(col_or(df, "close_reason", "")).isin(K.LOW_QUALITY_REASONS))


def seg_test_drive(df: DataFrame) -> DataFrame:
    return df.where(norm_token(col_or(df, "test_drive_status", "")).isin(K.TEST_DRIVE_DONE))


def seg_called(df: DataFrame) -> DataFrame:
    """Flag exactly 'Evet' (case-sensitive, untrimmed): the performance
    pages' definition.  No flag column -> no rows."""
    if "called_flag" not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col("called_flag") == K.CALLED_EXACT)


def reminder_due_ts(df: DataFrame):
    return parse_ts(F.replace(F.col("reminder_at"), F.lit("T"), F.lit(" ")))


def reminder_list(df: DataFrame) -> DataFrame:
    """Meaningful, parsable reminders in due order, shown as
    'dd-MM-yyyy HH:mm'."""
    r = F.col("reminder_at")
    due = reminder_due_ts(df)
    return (
        df.where(is_meaningful(r, reject_dash=False))
        .withColumn("due_ts", due)
        .where(F.col("due_ts").isNotNull())
        .withColumn("reminder_at", format_reminder(r))
        .orderBy("due_ts", "customer_id")
    )


def birthdays_today(df: DataFrame, as_of=None) -> DataFrame:
    """Customers whose birth month and day equal today's (Feb 29 matches
    only on Feb 29)."""
    now = as_of_col(as_of)
    bd = parse_ts(as_text(col_or(df, "birth_date", None)))
    name = col_or(df, "full_name", K.DEFAULT_BIRTHDAY_NAME)
    month, day = F.month(bd), F.dayofmonth(bd)
    if "birth_month" in df.columns:  # typed columns: the filter reaches the scan
        month, day = F.col("birth_month"), F.col("birth_day_of_month")
    return (
        df.where((month == F.month(now)) & (day == F.dayofmonth(now)))
        .select("customer_id", as_text(name).alias("full_name"))
    )


def birthdays_month(df: DataFrame, as_of=None) -> DataFrame:
    """Customers with a parsable birth date in the current month (none when
    the table has no birth-date column)."""
    if "birth_date" not in df.columns:
        df = df.withColumn("birth_date", F.lit(None).cast("string"))
    now = as_of_col(as_of)
    if "birth_month" in df.columns:
        return (df.where(F.col("birth_month") == F.month(now))
                .select("customer_id", "full_name", "birth_date", F.col("birth_day_of_month").alias("birth_day")))
    b = F.col("birth_date")
    bd = parse_ts(b)
    return (
        df.where(b.isNotNull() & (ustrip(b) != ""))
        .withColumn("birth_ts", bd)
        .where(F.col("birth_ts").isNotNull() & (F.month("birth_ts") == F.month(now)))
        .select("customer_id", "full_name", "birth_date",
                F.dayofmonth("birth_ts").alias("birth_day"))
    )


def processed_archive(df: DataFrame) -> DataFrame:
    """Processed records, newest note first (nulls last)."""
    out = seg_processed(df)
    if "notes" not in out.columns:
        return out
    return (out.withColumn("last_note_ts", last_note_ts(F.col("notes")))
            .orderBy(F.col("last_note_ts").desc_nulls_last(), F.col("customer_id")))


def kpi_summary(df: DataFrame, as_of=None) -> DataFrame:
    """Dashboard counters in one pass over the table."""
    cy = current_year(as_of)
    km = to_number(col_or(df, "odometer_km", 0), 0)
    year = to_number(col_or(df, "model_year", None), cy)
    nd = not_done(df)
    return df.agg(
        F.count_if((km > K.TRADE_IN_KM) & nd).alias("trade_in"),
        F.count_if(nd).alias("untouched"),
        F.count_if((year <= cy - K.WARRANTY_SEGMENT_AGE) & nd).alias("warranty"),
        F.count(F.lit(1)).alias("total"),
    )
