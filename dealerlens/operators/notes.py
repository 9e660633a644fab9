"""Interaction notes (an encoded list inside one text cell), the customer
profile card and the page search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import as_text, clean_display, col_or, ustrip


def _parts(line):
    """Python ``line.split('|', 2)``."""
    return F.split(line, r"\|", 3)


def notes_timeline(df: DataFrame) -> DataFrame:
    """One row per well-formed note line: (customer_id, line_idx, ts_text,
    author, text, deleted).  line_idx counts every line of the cell,
    including the skipped ones, so it addresses lines for delete_note.
    Exploding is narrow: each cell's lines stay in the task that read it."""
    notes = as_text(col_or(df, "notes", None))
    lines = df.select("customer_id", F.posexplode(F.split(notes, "\n")).alias("line_idx", "line"))
    p = _parts(F.col("line"))
    return (
        lines.where(F.col("line").contains("|"))
        .withColumn("p", p)
        .where(F.size("p") == 3)
        .select(
            "customer_id", F.col("line_idx").cast("int").alias("line_idx"),
            ustrip(F.col("p")[0]).alias("ts_text"),
            ustrip(F.col("p")[1]).alias("author"),
            ustrip(F.col("p")[2]).alias("text"),
            F.col("p")[2].contains(K.DELETED_MARK).alias("deleted"),
        )
    )


def customer_profile(df: DataFrame, customer_id=None) -> DataFrame:
    """Profile card fields.  With ``customer_id`` it is a point lookup (the
    predicate reaches the parquet scan); without, every customer's card."""
    d = df if customer_id is None else df.where(F.col("customer_id") == customer_id)
    status = col_or(d, "close_reason", "")
    return d.select(
        "customer_id",
        col_or(d, "full_name", K.UNKNOWN_NAME).alias("full_name"),
        col_or(d, "phone", "-").alias("phone"),
        F.when(F.coalesce(status, F.lit("")) != "", status)
        .otherwise(F.lit(K.PENDING_STATUS)).alias("status"),
        clean_display(col_or(d, "vehicle_model", None)).alias("model"),
        clean_display(col_or(d, "birth_date", None)).alias("birth_date"),
        clean_display(col_or(d, "occupation", None)).alias("occupation"),
        clean_display(col_or(d, "city", None)).alias("city"),
    )


def global_search(df: DataFrame, query: str | None, columns=None,
                  literal: bool = False) -> DataFrame:
    """Keep rows where any column's text (null reads 'None') contains the
    lower-cased query.  The query is a regular expression unless
    ``literal``; an empty query keeps every row.  ``columns`` narrows the
    searched columns (default: all)."""
    if not query:
        return df
    q = str(query).lower()
    cols = columns or df.columns
    texts = [F.lower(as_text(F.col(c))) for c in cols]
    hit = [t.contains(q) if literal else t.rlike(q) for t in texts]
    return df.where(reduce(lambda a, b: a | b, hit))
