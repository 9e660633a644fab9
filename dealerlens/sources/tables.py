"""Customer table and audit log: load with a schema gate and a fallback
source, rebuild, append, read newest first, export a report."""

from __future__ import annotations

import datetime as _dt
import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..plans.reports import EXPORT_COLUMNS, project
from ..session import as_of_col, as_of_value

# FIXED VALUES: the columns a customer table must have.
REQUIRED_COLUMNS = ["customer_id", "full_name", "phone", "close_reason"]
LOG_SCHEMA = "log_ts string, user_name string, action_type string, detail string"
# CSV written and read so that cells with newlines, quotes and padding
# survive (RFC 4180 quoting).  Empty cells read back as null, as empty
# spreadsheet cells do.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def load_customers(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                   schema=None, **options) -> DataFrame:
    """Full table scan (columns are pruned later by the query that uses
    it).  File sources take ``path``; a database table comes through
    ``fmt="jdbc"`` with ``url=``, ``dbtable=`` (and ``partitionColumn=``,
    ``lowerBound=``, ``upperBound=``, ``numPartitions=`` for a parallel
    read).  CSV, JSON and JDBC sources get trimmed headers."""
    if fmt == "csv":
        # notes cells hold newlines and quotes: read them back whole
        options = {**CSV_OPTIONS, **options}
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path) if path is not None else r.load()
    if fmt not in ("csv", "json", "jdbc"):
        return df
    df = strip_headers(df)
    if schema is None and dict(df.dtypes).get("customer_id") == "string":
        # text sources carry the key as text; the tables it joins with use bigint
        df = df.withColumn("customer_id", F.col("customer_id").try_cast("bigint"))
    return df


def schema_gate(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Gate report: one row per required column (column_name, present) and
    whether the table has any row.  Reads at most one row."""
    present = set(df.columns)
    has_rows = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in present).alias("present"))
                        for c in required])
    return has_rows.select(F.explode(entries).alias("e"), "has_rows").select(
        "e.column_name", "e.present", "has_rows",
        (F.lit(all(c in present for c in required)) & F.col("has_rows")).alias("ok"))


def gate_passes(df: DataFrame, required=REQUIRED_COLUMNS) -> bool:
    """Driver-side decision of the gate (a one-row action)."""
    if any(c not in df.columns for c in required):
        return False
    return len(df.limit(1).take(1)) > 0


def _publish(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the finished folder ``fresh`` in the place of ``path``: the old
    folder steps aside by renaming, and back again if the new one can't
    follow."""
    jvm = spark.sparkContext._jvm
    new, place, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, f"{fresh}.replaced"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.exists(place)
    if held and not fs.rename(place, aside):
        raise OSError(f"{path} can't be renamed")
    if not fs.rename(new, place):
        if held:
            fs.rename(aside, place)
        raise OSError(f"{fresh} can't be renamed")
    if held:
        fs.delete(aside, True)


def rebuild_table(df: DataFrame, path: str, logs_path: str | None = None) -> None:
    """Replace the customer table; create the audit log if it is missing
    (an existing log is kept).  The new table is written beside the old one
    and read back before it takes its place, so a failing build, or one that
    reads the old table, leaves that table as it was."""
    spark = df.sparkSession
    out = strip_headers(df)
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}"
    out.write.parquet(fresh)
    if spark.read.parquet(fresh).columns != out.columns:
        raise ValueError(f"{fresh} does not read back as written")
    _publish(spark, fresh, path)
    if logs_path is not None:
        df.sparkSession.createDataFrame([], LOG_SCHEMA).write.mode("append").parquet(logs_path)


def load_with_fallback(spark: SparkSession, primary: str, fallback=None,
                       logs_path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read the primary table; if it is missing, has no readable schema or
    fails the gate, rebuild it from ``fallback`` (a DataFrame or a callable
    returning one) and read it again without re-checking.  Other read errors
    (a throttled store, a lost node) are raised: they say nothing about the
    table.  A failing rebuild is reported as a warning and leaves the primary
    untouched; without a fallback the result is an empty frame of the
    required columns."""
    try:
        df = load_customers(spark, primary, fmt)
        if gate_passes(df):
            return df
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    if fallback is None:
        return spark.createDataFrame(
            [], "customer_id bigint, full_name string, phone string, close_reason string")
    try:
        src = fallback() if callable(fallback) else fallback
        rebuild_table(src, primary, logs_path)
    except Exception as e:
        warnings.warn(f"{primary} was not rebuilt: {e}", stacklevel=2)
    return load_customers(spark, primary, fmt)


def audit_append(rows: DataFrame, logs_path: str) -> bool:
    """Append audit rows (log_ts, user_name, action_type, detail); errors
    are swallowed and reported as False."""
    try:
        rows.select("log_ts", "user_name", "action_type", "detail").write.mode("append").parquet(logs_path)
        return True
    except Exception:
        return False


def audit_log(spark: SparkSession, logs_path: str | None = None, logs: DataFrame | None = None) -> DataFrame:
    """The audit log newest first (text order of 'yyyy-MM-dd HH:mm:ss');
    an unreadable log is an empty 4-column frame."""
    try:
        df = logs if logs is not None else spark.read.parquet(logs_path)
        df = df.select("log_ts", "user_name", "action_type", "detail")
    except Exception:
        df = spark.createDataFrame([], LOG_SCHEMA)
    # the text columns break ties, so a burst of rows within one second can
    # still be range-split across tasks
    return df.orderBy(F.col("log_ts").desc(), "user_name", "action_type", "detail")


def export_name(report: str, as_of=None) -> str:
    """File stem of an export: '<Stem>_dd_MM_yyyy'."""
    stem = K.EXPORT_STEMS.get(report, K.EXPORT_STEMS["general"])
    day = _dt.datetime.strptime(as_of_value(as_of)[:10], "%Y-%m-%d")
    return f"{stem}_{day:%d_%m_%Y}"


def report_export(df: DataFrame, report: str, out_dir: str, user: str = K.UNKNOWN_USER,
                  as_of=None, fmt: str = "csv", logs_path: str | None = None) -> str:
    """Write the report's export columns that exist (all columns when none
    do) to ``out_dir/<file stem>``, append an audit row, and return the
    path written."""
    spark = df.sparkSession
    cols = EXPORT_COLUMNS.get(report, EXPORT_COLUMNS["general"])
    stem = export_name(report, as_of)
    path = f"{out_dir.rstrip('/')}/{stem}"
    w = project(df, cols).write.mode("overwrite")
    (w.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    if logs_path is not None:
        if report == "logs":
            action, detail = K.AUDIT_LOG_EXPORT[0], F.lit(K.AUDIT_LOG_EXPORT[1])
        else:
            action = K.AUDIT_EXPORT[0]
            a, b = K.AUDIT_EXPORT[1].split("{}")
            detail = F.lit(a + stem + ".xlsx" + b)
        audit_append(spark.range(1).select(
            F.date_format(as_of_col(as_of), K.LOG_TS_FORMAT).alias("log_ts"),
            F.lit(user).alias("user_name"), F.lit(action).alias("action_type"),
            detail.alias("detail")), logs_path)
    return path
