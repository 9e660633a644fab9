"""Audit log with exactly-once appends: month directories, and within a month
one directory per batch, its rows sorted by time.

A batch writes its rows under its own id by dynamic partition overwrite, so a
replay of the batch (same id, same rows) replaces what it wrote before and adds
nothing.  Reading from a time on takes the months from the directory names and
the row groups within them by the statistics of ``log_ts``.  A directory a day
was tried: a commit moves directories one by one, and a log of seven years then
took two minutes to land.  Rows without a time stand in a directory of their
own and come last.  The log of ``tables.audit_append`` has no months: copy it
once with ``append_once(audit_log(...), path, "old")``."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import LOG_SCHEMA, audit_log

MONTH, BATCH = "log_month", "batch"
_COLUMNS = ["log_ts", "user_name", "action_type", "detail"]


def append_once(rows: DataFrame, path: str, batch_id: str) -> None:
    """Append the rows (log_ts, user_name, action_type, detail) of a batch."""
    if not batch_id:
        raise ValueError("a batch needs an id")
    out = rows.select(*_COLUMNS, F.substring("log_ts", 1, 7).alias(MONTH), F.lit(batch_id).alias(BATCH))
    # rows near in time meet in one file, those of one second in several if they are very many
    (out.repartitionByRange("log_ts", F.xxhash64(*_COLUMNS)).sortWithinPartitions(MONTH, BATCH, "log_ts").write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH, BATCH).parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{LOG_SCHEMA}, {MONTH} string, {BATCH} string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise


def last_day(spark: SparkSession, path: str) -> str | None:
    """The newest day that has rows ('yyyy-MM-dd'), None for a log without
    any: one column of the newest month is read, found in the directory
    names."""
    log = _stored(spark, path)
    if log is None:
        return None
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    months = [unquote(n[len(MONTH) + 1:]) for n in (f.getPath().getName() for f in listed) if n.startswith(f"{MONTH}=")]
    months = [m for m in months if m != "__HIVE_DEFAULT_PARTITION__"]
    if not months:
        return None
    return log.where(F.col(MONTH) == max(months)).agg(F.max(F.substring("log_ts", 1, 10)).alias("day")).first()["day"]


def newest(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The log newest first; with ``since`` (a day or a time, as text) only
    rows from then on.  A log that doesn't exist is empty."""
    log = _stored(spark, path)
    if log is not None and since is not None:
        log = log.where((F.col(MONTH) >= since[:7]) & (F.col("log_ts") >= since))
    return audit_log(spark, logs=log if log is not None else spark.createDataFrame([], LOG_SCHEMA))
