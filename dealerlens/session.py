"""Session helpers: building a local session for tests/bench, the shared
checkpoint folder, and the evaluation time (`as_of`) as a Spark column."""

from __future__ import annotations

import datetime as _dt
import os
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .constants import FIXTURE_AS_OF


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "dealerlens") -> SparkSession:
    """Local session used by tests and the bench.  On a cluster, callers
    pass their own session and keep its settings."""
    master = master or os.environ.get("DEALERLENS_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on: wall-clock time is UTC-naive, and a
    checkpoint folder exists (the cluster's own if it names one)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only when the
    session names none (local tests) is a private folder created."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(intermediate tables and stream checkpoints are written there)")
        d = tempfile.mkdtemp(prefix="dealerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def as_of_value(as_of=None) -> str:
    if as_of is None:
        return FIXTURE_AS_OF
    if isinstance(as_of, _dt.datetime):
        return as_of.strftime("%Y-%m-%d %H:%M:%S")
    return str(as_of)


def as_of_col(as_of=None) -> Column:
    """Evaluation time as a TIMESTAMP_NTZ literal (wall clock, no zone)."""
    return F.lit(as_of_value(as_of)).cast("timestamp_ntz")


def as_of_sql(as_of=None) -> str:
    """The same instant as a SQL literal usable in Spark SQL and DuckDB."""
    return f"TIMESTAMP '{as_of_value(as_of)}'"
