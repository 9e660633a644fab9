"""Helpers shared by the corpus operators: Arrow batch size, intermediate
tables, global ranks and prefix sums without a single-task window, and
connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

#: Documents per Arrow batch.  Whole texts travel in these batches, so the
#: number bounds what a Python worker holds at once.
BATCH_ROWS = 1000

#: White space of the word contracts: space and the five controls from tab to
#: carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on."""
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks, made at its first use; what
    was kept under other names goes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Frees what this worker process keeps: it outlives the stage, and other
    operators' tasks need the memory."""
    _kept.clear()


def unlike(columns: Sequence[str], *taken: str) -> tuple[str, ...]:
    """The columns whose names, in any case, are not among ``taken``: an
    operator's own columns go before a caller's that are named alike."""
    own = {t.lower() for t in taken}
    return tuple(c for c in columns if c.lower() not in own)


def spare(columns: Sequence[str], name: str) -> str:
    """``name``, lengthened until no column of ``columns`` bears it."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back.
    Later uses read the files, so a lost executor costs no recomputation and
    non-deterministic values (partition ids) stay as written.  Inside
    ``passing`` the table goes at the end; a ``lasting`` one stays until the
    next outer ``passing`` ends, if there is one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    levels = _passing.get()[:-1] if lasting else _passing.get()
    if levels:
        levels[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For work whose result is stored as ``lasting``: the other tables that
    ``stored`` writes inside are deleted at the end, and Spark is let see that
    their shuffles are no longer in use."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        jvm = spark.sparkContext._jvm
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        jvm.System.gc()


#: Rows of a table of ids (16 bytes each) that may be broadcast; larger ones
#: meet their documents in a shuffle.
BROADCAST_IDS = 2_000_000


def without(df: DataFrame, ids: DataFrame, on: Sequence[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``df`` that the stored table ``ids`` doesn't name."""
    ids = ids.select(*on)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, list(on), how)


def within(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that the stored table ``ids`` names."""
    return without(df, ids, on, "left_semi")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_sorted(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, stored, with
    ``_pid`` (partition, increasing in the order) and ``_idx`` (position in
    the partition, from 0).  One shuffle; no task sees more than a range."""
    spark = df.sparkSession
    mid = F.monotonically_increasing_id()
    laid = (df.repartitionByRange(partitions(spark), *order)
            .sortWithinPartitions(*order)
            .withColumn("_mid", mid))
    t = stored(laid, name)
    return (t.withColumn("_pid", F.shiftright("_mid", 33).cast("int"))
            .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``rank`` (from 0, gapless) in the given order.  The broadcast side
    has one row per partition of the range shuffle."""
    t = range_sorted(df, order, name)
    per = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    off = per.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (t.join(F.broadcast(off), "_pid")
            .withColumn("rank", F.col("_off") + F.col("_idx"))
            .drop("_mid", "_pid", "_idx", "_off"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: (``id``, ``comp``), comp being
    the smallest reachable id.  Labels fall by the minimum over neighbours and
    by pointer jumping, so chains close in logarithmically many rounds; every
    round is a stored table."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), f"{name}-edges")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp"))
                   .withColumnRenamed("a", "id"), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = (both.join(label.withColumnRenamed("id", "b"), "b")
                .groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id"))
        low = label.join(near, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = stored(low.join(jump, "low", "left")
                     .select("id", F.col("comp").alias("old"),
                             F.least("low", F.coalesce("far", "low")).alias("comp")), f"{name}-{k}")
        moved = new.where("comp <> old").limit(1).count()
        label = new.select("id", "comp")
        if not moved:
            return label
