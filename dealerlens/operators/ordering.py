"""Paging of a sorted table, by offset or over a stored sorted copy."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

SLICE = "slice"


def page(df: DataFrame, n: int, size: int = K.PAGE_SIZE, order_by=None) -> DataFrame:
    """Page ``n`` (0-based) of ``size`` rows after sorting by ``order_by``
    (a total order; ties are broken by every listed column).  Spark runs
    this as a top-(n+1)*size per task followed by one small merge, not a
    full sort."""
    order_by = order_by or [df.columns[0]]
    return df.orderBy(*order_by).offset(n * size).limit(size)


def store_sorted(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Store ``df`` for ``stored_page``: range-partitioned and sorted by the
    columns ``order_by`` (a total order), each range a directory of its own.
    Beside the rows stand the number of rows of every range, the order and the
    schema, in one row."""
    path = path.rstrip("/")
    (df.repartitionByRange(*order_by).withColumn(SLICE, F.spark_partition_id())
     .sortWithinPartitions(SLICE, *order_by).write.partitionBy(SLICE).parquet(f"{path}/rows"))
    schema = T.StructType([*df.schema, T.StructField(SLICE, T.IntegerType())])
    # counted on what was written, from the files' footers; one entry per range
    counts = df.sparkSession.read.schema(schema).parquet(f"{path}/rows").groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    (counts.agg(F.sort_array(F.collect_list(F.struct(SLICE, "n"))).alias("slices"))
     .select("slices", F.array(*[F.lit(c) for c in order_by]).alias("order_by"), F.lit(schema.json()).alias("schema"))
     .write.parquet(f"{path}/about"))


def stored_page(spark: SparkSession, path: str, n: int, size: int = K.PAGE_SIZE) -> DataFrame:
    """Page ``n`` (0-based) of a table that ``store_sorted`` wrote: what
    ``page`` returns, from the one or few ranges that hold the page's rows
    instead of a sort of all earlier ones.  A page past the end is empty."""
    path = path.rstrip("/")
    about = spark.read.parquet(f"{path}/about").first()
    first, before, skip, held = n * size, 0, 0, []
    for s in about["slices"]:
        if before < first + size and before + s["n"] > first:
            if not held:
                skip = first - before
            held.append(s[SLICE])
        before += s["n"]
    rows = spark.read.schema(T.StructType.fromJson(json.loads(about["schema"]))).parquet(f"{path}/rows")
    near = rows.where(F.col(SLICE).isin(held)).drop(SLICE)
    return near.orderBy(*about["order_by"]).offset(skip).limit(size)
