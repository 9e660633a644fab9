"""Customer table in key ranges, so that a change rewrites only the ranges it
touches and a lookup reads only the range it needs.

A range holds ``width`` consecutive keys and is one partition directory of a
Parquet table; its rows are sorted by key and its files carry a bloom filter on
the key.  Customers without a key are a range of their own.  Beside the rows,
``about`` keeps the width and the schema, so a reader can't take another width
than the writer.

``change`` runs a table update (``operators.mutations``) on the touched ranges
and puts them in place by dynamic partition overwrite: tasks write aside, the
commit moves finished directories, and files of other ranges stay as they are.
Frames read before a change name replaced files: take ``rows`` anew after it.
The commit moves one directory after another, so after a driver lost within a
commit the batch must not be replayed blindly."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "customer_id"
RANGE = "key_range"
#: Keys of a range: about a gigabyte of customers at a kilobyte each.
WIDTH = 1_000_000


def _range(width: int) -> Column:
    return F.expr(f"{KEY} div {width}")


class KeyedTable:
    """A stored table in key ranges; ``store`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.width = about["width"]
        self.schema = T.StructType.fromJson(json.loads(about["schema"]))

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField(RANGE, T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """The whole table as it is now."""
        return self._stored().drop(RANGE)

    def at(self, customer_id: int) -> DataFrame:
        """The rows of one key: one range is read, its row groups chosen by
        their statistics and bloom filters."""
        part = abs(customer_id) // self.width * (-1 if customer_id < 0 else 1)
        return self._stored().where((F.col(RANGE) == part) & (F.col(KEY) == customer_id)).drop(RANGE)

    def touching(self, patches: DataFrame) -> DataFrame:
        """The rows of the ranges that hold a key of ``patches``."""
        # at most one number per partition directory, which the driver lists anyway
        hit = patches.where(F.col(KEY).isNotNull()).select(_range(self.width).alias("r")).distinct().collect()
        return self._stored().where(F.col(RANGE).isin([r["r"] for r in hit])).drop(RANGE)

    def change(self, update: Callable[[DataFrame, DataFrame], DataFrame], patches: DataFrame) -> DataFrame:
        """Apply ``update(rows, patches)``, which keeps every row and key, to
        the touched ranges; the table after it.  Patches of unknown keys and
        of no key change nothing."""
        after = update(self.touching(patches), patches)
        if after.schema.names != self.schema.names:
            raise ValueError("an update keeps the table's columns")
        _write(after, self.path, self.width, mode="overwrite")
        return self.rows()


def _write(df: DataFrame, path: str, width: int, mode: str) -> None:
    out = df.withColumn(RANGE, _range(width))
    # the hash splits a key of very many rows, and the keyless rows, over tasks
    spread = F.xxhash64(*df.columns)
    (out.repartitionByRange(RANGE, KEY, spread).sortWithinPartitions(RANGE, KEY)
     .write.mode(mode).partitionBy(RANGE).option("partitionOverwriteMode", "dynamic")
     .option(f"parquet.bloom.filter.enabled#{KEY}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{KEY}", str(width)).parquet(f"{path}/rows"))


def store(df: DataFrame, path: str, width: int = WIDTH) -> KeyedTable:
    """Write ``df`` as a new table in ranges of ``width`` keys; a folder that
    exists is an error."""
    if width < 1:
        raise ValueError("a range holds at least one key")
    spark, path = df.sparkSession, path.rstrip("/")
    _write(df, path, width, mode="errorifexists")
    spark.range(1).select(F.lit(width).cast("long").alias("width"),
                          F.lit(df.schema.json()).alias("schema")).write.parquet(f"{path}/about")
    return KeyedTable(spark, path)
