"""Landed files as a stream, keyed state with event-time timers, and a file
sink whose parts are results and side outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Lists and timers need this state store; what the watermark ends goes with
#: the next batch that has rows.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def events_stream(spark: SparkSession, sf_dir: str, landing_dir: str | None = None,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Events as a file stream: the ``events.parquet`` table of ``sf_dir`` (a
    file or a folder), or every parquet file arriving in ``landing_dir``.
    ``files_per_trigger`` bounds the files of a micro-batch; unset, one batch
    takes all that has landed."""
    table = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(table).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if landing_dir is not None:
        df = r.option("pathGlobFilter", "*.parquet").parquet(landing_dir)
    elif is_folder(spark, table):
        df = r.parquet(table)
    else:
        df = r.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def keyed_state(rows: DataFrame, by: Sequence[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` over the rows of each key, with event-time timers."""
    return rows.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def run_to_end(out: DataFrame, base: str) -> None:
    """Run a stream with a column ``part`` to the end of the landed data; rows
    go below ``base``/rows, a folder per part.  A batch's files count once its
    commit is in the sink's log, so a batch that runs again adds nothing."""
    spark = out.sparkSession
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        (out.writeStream.format("parquet").partitionBy("part").outputMode("append")
         .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_of(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """(key, value) rows of a state variable after the last finished batch, a
    row per element of a list; None before the first batch."""
    if not exists(spark, f"{base}/checkpoint/commits"):
        return None
    return (spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "true")
            .load(f"{base}/checkpoint"))


def sink_part(spark: SparkSession, base: str, schema: str, part: str) -> DataFrame:
    """Rows of one part of the sink (none before the first batch)."""
    if not exists(spark, f"{base}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/rows").where(F.col("part") == part)
