"""Lands the events table as files, in time order or another."""

from pyspark.sql import functions as F


def land_events(spark, sf_dir: str, landing_dir: str, files: int = 6, slices=None) -> str:
    """One parquet file per time slice; ``slices`` names the slices to land
    and their order (default: all, in time order)."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / files
    for i in (slices if slices is not None else range(files)):
        start, end = lo + step * i, (hi if i == files - 1 else lo + step * (i + 1))
        cond = (F.col("ts") >= F.lit(start)) & ((F.col("ts") <= F.lit(end)) if i == files - 1
                                               else (F.col("ts") < F.lit(end)))
        e.where(cond).coalesce(1).write.mode("append").parquet(landing_dir)
    return landing_dir
