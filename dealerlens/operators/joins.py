"""Lookups re-expressed as joins: city coordinates, the birthday calendar,
due reminders and the poll-tick interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import as_text, col_or, geo_jitter, map_hover, normalize_city
from ..session import as_of_col
from .segments import reminder_due_ts


def cities(spark: SparkSession) -> DataFrame:
    """The fixed 10-row city dimension (city_key, lat, lon)."""
    return spark.createDataFrame(K.CITIES, "city_key string, lat double, lon double")


def mappable_customers(df: DataFrame) -> DataFrame:
    """Customers with a usable city text and its normalised key (no city
    column -> no rows, as the map page shows none)."""
    if "city" not in df.columns:
        df = df.withColumn("city", F.lit(None).cast("string"))
    c = F.col("city")
    return (df.where(c.isNotNull() & (c != "") & (c != "-"))
            .withColumn("city_key", normalize_city(c)))


def customer_geo(df: DataFrame, city_dim: DataFrame | None = None) -> DataFrame:
    """Inner lookup city -> coordinates; unknown cities drop out.  The
    built-in dimension has 10 rows, so it is broadcast: the customer side is
    never shuffled, however skewed its cities are.  A caller's dimension is
    joined as Spark sees fit."""
    if "city" not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "customer_id bigint, full_name string, vehicle_model string, city string, "
                "city_key string, lat double, lon double")
    city_dim = city_dim if city_dim is not None else F.broadcast(cities(df.sparkSession))
    m = mappable_customers(df)
    return (m.join(city_dim, "city_key", "inner")
            .select("customer_id", "full_name", col_or(m, "vehicle_model").alias("vehicle_model"),
                    "city", "city_key", "lat", "lon"))


def jittered(geo: DataFrame) -> DataFrame:
    """Map points spread by a deterministic per-customer offset."""
    return geo.select(
        "customer_id",
        (F.col("lat") + geo_jitter(F.col("customer_id"), "lat")).alias("lat"),
        (F.col("lon") + geo_jitter(F.col("customer_id"), "lon")).alias("lon"),
        map_hover(F.col("full_name"), F.col("vehicle_model"), F.col("city")).alias("hover"),
    )


def map_layers(geo: DataFrame, stations: DataFrame) -> DataFrame:
    """Customer points and charging stations as one overlay table."""
    cust = jittered(geo).select(F.lit("customers").alias("layer"), "lat", "lon",
                                F.col("hover").alias("label"))
    st = stations.select(F.lit("stations").alias("layer"), "lat", "lon",
                         F.concat(F.lit("⚡ "), F.col("station_name")).alias("label"))
    return cust.unionByName(st)


def month_calendar(spark: SparkSession, as_of=None) -> DataFrame:
    """Days of as_of's month with their Mon-first week row and weekday
    column (week, weekday, day); at most 31 rows."""
    now = as_of_col(as_of)
    first = F.trunc(now.cast("date"), "month")
    one = spark.range(1).select(first.alias("first"),
                                F.dayofmonth(F.last_day(now.cast("date"))).alias("ndays"))
    first_wd = (F.dayofweek("first") + 5) % 7  # Monday = 0
    return one.select(
        F.explode(F.sequence(F.lit(1), F.col("ndays"))).alias("day"), first_wd.alias("wd0")
    ).select(
        ((F.col("day") - 1 + F.col("wd0")) / 7).cast("int").alias("week"),
        ((F.col("day") - 1 + F.col("wd0")) % 7).cast("int").alias("weekday"),
        F.col("day").cast("int").alias("day"),
    )


def birthday_calendar(df: DataFrame, as_of=None) -> DataFrame:
    """Month grid in long form: one row per (day, customer born that day),
    plus one row with null customer for an empty day.  Born on Feb 29 and
    this February has 28 days -> not shown.

    The calendar has at most 31 rows, so it is broadcast to the births
    (no shuffle of the customer side); empty days come from an anti join
    against the distinct birth days (at most 31 rows after aggregation)."""
    from .segments import birthdays_month
    cal = month_calendar(df.sparkSession, as_of)
    name = col_or(df, "full_name", K.UNKNOWN_NAME)
    births = birthdays_month(df.withColumn("full_name", name), as_of).select(
        F.col("birth_day").alias("day"), "customer_id", "full_name")
    filled = births.join(F.broadcast(cal), "day", "inner")
    # distinct birth days of one month: at most 31 rows, safe to broadcast
    empty = (cal.join(F.broadcast(births.select("day").distinct()), "day", "left_anti")
             .select("day", F.lit(None).cast("bigint").alias("customer_id"),
                     F.lit(None).cast("string").alias("full_name"), "week", "weekday"))
    return filled.select("week", "weekday", "day", "customer_id", "full_name").unionByName(
        empty.select("week", "weekday", "day", "customer_id", "full_name"))


def reminder_due(df: DataFrame, as_of=None, user: str | None = None) -> DataFrame:
    """Reminders whose due time lies in [as_of - 7200 s, as_of + 300 s]
    (the poll's window), optionally for one operator (exact match, as the
    SQL filter does)."""
    r = F.col("reminder_at")
    d = df.where(F.col("operator").isNotNull() & r.isNotNull() & (r != ""))
    if user is not None:
        d = d.where(F.col("operator") == user)
    now = as_of_col(as_of)
    return (
        d.withColumn("due_ts", F.col("reminder_ts") if "reminder_ts" in d.columns else reminder_due_ts(d))
        .where(F.col("due_ts").between(now - F.expr(f"INTERVAL {K.REMINDER_LATE_S} SECONDS"),
                                       now + F.expr(f"INTERVAL {K.REMINDER_EARLY_S} SECONDS")))
        .select("operator", "customer_id", as_text(col_or(d, "full_name", K.UNKNOWN_CUSTOMER)).alias("full_name"),
                "phone", "due_ts")
    )


def reminder_pending(due: DataFrame, notified: DataFrame) -> DataFrame:
    """Due reminders not notified yet (anti join on the customer key)."""
    return due.join(notified.select("customer_id").distinct(), "customer_id", "left_anti")


def due_reminder_first(pending: DataFrame) -> DataFrame:
    """One alert per operator and poll: the earliest due (ties by id).  A
    min aggregate per operator, map-side combined: no sort of a hot
    operator's rows."""
    first = F.min(F.struct("due_ts", "customer_id", "full_name", "phone"))
    return pending.groupBy("operator").agg(first.alias("f")).select(
        "operator", "f.customer_id", "f.full_name", "f.phone", "f.due_ts")


# Width of the time buckets of the tick/reminder interval join: the whole
# alert window, so a reminder's window covers its own bucket's end or the next
# one's beginning, never a bucket's middle only.
BUCKET_S = K.REMINDER_LATE_S + K.REMINDER_EARLY_S


def _bucket(ts, before_s: int = 0):
    """Number of the bucket that holds the time ``before_s`` before ``ts``."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) - before_s * 1_000_000) / (BUCKET_S * 1_000_000))


def reminders_alerted(ticks: DataFrame, reminders: DataFrame) -> DataFrame:
    """Batch form of the reminder alert stream: each reminder that some poll
    tick of its operator saw inside the alert window, once.

    A reminder's window is as wide as a bucket and starts inside one bucket
    ``b``: some tick of ``b`` lies in it when the latest tick of ``b`` is not
    before its start, and some tick of ``b + 1`` when the earliest one is not
    after its end.  So ticks shrink to their extremes per (operator, bucket),
    combined map-side, and an equi join decides: no range condition, no hot
    operator in one task."""
    early = F.expr(f"INTERVAL {K.REMINDER_EARLY_S} SECONDS")
    late = F.expr(f"INTERVAL {K.REMINDER_LATE_S} SECONDS")
    extremes = (ticks.groupBy(F.col("operator").alias("_op"), _bucket(F.col("tick_ts")).alias("_b"))
                .agg(F.min("tick_ts").alias("_first"), F.max("tick_ts").alias("_last")))
    none = F.lit(None).cast(ticks.schema["tick_ts"].dataType)
    # one row per side: own bucket's last tick, next bucket's first tick
    own = extremes.select("_op", "_b", F.col("_last").alias("_own"), none.alias("_next"))
    nxt = extremes.select("_op", (F.col("_b") - 1).alias("_b"), none, "_first")
    sides = own.union(nxt).groupBy("_op", "_b").agg(F.max("_own").alias("_own"), F.max("_next").alias("_next"))
    r = reminders.withColumn("_rb", _bucket(F.col("due_ts"), K.REMINDER_EARLY_S))
    j = r.join(sides, (r["operator"] == sides["_op"]) & (r["_rb"] == sides["_b"]))
    seen = (F.col("_own") >= F.col("due_ts") - early) | (F.col("_next") <= F.col("due_ts") + late)
    return j.where(seen).select("operator", "reminder_id", "due_ts")
