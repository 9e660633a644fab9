"""Adapter from the shared test tables (TPC-H-like star schema plus
``events`` and ``conversations``) to the inputs the dashboard works on.

Every derived frame is a lazy plan over the parquet tables, so its size
grows with them.  The customer table is built with three left joins, all on
the customer key: Spark plans them over one hash partitioning of that key
(or broadcasts a side AQE measured as small), and Catalyst drops a join
whose columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import as_of_col

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key, cases, default=None):
    """CASE key WHEN i THEN cases[i] ... END (cases are Columns or values)."""
    expr = None
    for i, v in enumerate(cases):
        v = v if hasattr(v, "alias") else F.lit(v)
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One encoded notes text per conversation: 'dd.MM.yyyy HH:mm | role |
    text' lines in turn order, joined by newlines."""
    conv = read_table(spark, sf_dir, "conversations")
    ts = F.expr("timestamp_ntz'2001-06-01 09:00:00' + "
                "make_dt_interval(cast(conv_id % 60 as int), cast(turn as int), 0, 0)")
    line = F.concat(F.date_format(ts, K.NOTE_TS_FORMAT), F.lit(" | "), F.col("role"),
                    F.lit(" | "), F.translate(F.col("text"), "\n|", " /"))
    return (
        conv.select("conv_id", F.struct(F.col("turn"), line.alias("line")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["line"]),
                          "\n").alias("notes"))
    )


def materialize_customers(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Store the customer table as parquet (the dashboard's system of record)
    and return it as read back, with the typed columns of ``with_typed``
    beside the texts.  Rows are sorted by key within each file, so row-group
    statistics serve point lookups by customer_id."""
    typed = with_typed(customers(spark, sf_dir))
    typed.sortWithinPartitions("customer_id").write.mode("overwrite").parquet(path)
    return spark.read.schema(typed.schema).parquet(path)


def with_typed(df: DataFrame) -> DataFrame:
    """Adds what the selective filters otherwise parse from text in every
    query: month and day of birth and the reminder's time.  Filters use these
    columns when a table has them, so that they reach the scan."""
    from ..functions import parse_ts
    from ..operators.segments import reminder_due_ts
    born = parse_ts(F.col("birth_date"))
    return (df.withColumn("birth_month", F.month(born)).withColumn("birth_day_of_month", F.dayofmonth(born))
            .withColumn("reminder_ts", reminder_due_ts(df)))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table (all text except the key), FIXTURES.md §3.1."""
    cust = read_table(spark, sf_dir, "customer")
    # p_partkey is part's key; grouping on it states that to the optimizer,
    # so queries that use no part column drop this join, and the grouping's
    # hash partitioning is the one the join needs anyway (no extra exchange).
    part = (read_table(spark, sf_dir, "part").groupBy("p_partkey")
            .agg(F.max("p_type").alias("p_type"), F.max("p_brand").alias("p_brand"),
                 F.max("p_size").alias("p_size")))
    last = (
        read_table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.max("o_orderdate").alias("last_orderdate"),
             # only the priority's digit counts; a number keeps the hash aggregate
             F.max_by(F.substring("o_orderpriority", 1, 1).cast("tinyint"), "o_orderkey").alias("pr"))
    )
    notes = conversation_notes(spark, sf_dir)
    j = (
        cust.join(part, cust.c_custkey == part.p_partkey, "left")
        .join(last, cust.c_custkey == last.o_custkey, "left")
        .join(notes, cust.c_custkey == notes.conv_id, "left")
    )
    k = F.col("c_custkey")
    p7 = F.lpad(k.cast("string"), 7, "0")
    pr = F.col("pr")
    # every tenth customer's falls in the two hours before the evaluation time
    reminder_ts = F.when(k % 10 == 0, as_of_col() - F.expr("make_dt_interval(0, 0, cast(c_custkey % 120 as int), 0)")) \
        .otherwise(F.expr("timestamp_ntz'2001-08-01 00:00:00' + make_dt_interval(0, cast(c_custkey % 48 as int), 0, 0)"))
    birth = F.date_add(F.lit("1960-02-01").cast("date"), ((k * 37) % 15000).cast("int"))
    return j.select(
        k.alias("customer_id"),
        F.col("c_name").alias("full_name"),
        _pick(k % 6, [F.concat(F.lit("+90 532 "), p7), F.concat(F.lit("532"), p7),
                      F.concat(F.lit("0532"), p7), "12345", ""]).alias("phone"),
        F.when(pr == 5, F.lit("Bilgi Verildi"))
        .when(pr == 4, F.lit(None).cast("string"))
        .when(pr == 3, F.lit(""))
        .when(pr == 2, F.lit("Olumlu"))
        .otherwise(F.lit("Kararsız")).alias("close_reason"),
        _pick(k % 8, ["Evet", "Evet", " YES ", "1", "Hayır", "HAYIR", ""]).alias("called_flag"),
        F.when(k % 10 == 9, F.lit(None).cast("string"))
        .when(k % 10 == 8, F.concat(F.lit(" Supplier#"), F.lpad((k % 3).cast("string"), 9, "0"), F.lit(" ")))
        .otherwise(F.concat(F.lit("Supplier#"), F.lpad((k % 4).cast("string"), 9, "0"))).alias("operator"),
        F.date_format("last_orderdate", "yyyy-MM-dd").alias("action_date"),
        _pick(k % 5, [F.date_format(reminder_ts, "yyyy-MM-dd'T'HH:mm"), "", "nan", "bad"]).alias("reminder_at"),
        F.col("notes"),
        F.when(k % 17 == 0, F.lit("n/a"))
        .otherwise(F.floor(F.col("c_acctbal") * 20).cast("bigint").cast("string")).alias("odometer_km"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .otherwise((F.lit(2001) - F.col("p_size") % 12).cast("string")).alias("model_year"),
        _pick(k % 9, ["Yapıldı", " YAPILDI ", "Bekliyor"]).alias("test_drive_status"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.date_format(birth, "yyyy-MM-dd")).alias("birth_date"),
        F.when(k % 11 == 0, F.lit("-")).when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_type")).alias("vehicle_model"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("interested_vehicle"),
        F.col("c_mktsegment").alias("contact_channel"),
        _pick(F.col("c_nationkey") % 8, ["İstanbul", "ankara", " İZMİR ", "Mersin", "Bursa", "-", "Konya"]).alias("city"),
    )


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff roster (name, role) derived from ``supplier``: every 25th
    supplier is an admin, the rest are sales people."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_name").alias("staff_name"),
        F.when(F.col("s_suppkey") % 25 == 24, F.lit("admin")).otherwise(F.lit("sales")).alias("role"),
    )


def outcome_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call outcomes saved by sales people: one per order (patch_ts, seq,
    customer_id, user_name, reason, reminder, note)."""
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(9), (ok % 480).cast("int"), F.lit(0))
    rem_ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(2), F.lit(10), F.lit(0), F.lit(0))
    return (
        o.select(
            ts.alias("patch_ts"),
            ok.alias("seq"),
            F.col("o_custkey").alias("customer_id"),
            F.concat(F.lit("Supplier#"), F.lpad((ok % 4).cast("string"), 9, "0")).alias("user_name"),
            F.when(F.col("o_orderstatus") == "F", F.lit("Olumlu"))
            .when(F.col("o_orderstatus") == "O", F.lit("Kararsız")).alias("reason"),
            F.when(ok % 3 == 1, F.lit(""))
            .when(ok % 3 == 2, F.date_format(rem_ts, "yyyy-MM-dd'T'HH:mm")).alias("reminder"),
            F.when(ok % 2 == 0, F.col("o_orderpriority")).alias("note"),
        )
    )


def admin_patches(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """Admin edits: every BUILDING-segment customer gets a new name, phone
    (null when the balance is negative), reason and sometimes a note."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.where(F.col("c_mktsegment") == "BUILDING").select(
        as_of_col(as_of).alias("patch_ts"),
        k.alias("seq"),
        k.alias("customer_id"),
        F.lit("Admin").alias("user_name"),
        F.upper(F.col("c_name")).alias("full_name"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("0532 "), F.lpad(k.cast("string"), 7, "0"))).alias("phone"),
        F.when(F.col("c_acctbal") > 5000, F.lit("Olumlu")).otherwise(F.lit("")).alias("close_reason"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("Bilgiler güncellendi")).alias("note"),
    )


def note_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delete request per customer with notes: line index conv_id % 4
    (some land past the end, some on lines without separators)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return conv.select(F.col("conv_id").alias("customer_id"),
                       (F.col("conv_id") % 4).cast("int").alias("line_idx"))


def system_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log rows from ``events`` (all text, as stored)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", K.LOG_TS_FORMAT).alias("log_ts"),
        F.col("user_id").cast("string").alias("user_name"),
        F.col("event_type").alias("action_type"),
        F.col("props").alias("detail"),
    )


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login attempts: 'error' events are failures, 'signup' successes."""
    e = read_table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("error", "signup")).select(
        F.col("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").cast("string").alias("user_name"),
        (F.col("event_type") == "signup").alias("success"),
    )


def poll_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminder poll ticks: every event is a poll by its user."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp_ntz").alias("tick_ts"),
                    F.col("user_id").cast("string").alias("operator"))


def stream_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders set by users: each 'signup' event sets one due an hour
    later."""
    e = read_table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("reminder_id"),
        F.col("user_id").cast("string").alias("operator"),
        (F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")).alias("due_ts"),
    )


STATION_JSON_SCHEMA = ("struct<elements:array<struct<lat:double,lon:double,"
                       "tags:map<string,string>>>>")


# Fetches of the landed station feed: snapshot id -> minutes after as_of.
# 0..2 hold the suppliers, 3 came back empty, 4 holds only places outside the
# box, 5 lacks a coordinate.
FETCH_MINUTES = {0: -10, 1: -20, 2: -30, 3: -5, 4: 40, 5: 120}


def station_documents(spark: SparkSession, sf_dir: str, as_of=None, page_size: int = 50) -> DataFrame:
    """Landed station feed: the fetches of ``FETCH_MINUTES``, each as JSON
    pages of at most ``page_size`` elements (snapshot_id, page, fetched_at,
    json).  Every supplier is in one of fetches 0 to 2, by its nation; every
    tenth is in fetch 4 too, far south; fetch 5 has those without latitude."""
    s = read_table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    amenity = F.when(sk % 5 == 0, F.lit("fuel")).otherwise(F.lit(K.STATION_AMENITY))
    m = sk % 4
    tags = (
        F.when(m == 0, F.create_map(F.lit("amenity"), amenity, F.lit("operator"), F.col("s_name"),
                                    F.lit("brand"), F.concat(F.lit("BRAND-"), F.col("s_nationkey").cast("string")),
                                    F.lit("name"), F.concat(F.lit("st-"), sk.cast("string"))))
        .when(m == 1, F.create_map(F.lit("amenity"), amenity, F.lit("brand"), F.lit(""),
                                   F.lit("name"), F.concat(F.lit("st-"), sk.cast("string"))))
        .when(m == 2, F.create_map(F.lit("amenity"), amenity, F.lit("name"),
                                   F.concat(F.lit("istasyon "), sk.cast("string"))))
        .otherwise(F.create_map(F.lit("amenity"), amenity))
    )
    tenth = F.when(sk % 10 == 0, F.array(F.lit(4), F.lit(5))).otherwise(F.array().cast("array<int>"))
    sid = F.col("snapshot_id")
    placed = s.withColumn("snapshot_id", F.explode(F.concat(
        F.array((F.col("s_nationkey") % 3).cast("int")), tenth)))
    lat = F.when(sid == 4, F.lit(10.0)).when(sid < 4, (F.lit(35.0) + (sk % 9)).cast("double"))
    el = F.struct(lat.alias("lat"), (F.lit(24.0) + (sk % 23)).cast("double").alias("lon"), tags.alias("tags"))
    minutes = F.create_map(*[F.lit(x) for kv in FETCH_MINUTES.items() for x in kv])
    pages = (placed.groupBy("snapshot_id", F.floor(sk / page_size).alias("page"))
             .agg(F.collect_list(el).alias("elements"))
             .select("snapshot_id", "page", F.to_json(F.struct("elements")).alias("json")))
    empty = spark.range(1).select(F.lit(3).alias("snapshot_id"), F.lit(0).cast("long").alias("page"),
                                  F.lit('{"elements":[]}').alias("json"))
    return pages.unionByName(empty).select(
        "snapshot_id", "page",
        (as_of_col(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), minutes[sid], F.lit(0))).alias("fetched_at"), "json")
