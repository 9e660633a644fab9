"""Registry of named queries: each operator of the inventory as a Spark
plan over the fixture tables, next to its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import (clean_display, customer_tooltip, format_phone, format_reminder,
                         goal_met, goal_progress, is_meaningful, last_note_ts, log_tooltip,
                         map_hover, norm_token, normalize_city, note_line, parse_ts, to_number,
                         ustrip, warranty_label, warranty_status)
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import mutations as M
from ..operators import notes as N
from ..operators import search_index as SI
from ..operators import segments as S
from ..session import as_of_col, prepare, scratch_path
from ..sources import audit as AU
from ..sources import fixtures as fx
from ..sources import ranges as KR
from ..sources import stations as ST
from ..sources import tables as T
from . import oracle as O
from .reports import REPORT_COLUMNS, report

QUERIES: dict = {}
ORACLE: dict = {}
# each query's SQL before its tables are put in front, for a second form of it
ORACLE_BODY: dict = {}
ORACLE_NEEDS: dict = {}

C = "customers"
NOT_DONE = O.in_list(K.FLAG_NOT_DONE)
DONE = O.in_list(K.FLAG_DONE)
CY = f"year({O.AS_OF})"


def q(name: str, sql: str | None = None, needs=(C,)):
    """Register a Spark query (decorated function) and its oracle SQL."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = O.sql(sql, needs)
            ORACLE_BODY[name], ORACLE_NEEDS[name] = sql, needs
        return run
    return deco


def cust(spark, sf):
    return fx.customers(spark, sf)


#: Keys of a range in the registered queries, whose tables are small.
QUERY_WIDTH = 500


def keyed(spark, sf):
    """The customer table stored in key ranges."""
    return KR.store(cust(spark, sf), scratch_path(spark, "customers"), QUERY_WIDTH)


# ---------------------------------------------------------------- SQL bits
def s_trade():
    return f"{O.to_number('odometer_km', '0')} > {K.TRADE_IN_KM} AND {O.norm_token('called_flag')} IN {NOT_DONE}"


def s_warranty():
    return (f"{O.to_number('model_year', CY)} <= {CY} - {K.WARRANTY_SEGMENT_AGE} "
            f"AND {O.norm_token('called_flag')} IN {NOT_DONE}")


def s_processed():
    return f"({O.norm_token('called_flag')} IN {DONE} OR {O.strip('coalesce(notes, ' + chr(39) + chr(39) + ')')} <> '')"


def s_warranty_label(x="model_year"):
    y = O.to_number(x)
    r = f"({y} + {K.WARRANTY_YEARS} - {CY})"
    return (f"CASE WHEN {y} IS NULL THEN '-' WHEN {r} > 0 THEN CAST(CAST(trunc({r}) AS BIGINT) AS VARCHAR) || ' {K.WARRANTY_YEARS_LEFT}' "
            f"WHEN {r} = 0 THEN '{K.WARRANTY_ENDS_THIS_YEAR}' ELSE '{K.WARRANTY_EXPIRED}' END")


def s_reminder_ts(x="reminder_at"):
    return O.parse_ts(f"replace({x}, 'T', ' ')")


def s_clean(x):
    d = O.strip(O.as_text(x))
    return (f"CASE WHEN contains({d}, '00:00:00') THEN split_part({d}, ' ', 1) "
            f"WHEN {d} = '' OR lower({d}) IN ('none', 'nan', 'nat') THEN '-' ELSE {d} END")


def s_report(report_name: str, where: str, extra: dict | None = None, source: str = "customers") -> str:
    """Projection of a report with formatted dates over a filtered source."""
    extra = extra or {}
    cols = []
    for c in REPORT_COLUMNS[report_name]:
        if c in extra:
            cols.append(f"{extra[c]} AS {c}")
        elif c in ("action_date", "birth_date"):
            cols.append(f"{O.format_date(c)} AS {c}")
        else:
            cols.append(c)
    return f"SELECT {', '.join(cols)} FROM {source} WHERE {where}"


# ================================================================ 2.1 sources
@q("load_customers", "SELECT * FROM customers")
def _load_customers(spark, sf):
    """Full scan of the stored customer table."""
    path = scratch_path(spark, "customers")
    cust(spark, sf).write.parquet(path)
    return T.load_customers(spark, path)


@q("schema_gate", """
SELECT t.column_name, TRUE AS present, h.has_rows, h.has_rows AS ok
FROM (VALUES ('customer_id'), ('full_name'), ('phone'), ('close_reason')) t(column_name),
     (SELECT count(*) > 0 AS has_rows FROM (SELECT 1 FROM customers LIMIT 1)) h""")
def _schema_gate(spark, sf):
    return T.schema_gate(cust(spark, sf))


@q("schema_gate_missing", """
SELECT t.column_name, t.column_name <> 'phone' AS present, h.has_rows, FALSE AS ok
FROM (VALUES ('customer_id'), ('full_name'), ('phone'), ('close_reason')) t(column_name),
     (SELECT count(*) > 0 AS has_rows FROM (SELECT 1 FROM customers LIMIT 1)) h""")
def _schema_gate_missing(spark, sf):
    """Gate on a table that lacks the phone column."""
    return T.schema_gate(cust(spark, sf).drop("phone"))


@q("load_with_fallback", "SELECT * FROM customers")
def _load_with_fallback(spark, sf):
    """Primary path missing -> rebuilt from the fixture source, re-read."""
    primary = scratch_path(spark, "customers")
    return T.load_with_fallback(spark, primary, lambda: cust(spark, sf),
                                logs_path=scratch_path(spark, "system_logs"))


@q("strip_headers", "SELECT * FROM customers")
def _strip_headers(spark, sf):
    c = cust(spark, sf)
    return T.strip_headers(c.toDF(*[f"  {x} " for x in c.columns]))


@q("rebuild_table", "SELECT * FROM customers")
def _rebuild_table(spark, sf):
    path = scratch_path(spark, "customers")
    T.rebuild_table(cust(spark, sf), path, scratch_path(spark, "system_logs"))
    return T.load_customers(spark, path)


OUTCOME_AUDIT_SQL = f"""
SELECT strftime(p.patch_ts, '%Y-%m-%d %H:%M:%S') AS log_ts, coalesce(p.user_name, 'None') AS user_name,
       '{K.AUDIT_OUTCOME[0]}' AS action_type,
       'Müşteri: ' || coalesce(c.full_name, '{K.UNKNOWN_CUSTOMER}') || ' (No: ' || CAST(p.customer_id AS VARCHAR)
       || ') paneli üzerinden güncelleme yapıldı.' AS detail
FROM outcome_patches p LEFT JOIN customers c ON p.customer_id = c.customer_id"""


@q("audit_append", OUTCOME_AUDIT_SQL, needs=(C, "outcome_patches"))
def _audit_append(spark, sf):
    """Append the audit rows of a batch of saves to a fresh log, read back."""
    path = scratch_path(spark, "system_logs")
    T.rebuild_table(spark.createDataFrame([], "customer_id bigint"), scratch_path(spark, "c"), path)
    rows = M.audit_from_patches(cust(spark, sf), outcomes=fx.outcome_patches(spark, sf))
    T.audit_append(rows, path)
    return T.audit_log(spark, path)


def _logged_once(spark, sf):
    """A log that got two batches, the second of them twice: the landed log's
    rows, then the audit rows of a batch of saves."""
    path = scratch_path(spark, "system_logs")
    rows = M.audit_from_patches(cust(spark, sf), outcomes=fx.outcome_patches(spark, sf))
    AU.append_once(fx.system_logs(spark, sf), path, "landed")
    for _ in range(2):
        AU.append_once(rows, path, "saves")
    return path


LOGGED_SQL = f"SELECT * FROM system_logs UNION ALL ({OUTCOME_AUDIT_SQL})"
LOGGED_NEEDS = ("system_logs", C, "outcome_patches")


@q("audit_append_once", LOGGED_SQL, needs=LOGGED_NEEDS)
def _audit_append_once(spark, sf):
    """The whole log, newest first, after a batch was saved twice."""
    return AU.newest(spark, _logged_once(spark, sf))


@q("audit_last_day", f"""SELECT * FROM ({LOGGED_SQL}) WHERE substr(log_ts, 1, 10) =
  (SELECT max(substr(log_ts, 1, 10)) FROM ({LOGGED_SQL}))""", needs=LOGGED_NEEDS)
def _audit_last_day(spark, sf):
    """The last day's log, read from that day on."""
    path = _logged_once(spark, sf)
    return AU.newest(spark, path, since=AU.last_day(spark, path))


@q("audit_log", "SELECT * FROM system_logs", needs=("system_logs",))
def _audit_log(spark, sf):
    return T.audit_log(spark, logs=fx.system_logs(spark, sf))


@q("station_feed", "SELECT lat, lon, station_name FROM stations", needs=("stations",))
def _station_feed(spark, sf):
    return ST.station_feed(fx.station_documents(spark, sf))


# Fetches with stations, newest first: 0, 1, 2 (10, 20, 30 minutes old).
BEST_FETCH = "SELECT min(snapshot_id) AS sid FROM stations"


@q("latest_snapshot", f"""
SELECT s.snapshot_id, {O.AS_OF} - to_minutes(CAST((s.snapshot_id + 1) * 10 AS INTEGER)) AS fetched_at, s.lat, s.lon,
       s.station_name, FALSE AS is_stale
FROM stations s JOIN ({BEST_FETCH}) b ON s.snapshot_id = b.sid""", needs=("stations",))
def _latest_snapshot(spark, sf):
    """The last good fetch is younger than an hour: kept, though a newer
    fetch came back empty."""
    return ST.latest_snapshot(fx.station_documents(spark, sf))


# Minutes after the evaluation time, and what the newest fetch is by then.
SNAPSHOT_CASES = {"fresh, newest outside the box": 45, "stale, newest outside the box": 75, "stale, newest invalid": 125}


@q("latest_snapshot_cases", f"""
SELECT t.name, CASE WHEN t.good THEN s.n ELSE 0 END AS stations, CASE WHEN t.good THEN s.sid END AS snapshot_id,
       CASE WHEN t.good THEN t.stale END AS is_stale
FROM (VALUES ('fresh, newest outside the box', TRUE, FALSE), ('stale, newest outside the box', FALSE, FALSE),
             ('stale, newest invalid', TRUE, TRUE)) t(name, good, stale),
     (SELECT count(*) AS n, min(snapshot_id) AS sid FROM stations
      WHERE snapshot_id = (SELECT sid FROM ({BEST_FETCH}))) s""", needs=("stations",))
def _latest_snapshot_cases(spark, sf):
    """What the cache shows at other times: stations, fetch and staleness."""
    pages = fx.station_documents(spark, sf)
    out = None
    for name, minutes in SNAPSHOT_CASES.items():
        at = dt.datetime.fromisoformat(K.FIXTURE_AS_OF) + dt.timedelta(minutes=minutes)
        one = ST.latest_snapshot(pages, at).agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("stations"), F.min("snapshot_id").alias("snapshot_id"),
            F.bool_or("is_stale").alias("is_stale"))
        out = one if out is None else out.unionByName(one)
    return out


@q("report_export", f"SELECT * FROM ({s_report('trade_in', s_trade())})")
def _report_export(spark, sf):
    """Export the trade-in list (parquet here; CSV by default), read back."""
    out = scratch_path(spark, "exports")
    path = T.report_export(report(cust(spark, sf), "trade_in"), "trade_in", out, fmt="parquet",
                           logs_path=scratch_path(spark, "system_logs"))
    return spark.read.parquet(path)


@q("report_export_csv", f"SELECT * FROM ({s_report('trade_in', s_trade())})")
def _report_export_csv(spark, sf):
    """The default CSV export, read back with its quoting (cells that held
    nothing read as null, as in a spreadsheet; the oracle's never do here)."""
    path = T.report_export(report(cust(spark, sf), "trade_in"), "trade_in", scratch_path(spark, "exports"))
    back = T.load_customers(spark, path, fmt="csv")
    src = report(cust(spark, sf), "trade_in")
    types = dict(src.dtypes)
    blank = src.select("customer_id", *[F.col(c).alias(f"_{c}") for c in src.columns if c != "customer_id"])
    j = back.join(blank, "customer_id")
    # an empty cell and a missing one are the same in CSV: take the table's
    return j.select(*[F.col(c) if c == "customer_id" else
                      F.when(F.col(c).isNull() & (F.col(f"_{c}").cast("string") == ""), F.col(f"_{c}"))
                      .otherwise(F.col(c).cast(types[c])).alias(c) for c in back.columns])


@q("report_export_general", """SELECT customer_id, full_name, phone, contact_channel, vehicle_model, city, close_reason
FROM customers""")
def _report_export_general(spark, sf):
    """The export of a page without columns of its own."""
    path = T.report_export(cust(spark, sf), "general", scratch_path(spark, "exports"), fmt="parquet")
    return spark.read.parquet(path)


@q("log_export", f"""SELECT * FROM (SELECT log_ts, user_name, action_type, detail FROM system_logs)
UNION ALL SELECT strftime({O.AS_OF}, '%Y-%m-%d %H:%M:%S'), '{K.UNKNOWN_USER}', '{K.AUDIT_LOG_EXPORT[0]}', '{K.AUDIT_LOG_EXPORT[1]}'""",
   needs=("system_logs",))
def _log_export(spark, sf):
    """The exported log, and the audit row that the export writes."""
    logs = scratch_path(spark, "system_logs")
    path = T.report_export(T.audit_log(spark, logs=fx.system_logs(spark, sf)), "logs", scratch_path(spark, "exports"),
                           fmt="parquet", logs_path=logs)
    return spark.read.parquet(path).unionByName(T.audit_log(spark, logs))


@q("report_export_reminders", f"""
SELECT customer_id, full_name, phone, contact_channel, reminder_at, operator, notes
FROM ({s_report('reminders', f"reminder_at IS NOT NULL AND {O.strip('reminder_at')} <> '' AND lower(reminder_at) <> 'nan' AND {s_reminder_ts()} IS NOT NULL",
               {'reminder_at': f"strftime({s_reminder_ts()}, '%d-%m-%Y %H:%M')"})})""")
def _report_export_reminders(spark, sf):
    """Reminder export: other column order and no close reason."""
    out = scratch_path(spark, "exports")
    path = T.report_export(report(cust(spark, sf), "reminders"), "reminders", out, fmt="parquet")
    return spark.read.parquet(path)


# ================================================================ 2.2 scalars
@q("norm_token", f"""SELECT customer_id, {O.norm_token('called_flag')} AS flag_token,
  {O.norm_token('close_reason')} AS reason_token, {O.norm_token('test_drive_status')} AS drive_token FROM customers""")
def _norm_token(spark, sf):
    c = cust(spark, sf)
    return c.select("customer_id", norm_token("called_flag").alias("flag_token"),
                    norm_token("close_reason").alias("reason_token"),
                    norm_token("test_drive_status").alias("drive_token"))


@q("to_number", f"""SELECT customer_id, {O.to_number('odometer_km', '0')} AS km,
  {O.to_number('model_year', CY)} AS year, {O.to_number('phone')} AS phone_number FROM customers""")
def _to_number(spark, sf):
    c = cust(spark, sf)
    return c.select("customer_id", to_number("odometer_km", 0).alias("km"),
                    to_number("model_year", F.year(as_of_col())).alias("year"),
                    to_number("phone").alias("phone_number"))


@q("safe_col", "SELECT customer_id, '-' AS occupation, city, '' AS last_service_date FROM customers")
def _safe_col(spark, sf):
    from ..functions import col_or
    c = cust(spark, sf)
    return c.select("customer_id", col_or(c, "occupation", "-").alias("occupation"),
                    col_or(c, "city", "-").alias("city"),
                    col_or(c, "last_service_date", "").alias("last_service_date"))


@q("parse_date", f"""SELECT customer_id, {O.parse_ts('action_date')} AS action_ts,
  {O.parse_ts('birth_date')} AS birth_ts, {s_reminder_ts()} AS reminder_ts FROM customers""")
def _parse_date(spark, sf):
    c = cust(spark, sf)
    return c.select("customer_id", parse_ts("action_date").alias("action_ts"),
                    parse_ts("birth_date").alias("birth_ts"),
                    S.reminder_due_ts(c).alias("reminder_ts"))


@q("format_dates", f"""SELECT customer_id, {O.format_date('action_date')} AS action_date,
  {O.format_date('birth_date')} AS birth_date FROM customers""")
def _format_dates(spark, sf):
    from ..functions import format_dates
    return format_dates(cust(spark, sf)).select("customer_id", "action_date", "birth_date")


@q("format_reminder", f"SELECT customer_id, strftime({s_reminder_ts()}, '%d-%m-%Y %H:%M') AS reminder_text FROM customers")
def _format_reminder(spark, sf):
    return cust(spark, sf).select("customer_id", format_reminder("reminder_at").alias("reminder_text"))


@q("is_meaningful", f"""SELECT customer_id, coalesce({O.is_meaningful('vehicle_model')}, FALSE) AS model_ok,
  coalesce({O.is_meaningful('interested_vehicle')}, FALSE) AS interest_ok,
  coalesce({O.is_meaningful('reminder_at', False)}, FALSE) AS reminder_ok FROM customers""")
def _is_meaningful(spark, sf):
    c = cust(spark, sf)
    return c.select("customer_id",
                    F.coalesce(is_meaningful("vehicle_model"), F.lit(False)).alias("model_ok"),
                    F.coalesce(is_meaningful("interested_vehicle"), F.lit(False)).alias("interest_ok"),
                    F.coalesce(is_meaningful("reminder_at", reject_dash=False), F.lit(False)).alias("reminder_ok"))


@q("clean_display", f"""SELECT customer_id, {s_clean('vehicle_model')} AS model, {s_clean('birth_date')} AS birth,
  {s_clean('city')} AS city, {s_clean('NULL')} AS occupation,
  {s_clean("birth_date || ' 00:00:00'")} AS birth_ts_text FROM customers""")
def _clean_display(spark, sf):
    c = cust(spark, sf)
    return c.select("customer_id", clean_display("vehicle_model").alias("model"),
                    clean_display("birth_date").alias("birth"), clean_display("city").alias("city"),
                    clean_display(F.lit(None).cast("string")).alias("occupation"),
                    clean_display(F.concat("birth_date", F.lit(" 00:00:00"))).alias("birth_ts_text"))


def s_phone(x="phone"):
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    d2 = (f"(CASE WHEN length({d}) = 12 AND starts_with({d}, '90') THEN '0' || substr({d}, 3) "
          f"WHEN length({d}) = 10 THEN '0' || {d} ELSE {d} END)")
    return (f"CASE WHEN {x} IS NULL OR {O.strip(x)} = '' THEN '-' "
            f"WHEN length({d2}) = 11 AND starts_with({d2}, '0') THEN "
            f"regexp_replace({d2}, '^(\\d)(\\d{{3}})(\\d{{3}})(\\d{{2}})(\\d{{2}})$', '\\1 \\2 \\3 \\4 \\5') "
            f"ELSE {x} END")


@q("format_phone", f"SELECT customer_id, {s_phone()} AS phone_display FROM customers")
def _format_phone(spark, sf):
    return cust(spark, sf).select("customer_id", format_phone("phone").alias("phone_display"))


@q("normalize_city", f"SELECT customer_id, {O.normalize_city('city')} AS city_key FROM customers")
def _normalize_city(spark, sf):
    return cust(spark, sf).select("customer_id", normalize_city("city").alias("city_key"))


@q("last_note_ts", f"SELECT customer_id, {O.last_note_ts('notes')} AS last_note_ts FROM customers")
def _last_note_ts(spark, sf):
    return cust(spark, sf).select("customer_id", last_note_ts("notes").alias("last_note_ts"))


@q("warranty_label", f"SELECT customer_id, {s_warranty_label()} AS warranty_label FROM customers")
def _warranty_label(spark, sf):
    return cust(spark, sf).select("customer_id", warranty_label("model_year").alias("warranty_label"))


@q("warranty_status", f"""SELECT customer_id, CASE WHEN l = '{K.WARRANTY_EXPIRED}' THEN 'expired'
  WHEN l = '{K.WARRANTY_ENDS_THIS_YEAR}' THEN 'ending' WHEN contains(l, '{K.WARRANTY_YEARS_LEFT}') THEN 'active' END AS status
  FROM (SELECT customer_id, {s_warranty_label()} AS l FROM customers)""")
def _warranty_status(spark, sf):
    return cust(spark, sf).select("customer_id", warranty_status(warranty_label("model_year")).alias("status"))


def s_progress(n):
    return f"CAST(least(floor((CAST({n} AS DOUBLE) / CAST({K.DAILY_GOAL} AS DOUBLE)) * CAST(100 AS DOUBLE)), 100) AS BIGINT)"


@q("goal_progress", f"""SELECT staff_name, n, {s_progress('n')} AS progress_pct, n >= {K.DAILY_GOAL} AS goal_met
  FROM (SELECT {O.strip("coalesce(operator, 'None')")} AS staff_name, count(*) AS n FROM customers GROUP BY 1)""")
def _goal_progress(spark, sf):
    """Goal bar of every operator's all-time action count."""
    c = cust(spark, sf)
    g = c.groupBy(ustrip(F.coalesce("operator", F.lit("None"))).alias("staff_name")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("staff_name", "n", goal_progress("n").alias("progress_pct"), goal_met("n").alias("goal_met"))


@q("customer_tooltip", """SELECT customer_id, '**İletişim:** ' || coalesce(phone, 'None') || chr(10) || chr(10)
  || '**Meslek:** -' || chr(10) || chr(10) || '**Bölge:** ' || coalesce(city, 'None') AS tooltip FROM customers""")
def _customer_tooltip(spark, sf):
    c = cust(spark, sf)
    return c.select("customer_id", customer_tooltip(c).alias("tooltip"))


@q("log_tooltip", """SELECT log_ts, user_name, CASE WHEN detail IS NOT NULL AND detail <> '' AND lower(detail) <> 'nan'
  THEN detail END AS tooltip FROM system_logs""", needs=("system_logs",))
def _log_tooltip(spark, sf):
    return fx.system_logs(spark, sf).select("log_ts", "user_name", log_tooltip("detail").alias("tooltip"))


GEO_SQL = f"""SELECT customer_id, full_name, vehicle_model, city, m.city_key, lat, lon
  FROM (SELECT *, {O.normalize_city('city')} AS city_key FROM customers
        WHERE city IS NOT NULL AND city <> '' AND city <> '-') m JOIN cities USING (city_key)"""


@q("map_hover", f"""SELECT customer_id, full_name || '<br>Model: ' || vehicle_model || '<br>Şehir: ' || city AS hover
  FROM ({GEO_SQL})""", needs=(C, "cities"))
def _map_hover(spark, sf):
    g = J.customer_geo(cust(spark, sf))
    return g.select("customer_id", map_hover(F.col("full_name"), F.col("vehicle_model"), F.col("city")).alias("hover"))


def s_jitter(salt: str) -> str:
    u = f"CAST(('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '{salt}'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"
    return f"({u} * 2.0 - 1.0) * CAST({K.GEO_JITTER_DEG} AS DOUBLE)"


JITTER_SQL = f"""SELECT customer_id, lat + {s_jitter('lat')} AS lat, lon + {s_jitter('lon')} AS lon,
  full_name || '<br>Model: ' || vehicle_model || '<br>Şehir: ' || city AS hover FROM ({GEO_SQL})"""


@q("geo_jitter", JITTER_SQL, needs=(C, "cities"))
def _geo_jitter(spark, sf):
    """Map points spread by a deterministic offset per customer."""
    return J.jittered(J.customer_geo(cust(spark, sf)))


@q("station_name", f"""SELECT lat, lon, upper(coalesce(t_operator, t_brand, t_name, '{K.UNKNOWN_STATION}')) AS station_name
  FROM stations_raw""", needs=("stations_raw",))
def _station_name(spark, sf):
    """Display name of every element of every valid feed document."""
    from ..functions import station_name
    p = ST.parse_feed(fx.station_documents(spark, sf)).where("valid")
    e = p.select(F.explode("elements").alias("e"))
    return e.select(F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"),
                    station_name(F.col("e.tags")).alias("station_name"))


def s_note_line(with_reminder=True):
    base = ("strftime(patch_ts, '%d.%m.%Y %H:%M') || ' | ' || coalesce(user_name, 'None') || ' | ' || "
            + O.strip("note"))
    if not with_reminder:
        return base
    pre, post = K.REMINDER_SUFFIX.split("{}")
    return (base + f" || CASE WHEN reminder IS NOT NULL AND reminder <> '' THEN '{pre}' || replace(reminder, 'T', ' ') "
            f"|| '{post}' ELSE '' END")


@q("note_line", f"SELECT customer_id, seq, {s_note_line()} AS line FROM outcome_patches WHERE note IS NOT NULL AND note <> ''",
   needs=("outcome_patches",))
def _note_line(spark, sf):
    p = fx.outcome_patches(spark, sf)
    return p.where(F.col("note").isNotNull() & (F.col("note") != "")).select(
        "customer_id", "seq", note_line(F.col("patch_ts"), F.col("user_name"), F.col("note"), F.col("reminder")).alias("line"))


# ======================================================== 2.3 segments/reports
@q("seg_processed", f"SELECT * FROM customers WHERE {s_processed()}")
def _seg_processed(spark, sf):
    return S.seg_processed(cust(spark, sf))


@q("seg_trade_in", f"SELECT * FROM customers WHERE {s_trade()}")
def _seg_trade_in(spark, sf):
    return S.seg_trade_in(cust(spark, sf))


@q("seg_warranty", f"SELECT * FROM customers WHERE {s_warranty()}")
def _seg_warranty(spark, sf):
    return S.seg_warranty(cust(spark, sf))


@q("seg_untouched", f"SELECT * FROM customers WHERE {O.norm_token('called_flag')} IN {NOT_DONE}")
def _seg_untouched(spark, sf):
    return S.seg_untouched(cust(spark, sf))


@q("seg_low_quality", f"SELECT * FROM customers WHERE {O.norm_token('close_reason')} IN {O.in_list(K.LOW_QUALITY_REASONS)}")
def _seg_low_quality(spark, sf):
    return S.seg_low_quality(cust(spark, sf))


@q("seg_test_drive", f"SELECT * FROM customers WHERE {O.norm_token('test_drive_status')} IN {O.in_list(K.TEST_DRIVE_DONE)}")
def _seg_test_drive(spark, sf):
    return S.seg_test_drive(cust(spark, sf))


@q("seg_called", f"SELECT * FROM customers WHERE called_flag = '{K.CALLED_EXACT}'")
def _seg_called(spark, sf):
    return S.seg_called(cust(spark, sf))


REMINDER_WHERE = (f"reminder_at IS NOT NULL AND {O.strip('reminder_at')} <> '' AND lower(reminder_at) <> 'nan' "
                  f"AND {s_reminder_ts()} IS NOT NULL")

REPORT_SQL = {
    "processed": s_report("processed", s_processed()),
    "trade_in": s_report("trade_in", s_trade()),
    "warranty": s_report("warranty", s_warranty(), {"warranty_label": s_warranty_label()}),
    "untouched": s_report("untouched", f"{O.norm_token('called_flag')} IN {NOT_DONE}"),
    "low_quality": s_report("low_quality", f"{O.norm_token('close_reason')} IN {O.in_list(K.LOW_QUALITY_REASONS)}"),
    "test_drive": s_report("test_drive", f"{O.norm_token('test_drive_status')} IN {O.in_list(K.TEST_DRIVE_DONE)}"),
    "reminders": s_report("reminders", REMINDER_WHERE,
                          {"reminder_at": f"strftime({s_reminder_ts()}, '%d-%m-%Y %H:%M')"}),
}


def _register_report(name):
    @q(f"report_{name}", REPORT_SQL[name])
    def _r(spark, sf):
        return report(cust(spark, sf), name)
    _r.__doc__ = f"Display table of the {name} report."


for _name in REPORT_SQL:
    _register_report(_name)


@q("report_view", f"SELECT customer_id, action_date, full_name, contact_channel, close_reason FROM ({REPORT_SQL['low_quality']})")
def _report_view(spark, sf):
    """Ordered projection onto existing columns (low-quality list)."""
    from .reports import report_view
    return report_view(S.seg_low_quality(cust(spark, sf)), "low_quality")


@q("reminder_list", f"""SELECT customer_id, strftime({s_reminder_ts()}, '%d-%m-%Y %H:%M') AS reminder_at,
  {s_reminder_ts()} AS due_ts FROM customers WHERE {REMINDER_WHERE}""")
def _reminder_list(spark, sf):
    return S.reminder_list(cust(spark, sf)).select("customer_id", "reminder_at", "due_ts")


BIRTH_TS = O.parse_ts(O.as_text("birth_date"))


@q("birthdays_today", f"""SELECT customer_id, coalesce(full_name, 'None') AS full_name FROM customers
  WHERE month({BIRTH_TS}) = month({O.AS_OF}) AND day({BIRTH_TS}) = day({O.AS_OF})""")
def _birthdays_today(spark, sf):
    return S.birthdays_today(cust(spark, sf))


BIRTH_MONTH_SQL = f"""SELECT customer_id, full_name, birth_date, CAST(day({O.parse_ts('birth_date')}) AS INTEGER) AS birth_day
  FROM customers WHERE birth_date IS NOT NULL AND {O.strip('birth_date')} <> ''
  AND month({O.parse_ts('birth_date')}) = month({O.AS_OF})"""


@q("birthdays_month", BIRTH_MONTH_SQL)
def _birthdays_month(spark, sf):
    return S.birthdays_month(cust(spark, sf))


@q("mappable_customers", f"""SELECT customer_id, full_name, city, {O.normalize_city('city')} AS city_key FROM customers
  WHERE city IS NOT NULL AND city <> '' AND city <> '-'""")
def _mappable_customers(spark, sf):
    return J.mappable_customers(cust(spark, sf)).select("customer_id", "full_name", "city", "city_key")


SEARCH_Q = "SUPPLIER#00000000[12]|konya"
CUSTOMER_COLS = ["customer_id", "full_name", "phone", "close_reason", "called_flag", "operator",
                 "action_date", "reminder_at", "notes", "odometer_km", "model_year",
                 "test_drive_status", "birth_date", "vehicle_model", "interested_vehicle",
                 "contact_channel", "city"]


def s_search(pattern: str, literal: bool = False):
    p = pattern.lower().replace("'", "''")
    hits = [(f"contains({O.lower(O.as_text(c))}, '{p}')" if literal
             else f"regexp_matches({O.lower(O.as_text(c))}, '{p}')") for c in CUSTOMER_COLS]
    return " OR ".join(hits)


@q("global_search", f"SELECT * FROM customers WHERE {s_search(SEARCH_Q)}")
def _global_search(spark, sf):
    return N.global_search(cust(spark, sf), SEARCH_Q)


@q("global_search_literal", f"SELECT * FROM customers WHERE {s_search('None', literal=True)}")
def _global_search_literal(spark, sf):
    """Literal search for 'None': matches every null field."""
    return N.global_search(cust(spark, sf), "None", literal=True)


@q("customer_profile", f"""SELECT customer_id, full_name, phone,
  CASE WHEN coalesce(close_reason, '') <> '' THEN close_reason ELSE '{K.PENDING_STATUS}' END AS status,
  {s_clean('vehicle_model')} AS model, {s_clean('birth_date')} AS birth_date, '-' AS occupation,
  {s_clean('city')} AS city FROM customers""")
def _customer_profile(spark, sf):
    """Profile card of every customer (the point lookup is the same plan
    with a pushed-down key filter)."""
    return N.customer_profile(cust(spark, sf))


@q("customer_profile_lookup", f"""SELECT customer_id, full_name, phone,
  CASE WHEN coalesce(close_reason, '') <> '' THEN close_reason ELSE '{K.PENDING_STATUS}' END AS status,
  {s_clean('vehicle_model')} AS model, {s_clean('birth_date')} AS birth_date, '-' AS occupation,
  {s_clean('city')} AS city FROM customers WHERE customer_id = 77""")
def _customer_profile_lookup(spark, sf):
    """One customer's card."""
    return N.customer_profile(cust(spark, sf), 77)


INDEXED_Q = "customer#0000001"


@q("global_search_indexed", f"SELECT * FROM customers WHERE {s_search(INDEXED_Q, literal=True)}")
def _global_search_indexed(spark, sf):
    """A literal search through the trigram index of the stored table."""
    table = fx.materialize_customers(spark, sf, scratch_path(spark, "customers")).select(CUSTOMER_COLS)
    return SI.search(table, SI.build(table, scratch_path(spark, "index")), INDEXED_Q, literal=True)


@q("customer_profile_stored", ORACLE_BODY["customer_profile_lookup"])
def _customer_profile_stored(spark, sf):
    """One customer's card from the table in key ranges."""
    return N.customer_profile(keyed(spark, sf).at(77))


TIMELINE_SQL = f"""
WITH l AS (
  SELECT customer_id, unnest(string_split(coalesce(notes, 'None'), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(notes, 'None'), chr(10))))) AS line_idx
  FROM customers),
r AS (SELECT *, substr(line, strpos(line, '|') + 1) AS rest1 FROM l WHERE contains(line, '|')),
r2 AS (SELECT *, substr(rest1, strpos(rest1, '|') + 1) AS p2 FROM r WHERE contains(rest1, '|'))
SELECT customer_id, CAST(line_idx AS INTEGER) AS line_idx, {O.strip("split_part(line, '|', 1)")} AS ts_text,
  {O.strip("split_part(line, '|', 2)")} AS author, {O.strip('p2')} AS text,
  contains(p2, '{K.DELETED_MARK}') AS deleted
FROM r2"""


@q("notes_timeline", TIMELINE_SQL)
def _notes_timeline(spark, sf):
    return N.notes_timeline(cust(spark, sf))


# ================================================================ 2.4 joins
@q("customer_geo", GEO_SQL, needs=(C, "cities"))
def _customer_geo(spark, sf):
    return J.customer_geo(cust(spark, sf))


DAILY_COUNTS = f"""SELECT {O.strip("coalesce(operator, 'None')")} AS staff_name, count(*) AS n FROM customers
  WHERE action_date = strftime({O.AS_OF}, '%Y-%m-%d') GROUP BY 1"""


@q("daily_goal", f"""SELECT r.staff_name, coalesce(d.n, 0) AS n, {s_progress('coalesce(d.n, 0)')} AS progress_pct,
  coalesce(d.n, 0) >= {K.DAILY_GOAL} AS goal_met
  FROM (SELECT staff_name FROM staff WHERE role = 'sales') r LEFT JOIN ({DAILY_COUNTS}) d USING (staff_name)""",
   needs=(C, "staff"))
def _daily_goal(spark, sf):
    return A.daily_goal(cust(spark, sf), fx.staff(spark, sf))


CAL_SQL = f"""SELECT CAST(d AS INTEGER) AS day, CAST((d - 1 + w.wd0) // 7 AS INTEGER) AS week,
  CAST((d - 1 + w.wd0) % 7 AS INTEGER) AS weekday
  FROM range(1, day(last_day(CAST({O.AS_OF} AS DATE))) + 1) t(d),
       (SELECT isodow(date_trunc('month', CAST({O.AS_OF} AS DATE))) - 1 AS wd0) w"""


@q("birthday_calendar", f"""WITH cal AS ({CAL_SQL}), b AS ({BIRTH_MONTH_SQL})
  SELECT cal.week, cal.weekday, cal.day, b.customer_id, b.full_name FROM cal JOIN b ON cal.day = b.birth_day
  UNION ALL
  SELECT week, weekday, day, NULL, NULL FROM cal WHERE day NOT IN (SELECT birth_day FROM b)""")
def _birthday_calendar(spark, sf):
    return J.birthday_calendar(cust(spark, sf))


def s_outcome_applied():
    line = O.rstrip(s_note_line())
    return f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY patch_ts DESC, seq DESC) AS rn
           FROM outcome_patches),
lastp AS (SELECT customer_id, user_name AS p_user, strftime(patch_ts, '%Y-%m-%d') AS p_date FROM p WHERE rn = 1),
rp AS (SELECT customer_id, reason AS p_reason FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
        ORDER BY patch_ts DESC, seq DESC) AS k FROM outcome_patches WHERE reason IS NOT NULL) WHERE k = 1),
rm AS (SELECT customer_id, reminder AS p_reminder FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
        ORDER BY patch_ts DESC, seq DESC) AS k FROM outcome_patches WHERE reminder IS NOT NULL AND reminder <> '') WHERE k = 1),
ln AS (SELECT customer_id, string_agg({line}, chr(10) ORDER BY patch_ts, seq) AS p_lines
       FROM outcome_patches WHERE note IS NOT NULL AND note <> '' GROUP BY customer_id),
applied AS (
SELECT c.customer_id, c.full_name, c.phone, coalesce(rp.p_reason, c.close_reason) AS close_reason,
  CASE WHEN lastp.customer_id IS NOT NULL THEN '{K.CALLED_EXACT}' ELSE c.called_flag END AS called_flag,
  CASE WHEN lastp.customer_id IS NOT NULL THEN lastp.p_user ELSE c.operator END AS operator,
  CASE WHEN lastp.customer_id IS NOT NULL THEN lastp.p_date ELSE c.action_date END AS action_date,
  coalesce(rm.p_reminder, c.reminder_at) AS reminder_at,
  CASE WHEN ln.p_lines IS NOT NULL THEN {O.strip("concat_ws(chr(10), CASE WHEN c.notes IS NOT NULL AND c.notes <> '' AND c.notes <> 'nan' THEN c.notes END, ln.p_lines)")}
       ELSE c.notes END AS notes,
  c.odometer_km, c.model_year, c.test_drive_status, c.birth_date, c.vehicle_model, c.interested_vehicle,
  c.contact_channel, c.city
FROM customers c LEFT JOIN lastp USING (customer_id) LEFT JOIN rp USING (customer_id)
  LEFT JOIN rm USING (customer_id) LEFT JOIN ln USING (customer_id))
"""


@q("apply_outcome", s_outcome_applied() + "SELECT * FROM applied", needs=(C, "outcome_patches"))
def _apply_outcome(spark, sf):
    return M.apply_outcome(cust(spark, sf), fx.outcome_patches(spark, sf))


@q("append_note", s_outcome_applied() + "SELECT customer_id, notes FROM applied", needs=(C, "outcome_patches"))
def _append_note(spark, sf):
    """The notes column after the saves' notes."""
    return M.append_note(cust(spark, sf), fx.outcome_patches(spark, sf)).select("customer_id", "notes")


@q("apply_admin_edit", f"""
WITH lastp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY patch_ts DESC, seq DESC) AS rn
               FROM admin_patches) WHERE rn = 1),
ln AS (SELECT customer_id, string_agg({s_note_line(False)}, chr(10) ORDER BY patch_ts, seq) AS p_lines
       FROM admin_patches WHERE note IS NOT NULL AND note <> '' GROUP BY customer_id)
SELECT c.customer_id,
  CASE WHEN l.customer_id IS NOT NULL THEN l.full_name ELSE c.full_name END AS full_name,
  CASE WHEN l.customer_id IS NOT NULL THEN l.phone ELSE c.phone END AS phone,
  CASE WHEN l.customer_id IS NOT NULL THEN l.close_reason ELSE c.close_reason END AS close_reason,
  c.called_flag, c.operator, c.action_date, c.reminder_at,
  CASE WHEN l.customer_id IS NOT NULL THEN coalesce(c.notes, '') || coalesce(chr(10) || ln.p_lines, '') ELSE c.notes END AS notes,
  c.odometer_km, c.model_year, c.test_drive_status, c.birth_date, c.vehicle_model, c.interested_vehicle,
  c.contact_channel, c.city
FROM customers c LEFT JOIN lastp l ON c.customer_id = l.customer_id LEFT JOIN ln ON c.customer_id = ln.customer_id""",
   needs=(C, "admin_patches"))
def _apply_admin_edit(spark, sf):
    return M.apply_admin_edit(cust(spark, sf), fx.admin_patches(spark, sf))


def _register_stored(name, update, patches):
    @q(f"{name}_stored", ORACLE_BODY[name], needs=ORACLE_NEEDS[name])
    def _r(spark, sf):
        return keyed(spark, sf).change(update, patches(spark, sf))
    _r.__doc__ = f"{name} on the table in key ranges: only touched ranges are written."


REMINDER_DUE_SQL = f"""SELECT operator, customer_id, coalesce(full_name, 'None') AS full_name, phone, due_ts
  FROM (SELECT *, {s_reminder_ts()} AS due_ts FROM customers
        WHERE operator IS NOT NULL AND reminder_at IS NOT NULL AND reminder_at <> '')
  WHERE due_ts BETWEEN {{now}} - INTERVAL {K.REMINDER_LATE_S} SECOND AND {{now}} + INTERVAL {K.REMINDER_EARLY_S} SECOND"""
PREV_POLL = f"({O.AS_OF} - INTERVAL {K.REMINDER_POLL_S} SECOND)"
PREV_POLL_VALUE = "2001-08-01 11:59:40"


@q("reminder_due", REMINDER_DUE_SQL.format(now=O.AS_OF))
def _reminder_due(spark, sf):
    return J.reminder_due(cust(spark, sf))


def notified(c: DataFrame) -> DataFrame:
    return J.reminder_due(c, PREV_POLL_VALUE).where(F.col("customer_id") % 3 == 0)


PENDING_SQL = (f"SELECT * FROM ({REMINDER_DUE_SQL.format(now=O.AS_OF)}) WHERE customer_id NOT IN "
               f"(SELECT customer_id FROM ({REMINDER_DUE_SQL.format(now=PREV_POLL)}) WHERE customer_id % 3 = 0)")


@q("reminder_pending", PENDING_SQL)
def _reminder_pending(spark, sf):
    """Due now and not notified yet: the poll before (20 s earlier) had got
    through every third of what was due."""
    c = cust(spark, sf)
    return J.reminder_pending(J.reminder_due(c), notified(c))


@q("still_notified", f"""SELECT customer_id FROM ({REMINDER_DUE_SQL.format(now=PREV_POLL)}) WHERE customer_id % 3 = 0
  AND customer_id % 4 <> 0""")
def _still_notified(spark, sf):
    """The notified ids after every fourth customer's reminder was completed."""
    n = notified(cust(spark, sf)).select("customer_id")
    return M.still_notified(n, n.where(F.col("customer_id") % 4 == 0))


# ============================================================ 2.5 aggregates
@q("kpi_summary", f"""SELECT count(*) FILTER (WHERE {s_trade()}) AS trade_in,
  count(*) FILTER (WHERE {O.norm_token('called_flag')} IN {NOT_DONE}) AS untouched,
  count(*) FILTER (WHERE {s_warranty()}) AS warranty, count(*) AS total FROM customers""")
def _kpi_summary(spark, sf):
    return S.kpi_summary(cust(spark, sf))


@q("close_reason_dist", """SELECT close_reason AS reason, count(*) AS n FROM customers WHERE close_reason IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'Veri Yok', CAST(1 AS BIGINT) WHERE NOT EXISTS (SELECT 1 FROM customers WHERE close_reason IS NOT NULL)""")
def _close_reason_dist(spark, sf):
    return A.close_reason_dist(cust(spark, sf))


@q("close_reason_dist_empty", """SELECT 'Veri Yok' AS reason, CAST(1 AS BIGINT) AS n
  WHERE (SELECT count(close_reason) FROM customers WHERE close_reason IS NULL) = 0""")
def _close_reason_dist_empty(spark, sf):
    """Placeholder path: the customers without a reason give the one
    placeholder row."""
    return A.close_reason_dist(cust(spark, sf).where(F.col("close_reason").isNull()))


def _dist_sql(col):
    return f"SELECT {col}, count(*) AS n FROM customers WHERE {O.is_meaningful(col)} GROUP BY 1"


@q("vehicle_model_dist", _dist_sql("vehicle_model"))
def _vehicle_model_dist(spark, sf):
    return A.vehicle_model_dist(cust(spark, sf))


@q("interest_dist", _dist_sql("interested_vehicle"))
def _interest_dist(spark, sf):
    return A.interest_dist(cust(spark, sf))


@q("channel_dist", _dist_sql("contact_channel"))
def _channel_dist(spark, sf):
    return A.channel_dist(cust(spark, sf))


def _calls_sql(days):
    return (f"SELECT operator, count(*) AS calls FROM customers WHERE called_flag = '{K.CALLED_EXACT}' "
            f"AND {O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL {days} DAY AND operator IS NOT NULL GROUP BY 1")


def _register_calls(days):
    @q(f"calls_by_staff_{days}", _calls_sql(days))
    def _r(spark, sf):
        return A.calls_by_staff(cust(spark, sf), days)
    _r.__doc__ = f"Calls per operator in the last {days} days."


for _d in K.PERIODS:
    _register_calls(_d)

STAFF_ONE = "Supplier#000000001"


def _reasons_sql(staff=None):
    extra = f" AND operator = '{staff}'" if staff else ""
    return (f"SELECT close_reason AS reason, count(*) AS n FROM customers WHERE called_flag = '{K.CALLED_EXACT}' "
            f"AND close_reason IS NOT NULL AND close_reason <> ''{extra} GROUP BY 1")


@q("reasons_by_staff", _reasons_sql())
def _reasons_by_staff(spark, sf):
    return A.reasons_by_staff(cust(spark, sf))


@q("reasons_by_staff_one", _reasons_sql(STAFF_ONE))
def _reasons_by_staff_one(spark, sf):
    return A.reasons_by_staff(cust(spark, sf), STAFF_ONE)


@q("distribution_share", f"""SELECT reason, n, CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS share_pct
  FROM ({_reasons_sql()})""")
def _distribution_share(spark, sf):
    return A.distribution_share(A.reasons_by_staff(cust(spark, sf)))


@q("staff_list", f"SELECT DISTINCT operator FROM customers WHERE called_flag = '{K.CALLED_EXACT}' AND operator IS NOT NULL")
def _staff_list(spark, sf):
    return A.staff_list(cust(spark, sf))


def _team_sql(days, staff):
    sel = "" if staff == K.ALL_STAFF else f" WHERE operator = '{staff}'"
    avg = f"CAST((SELECT count(*) FROM sel) AS DOUBLE) / CAST({days} AS DOUBLE)"
    rating = (f"CASE WHEN {avg} > 5 THEN 'active' ELSE 'low' END" if staff == K.ALL_STAFF else
              f"CASE WHEN {avg} >= 3 THEN 'very_good' WHEN {avg} >= 1 THEN 'good' ELSE 'needs_work' END")
    def fill(t, *xs):
        out = "'" + t.replace("'", "''") + "'"
        for i, x in enumerate(xs):
            out = out.replace("{" + str(i) + "}", "' || " + x + " || '")
        return out
    comment = "CASE rating " + " ".join(
        f"WHEN '{code}' THEN {fill(text, 'CAST(total_calls AS VARCHAR)')}" for code, text in K.TEAM_COMMENTS.items()) + " END"
    title = f"'{K.TEAM_TITLE_ALL}'" if staff == K.ALL_STAFF else "'" + K.TEAM_TITLE_ONE.replace("{1}", staff) + "'"
    insight = (f"CASE WHEN top_reason IS NOT NULL THEN {fill(K.TEAM_INSIGHT, 'top_reason', 'CAST(top_count AS VARCHAR)')} "
               f"ELSE '{K.TEAM_NO_INSIGHT}' END")
    return f"""
WITH period AS (SELECT * FROM customers WHERE called_flag = '{K.CALLED_EXACT}'
                AND {O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL {days} DAY),
sel AS (SELECT * FROM period{sel}),
top AS (SELECT close_reason AS reason, count(*) AS n FROM sel WHERE close_reason IS NOT NULL AND close_reason <> ''
        GROUP BY 1 ORDER BY n DESC, reason LIMIT 1),
ev AS (
SELECT '{staff}' AS staff, {days} AS days, (SELECT count(*) FROM sel) AS total_calls,
  (SELECT reason FROM top) AS top_reason, (SELECT n FROM top) AS top_count, {avg} AS daily_avg, {rating} AS rating
WHERE (SELECT count(*) FROM period) > 0)
SELECT *, {title} AS title, {comment} AS comment, {insight} AS insight FROM ev"""


@q("team_evaluation", _team_sql(30, K.ALL_STAFF))
def _team_evaluation(spark, sf):
    return A.team_evaluation(cust(spark, sf), 30)


@q("team_evaluation_staff", _team_sql(365, STAFF_ONE))
def _team_evaluation_staff(spark, sf):
    return A.team_evaluation(cust(spark, sf), 365, STAFF_ONE)


@q("team_evaluation_idle", _team_sql(7, "Supplier#000000002"))
def _team_evaluation_idle(spark, sf):
    """A staff member without calls in the period (rated 'needs work')."""
    return A.team_evaluation(cust(spark, sf), 7, "Supplier#000000002")


@q("performance_cube", f"""SELECT operator, close_reason,
  coalesce({O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL 7 DAY, FALSE) AS in_7d,
  coalesce({O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL 30 DAY, FALSE) AS in_30d,
  coalesce({O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL 365 DAY, FALSE) AS in_365d, count(*) AS n
  FROM customers WHERE called_flag = '{K.CALLED_EXACT}' GROUP BY ALL""")
def _performance_cube(spark, sf):
    """Called rows counted per (operator, reason, period flags): the shared
    input of the team performance widgets."""
    from .dashboard import performance_cube
    return performance_cube(cust(spark, sf))


@q("performance_cube_moved", s_outcome_applied() + f"""SELECT operator, close_reason,
  coalesce({O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL 7 DAY, FALSE) AS in_7d,
  coalesce({O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL 30 DAY, FALSE) AS in_30d,
  coalesce({O.parse_ts('action_date')} >= {O.AS_OF} - INTERVAL 365 DAY, FALSE) AS in_365d, count(*) AS n
  FROM applied WHERE called_flag = '{K.CALLED_EXACT}' GROUP BY ALL""", needs=(C, "outcome_patches"))
def _performance_cube_moved(spark, sf):
    """The cube after a batch of saves: stored counts moved on by the patched
    customers alone."""
    from .dashboard import call_counts, cube_of_counts, moved_counts
    table, path = keyed(spark, sf), scratch_path(spark, "call-counts")
    call_counts(table.rows()).write.parquet(path)
    patches = fx.outcome_patches(spark, sf)
    return cube_of_counts(moved_counts(spark.read.parquet(path), table.touching(patches), patches, M.apply_outcome))


@q("station_count", "SELECT count(*) AS stations FROM stations", needs=("stations",))
def _station_count(spark, sf):
    return A.station_count(ST.station_feed(fx.station_documents(spark, sf)))


# ======================================================= 2.7 sort / limit
@q("processed_archive", f"SELECT *, {O.last_note_ts('notes')} AS last_note_ts FROM customers WHERE {s_processed()}")
def _processed_archive(spark, sf):
    return S.processed_archive(cust(spark, sf))


@q("top_reason", f"SELECT reason, n FROM ({_reasons_sql()}) ORDER BY n DESC, reason LIMIT 1")
def _top_reason(spark, sf):
    return A.top_reason(cust(spark, sf))


@q("page", f"SELECT * FROM ({REPORT_SQL['trade_in']}) ORDER BY customer_id LIMIT {K.PAGE_SIZE} OFFSET {K.PAGE_SIZE}")
def _page(spark, sf):
    """Second page (12 rows) of the trade-in list sorted by customer id."""
    from ..operators.ordering import page
    return page(report(cust(spark, sf), "trade_in"), 1, order_by=["customer_id"])


@q("page_stored", f"SELECT * FROM ({REPORT_SQL['trade_in']}) ORDER BY customer_id LIMIT {K.PAGE_SIZE} OFFSET {K.PAGE_SIZE}")
def _page_stored(spark, sf):
    """Second page of the trade-in list from its stored sorted copy."""
    from ..operators.ordering import store_sorted, stored_page
    path = scratch_path(spark, "trade-in-sorted")
    store_sorted(report(cust(spark, sf), "trade_in"), path, ["customer_id"])
    return stored_page(spark, path, 1)


@q("due_reminder_first", f"""SELECT operator, customer_id, full_name, phone, due_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY operator ORDER BY due_ts, customer_id) AS rn FROM ({PENDING_SQL})) WHERE rn = 1""")
def _due_reminder_first(spark, sf):
    c = cust(spark, sf)
    return J.due_reminder_first(J.reminder_pending(J.reminder_due(c), notified(c)))


@q("map_layers", f"""SELECT 'customers' AS layer, lat, lon, hover AS label FROM ({JITTER_SQL})
  UNION ALL SELECT 'stations', lat, lon, '⚡ ' || station_name FROM stations""", needs=(C, "cities", "stations"))
def _map_layers(spark, sf):
    """Jittered customers and stations as one overlay."""
    return J.map_layers(J.customer_geo(cust(spark, sf)), ST.station_feed(fx.station_documents(spark, sf)))


# ========================================================= 2.8 mutations
@q("delete_note", f"""
WITH d AS (SELECT customer_id, list(DISTINCT line_idx) AS idx FROM note_deletions GROUP BY customer_id)
SELECT c.* REPLACE (
  CASE WHEN d.idx IS NOT NULL AND c.notes IS NOT NULL AND c.notes <> '' THEN
    array_to_string(list_transform(string_split(c.notes, chr(10)), lambda x, i:
      CASE WHEN list_contains(d.idx, CAST(i - 1 AS INTEGER)) AND contains(x, '|') THEN
        {O.strip("split_part(x, '|', 1)")} || ' | ' || {O.strip("split_part(x, '|', 2)")} || ' | {K.DELETED_MARK}'
      ELSE x END), chr(10))
  ELSE c.notes END AS notes)
FROM customers c LEFT JOIN d ON c.customer_id = d.customer_id""", needs=(C, "note_deletions"))
def _delete_note(spark, sf):
    return M.delete_note(cust(spark, sf), fx.note_deletions(spark, sf))


OVERDUE_SQL = (f"SELECT customer_id FROM customers WHERE {s_reminder_ts()} < "
               f"{O.AS_OF} - INTERVAL {K.REMINDER_LATE_S} SECOND")


def overdue_reminders(c: DataFrame) -> DataFrame:
    """Customers whose reminder passed the alert window: marked done."""
    late = as_of_col() - F.expr(f"INTERVAL {K.REMINDER_LATE_S} SECONDS")
    return c.where(S.reminder_due_ts(c) < late).select("customer_id", "operator")


@q("complete_reminder", f"""SELECT c.* REPLACE (CASE WHEN c.customer_id IN ({OVERDUE_SQL}) THEN NULL
  ELSE c.reminder_at END AS reminder_at) FROM customers c""")
def _complete_reminder(spark, sf):
    c = cust(spark, sf)
    return M.complete_reminder(c, overdue_reminders(c))


_register_stored("apply_outcome", M.apply_outcome, fx.outcome_patches)
_register_stored("apply_admin_edit", M.apply_admin_edit, fx.admin_patches)
_register_stored("delete_note", M.delete_note, fx.note_deletions)
_register_stored("complete_reminder", M.complete_reminder, lambda spark, sf: overdue_reminders(cust(spark, sf)))


@q("audit_from_patches", OUTCOME_AUDIT_SQL + f"""
UNION ALL
SELECT strftime(patch_ts, '%Y-%m-%d %H:%M:%S'), user_name, '{K.AUDIT_ADMIN[0]}',
       'Müşteri (No: ' || CAST(customer_id AS VARCHAR) || ') bilgileri yönetici tarafından güncellendi.'
FROM admin_patches
UNION ALL
SELECT strftime({O.AS_OF}, '%Y-%m-%d %H:%M:%S'), 'Admin', '{K.AUDIT_DELETE[0]}',
       CAST(customer_id AS VARCHAR) || ' numaralı müşterinin geçmiş notu silindi.' FROM note_deletions
UNION ALL
SELECT strftime({O.AS_OF}, '%Y-%m-%d %H:%M:%S'), coalesce(c.operator, 'None'), '{K.AUDIT_COMPLETE[0]}',
       'Müşteri: ' || coalesce(c.full_name, '{K.UNKNOWN_CUSTOMER}') || ' (No: ' || CAST(c.customer_id AS VARCHAR)
       || ') için kurulan hatırlatıcı danışman tarafından onaylandı ve kapatıldı.'
FROM customers c WHERE c.customer_id IN ({OVERDUE_SQL})""", needs=(C, "outcome_patches", "admin_patches", "note_deletions"))
def _audit_from_patches(spark, sf):
    c = cust(spark, sf)
    now = as_of_col()
    dels = fx.note_deletions(spark, sf).select("customer_id", now.alias("patch_ts"), F.lit("Admin").alias("user_name"))
    comp = overdue_reminders(c).select("customer_id", now.alias("patch_ts"), F.col("operator").alias("user_name"))
    return M.audit_from_patches(c, outcomes=fx.outcome_patches(spark, sf), admin=fx.admin_patches(spark, sf),
                                deletions=dels, completions=comp)


# ========================================================= 2.9 streaming
ALERTS_SQL = f"""SELECT r.operator, r.reminder_id, r.due_ts FROM stream_reminders r
  WHERE EXISTS (SELECT 1 FROM poll_ticks t WHERE t.operator = r.operator
    AND t.tick_ts >= r.due_ts - INTERVAL {K.REMINDER_EARLY_S} SECOND
    AND t.tick_ts <= r.due_ts + INTERVAL {K.REMINDER_LATE_S} SECOND)"""


@q("reminder_alerts", ALERTS_SQL, needs=("stream_reminders", "poll_ticks"))
def _reminder_alerts(spark, sf):
    """Batch form: each reminder alerted once by a poll inside its window."""
    return J.reminders_alerted(fx.poll_ticks(spark, sf), fx.stream_reminders(spark, sf))


@q("reminder_alerts_stream", ALERTS_SQL, needs=("stream_reminders", "poll_ticks"))
def _reminder_alerts_stream(spark, sf):
    """Stream form: keyed state with event-time timers over the events file
    source, read back."""
    from ..streaming.reminders import run_reminder_alerts
    return run_reminder_alerts(spark, sf)


LOCK_MAX, LOCK_S = 3, 86400


def lockout_sql(max_attempts=LOCK_MAX, lock_s=LOCK_S):
    """Oracle of the lockout fold: a recursive CTE stepping through each
    user's attempts in (ts, event_id) order."""
    L = lock_s * 1_000_000
    ign = f"(f.a >= {max_attempts} AND e.t_us < f.u)"
    return f"""WITH RECURSIVE
ev AS (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY ts, event_id) AS rn, epoch_us(ts) AS t_us
       FROM auth_events),
fold AS (
  SELECT user_name, rn, event_id, ts,
    CASE WHEN success THEN 'success' WHEN 1 >= {max_attempts} THEN 'locked' ELSE 'failure' END AS outcome,
    CASE WHEN success THEN 0 ELSE 1 END AS a,
    CASE WHEN success THEN 0 ELSE t_us + {L} END AS u
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_name, e.rn, e.event_id, e.ts,
    CASE WHEN {ign} THEN 'ignored' WHEN e.success THEN 'success'
         WHEN f.a + 1 >= {max_attempts} THEN 'locked' ELSE 'failure' END,
    CASE WHEN {ign} THEN f.a WHEN e.success THEN 0 ELSE f.a + 1 END,
    CASE WHEN {ign} THEN f.u WHEN e.success THEN 0 ELSE e.t_us + {L} END
  FROM fold f JOIN ev e ON e.user_name = f.user_name AND e.rn = f.rn + 1)
SELECT event_id, user_name, ts, outcome, CAST(a AS BIGINT) AS attempts FROM fold"""


@q("login_lockout")
def _login_lockout(spark, sf):
    """Per-user ordered fold over login attempts (limits: 3 attempts, one
    day lock, FIXTURES.md §3.2)."""
    from ..streaming.lockout import login_lockout
    return login_lockout(fx.auth_events(spark, sf), LOCK_MAX, LOCK_S)


@q("login_lockout_stream")
def _login_lockout_stream(spark, sf):
    """Stream form: keyed state with event-time timers over the events file
    source, read back."""
    from ..streaming.lockout import run_lockout_stream
    return run_lockout_stream(spark, sf, LOCK_MAX, LOCK_S)


@q("login_lockout_page_limits")
def _login_lockout_page_limits(spark, sf):
    """The login page's own limits: 5 failures, 180 seconds."""
    from ..streaming.lockout import login_lockout
    return login_lockout(fx.auth_events(spark, sf))


ORACLE["login_lockout"] = O.sql(lockout_sql(), ["auth_events"])
ORACLE["login_lockout_page_limits"] = O.sql(lockout_sql(K.MAX_ATTEMPTS, K.LOCKOUT_S), ["auth_events"])
ORACLE["login_lockout_stream"] = ORACLE["login_lockout"]
