"""Oracle SQL (DuckDB dialect) for every registered query.

The oracle is written independently of the Spark code: plain SQL over the
same parquet tables (pre-registered as views by the checker).  The fixture
adapter is a set of CTEs; ``sql(body, needs)`` prefixes the ones a query
uses.  Engine differences handled here (SURVEY §4.3): DuckDB lower-cases
'İ' to 'i' (Spark and Python give 'i̇'), ``concat`` skips nulls (use ||),
integer casts round (use trunc/floor), ``sum`` of integers is HUGEINT.
"""

from __future__ import annotations

import re

from .. import constants as K

AS_OF = f"TIMESTAMP '{K.FIXTURE_AS_OF}'"
NL = "chr(10)"


WS = " || ".join(f"chr({ord(c)})" for c in K.WS_CHARS)


def strip(x: str) -> str:
    """Python str.strip(): trim the whitespace character set."""
    return f"trim({x}, {WS})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WS})"


def lower(x: str) -> str:
    """Spark/Python lower-case of text (dotted capital I kept as i + dot)."""
    return f"lower(replace({x}, 'İ', 'i̇'))"


def as_text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def norm_token(x: str) -> str:
    return lower(strip(as_text(x)))


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def to_number(x: str, default: str | None = None) -> str:
    v = f"TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)"
    num = (f"CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{K.NUMERIC_PATTERN}') "
           f"AND (NOT isinf({v}) OR contains(lower(CAST({x} AS VARCHAR)), 'inf')) THEN {v} END")
    return num if default is None else f"coalesce({num}, CAST({default} AS DOUBLE))"


_STRPTIME = {
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S",
    "yyyy-MM-dd'T'HH:mm": "%Y-%m-%dT%H:%M",
    "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M",
    "yyyy-MM-dd": "%Y-%m-%d",
    "dd.MM.yyyy": "%d.%m.%Y",
}


def parse_ts(x: str) -> str:
    parts = [f"try_strptime(CAST({x} AS VARCHAR), '{_STRPTIME[f]}')" for f in K.DATE_FORMATS]
    return "CAST(coalesce(" + ", ".join(parts) + ") AS TIMESTAMP)"


def format_date(x: str) -> str:
    return f"coalesce(strftime({parse_ts(x)}, '%d-%m-%Y'), '-')"


def is_meaningful(x: str, reject_dash: bool = True) -> str:
    cond = f"({x} IS NOT NULL AND {strip(x)} <> '' AND {lower(x)} <> 'nan'"
    if reject_dash:
        cond += f" AND {x} <> '-'"
    return cond + ")"


def last_note_ts(x: str) -> str:
    found = f"regexp_extract_all({x}, '{K.NOTE_TS_PATTERN}')"
    return (f"CAST(try_strptime(CASE WHEN len({found}) > 0 THEN {found}[-1] END, "
            f"'%d.%m.%Y %H:%M') AS TIMESTAMP)")


def normalize_city(x: str) -> str:
    return f"translate(upper({strip(as_text(x))}), '{K.CITY_FROM}', '{K.CITY_TO}')"


def lp(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


# --------------------------------------------------------------------------
# Fixture adapter as CTEs (FIXTURES.md §3)
# --------------------------------------------------------------------------

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, needs=()):
    CTES[name] = (body, list(needs))


cte("last_order", """
  SELECT o_custkey, max(o_orderdate) AS last_orderdate,
         arg_max(o_orderpriority, o_orderkey) AS pr
  FROM orders GROUP BY o_custkey""")

cte("conv_notes", f"""
  SELECT conv_id,
         string_agg(strftime(TIMESTAMP '2001-06-01 09:00:00' + to_days(CAST(conv_id % 60 AS INTEGER))
                             + to_hours(CAST(turn AS INTEGER)), '%d.%m.%Y %H:%M')
                    || ' | ' || role || ' | ' || translate(text, {NL} || '|', ' /'),
                    {NL} ORDER BY turn) AS notes
  FROM conversations GROUP BY conv_id""")

cte("customers", f"""
  SELECT c.c_custkey AS customer_id,
    c.c_name AS full_name,
    CASE c.c_custkey % 6 WHEN 0 THEN '+90 532 ' || {lp('c.c_custkey', 7)}
      WHEN 1 THEN '532' || {lp('c.c_custkey', 7)} WHEN 2 THEN '0532' || {lp('c.c_custkey', 7)}
      WHEN 3 THEN '12345' WHEN 4 THEN '' ELSE NULL END AS phone,
    CASE WHEN lo.pr LIKE '5%' THEN 'Bilgi Verildi' WHEN lo.pr LIKE '4%' THEN NULL
      WHEN lo.pr LIKE '3%' THEN '' WHEN lo.pr LIKE '2%' THEN 'Olumlu' ELSE 'Kararsız' END AS close_reason,
    CASE c.c_custkey % 8 WHEN 0 THEN 'Evet' WHEN 1 THEN 'Evet' WHEN 2 THEN ' YES ' WHEN 3 THEN '1'
      WHEN 4 THEN 'Hayır' WHEN 5 THEN 'HAYIR' WHEN 6 THEN '' ELSE NULL END AS called_flag,
    CASE WHEN c.c_custkey % 10 = 9 THEN NULL
      WHEN c.c_custkey % 10 = 8 THEN ' Supplier#' || {lp('c.c_custkey % 3', 9)} || ' '
      ELSE 'Supplier#' || {lp('c.c_custkey % 4', 9)} END AS operator,
    strftime(lo.last_orderdate, '%Y-%m-%d') AS action_date,
    CASE c.c_custkey % 5
      WHEN 0 THEN strftime(CASE WHEN c.c_custkey % 10 = 0 THEN {AS_OF} - to_minutes(CAST(c.c_custkey % 120 AS INTEGER))
        ELSE TIMESTAMP '2001-08-01 00:00:00' + to_hours(CAST(c.c_custkey % 48 AS INTEGER)) END, '%Y-%m-%dT%H:%M')
      WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'bad' ELSE NULL END AS reminder_at,
    n.notes,
    CASE WHEN c.c_custkey % 17 = 0 THEN 'n/a'
      ELSE CAST(CAST(floor(c.c_acctbal * 20) AS BIGINT) AS VARCHAR) END AS odometer_km,
    CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE CAST(2001 - p.p_size % 12 AS VARCHAR) END AS model_year,
    CASE c.c_custkey % 9 WHEN 0 THEN 'Yapıldı' WHEN 1 THEN ' YAPILDI ' WHEN 2 THEN 'Bekliyor'
      ELSE NULL END AS test_drive_status,
    CASE WHEN c.c_custkey % 23 = 0 THEN ''
      ELSE strftime(DATE '1960-02-01' + CAST((c.c_custkey * 37) % 15000 AS INTEGER), '%Y-%m-%d') END AS birth_date,
    CASE WHEN c.c_custkey % 11 = 0 THEN '-' WHEN c.c_custkey % 13 = 0 THEN NULL
      ELSE p.p_type END AS vehicle_model,
    CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE p.p_brand END AS interested_vehicle,
    c.c_mktsegment AS contact_channel,
    CASE c.c_nationkey % 8 WHEN 0 THEN 'İstanbul' WHEN 1 THEN 'ankara' WHEN 2 THEN ' İZMİR '
      WHEN 3 THEN 'Mersin' WHEN 4 THEN 'Bursa' WHEN 5 THEN '-' WHEN 6 THEN 'Konya'
      ELSE NULL END AS city
  FROM customer c
  LEFT JOIN part p ON c.c_custkey = p.p_partkey
  LEFT JOIN last_order lo ON c.c_custkey = lo.o_custkey
  LEFT JOIN conv_notes n ON c.c_custkey = n.conv_id""", ["last_order", "conv_notes"])

cte("staff", """
  SELECT s_name AS staff_name,
         CASE WHEN s_suppkey % 25 = 24 THEN 'admin' ELSE 'sales' END AS role
  FROM supplier""")

cte("outcome_patches", f"""
  SELECT o_orderdate + to_hours(9) + to_minutes(CAST(o_orderkey % 480 AS INTEGER)) AS patch_ts,
    o_orderkey AS seq,
    o_custkey AS customer_id,
    'Supplier#' || {lp('o_orderkey % 4', 9)} AS user_name,
    CASE o_orderstatus WHEN 'F' THEN 'Olumlu' WHEN 'O' THEN 'Kararsız' END AS reason,
    CASE o_orderkey % 3 WHEN 1 THEN ''
      WHEN 2 THEN strftime(o_orderdate + to_days(2) + to_hours(10), '%Y-%m-%dT%H:%M') END AS reminder,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS note
  FROM orders""")

cte("admin_patches", f"""
  SELECT {AS_OF} AS patch_ts, c_custkey AS seq, c_custkey AS customer_id, 'Admin' AS user_name,
    upper(c_name) AS full_name,
    CASE WHEN c_acctbal >= 0 THEN '0532 ' || {lp('c_custkey', 7)} END AS phone,
    CASE WHEN c_acctbal > 5000 THEN 'Olumlu' ELSE '' END AS close_reason,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Bilgiler güncellendi' END AS note
  FROM customer WHERE c_mktsegment = 'BUILDING'""")

cte("note_deletions", """
  SELECT DISTINCT conv_id AS customer_id, CAST(conv_id % 4 AS INTEGER) AS line_idx
  FROM conversations""")

cte("system_logs", """
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS log_ts, CAST(user_id AS VARCHAR) AS user_name,
         event_type AS action_type, props AS detail
  FROM events""")

cte("auth_events", """
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS VARCHAR) AS user_name,
         event_type = 'signup' AS success
  FROM events WHERE event_type IN ('error', 'signup')""")

cte("poll_ticks", """
  SELECT CAST(ts AS TIMESTAMP) AS tick_ts, CAST(user_id AS VARCHAR) AS operator FROM events""")

cte("stream_reminders", """
  SELECT event_id AS reminder_id, CAST(user_id AS VARCHAR) AS operator,
         CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS due_ts
  FROM events WHERE event_type = 'signup'""")

cte("cities", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', CAST({la} AS DOUBLE), CAST({lo} AS DOUBLE))" for c, la, lo in K.CITIES
) + ") AS t(city_key, lat, lon)")

cte("stations_raw", f"""
  SELECT s_suppkey, s_name, s_nationkey, snapshot_id,
    CASE WHEN snapshot_id = 4 THEN CAST(10 AS DOUBLE) ELSE CAST(35 + s_suppkey % 9 AS DOUBLE) END AS lat, CAST(24 + s_suppkey % 23 AS DOUBLE) AS lon,
    CASE WHEN s_suppkey % 5 = 0 THEN 'fuel' ELSE '{K.STATION_AMENITY}' END AS amenity,
    CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS t_operator,
    CASE s_suppkey % 4 WHEN 0 THEN 'BRAND-' || CAST(s_nationkey AS VARCHAR) WHEN 1 THEN '' END AS t_brand,
    CASE s_suppkey % 4 WHEN 0 THEN 'st-' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'st-' || CAST(s_suppkey AS VARCHAR)
      WHEN 2 THEN 'istasyon ' || CAST(s_suppkey AS VARCHAR) END AS t_name
  FROM (SELECT *, s_nationkey % 3 AS snapshot_id FROM supplier
        UNION ALL SELECT *, 4 FROM supplier WHERE s_suppkey % 10 = 0)""")

cte("stations", f"""
  SELECT snapshot_id, lat, lon,
    upper(coalesce(t_operator, t_brand, t_name, '{K.UNKNOWN_STATION}')) AS station_name
  FROM stations_raw
  WHERE amenity = '{K.STATION_AMENITY}'
    AND lat BETWEEN {K.STATION_LAT[0]} AND {K.STATION_LAT[1]}
    AND lon BETWEEN {K.STATION_LON[0]} AND {K.STATION_LON[1]}""", ["stations_raw"])


def sql(body: str, needs=()) -> str:
    """Prefix ``body`` with the adapter CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    body = body.strip()
    if not order:
        return body
    head = "WITH "
    ctes = ",\n".join(f"{n} AS ({CTES[n][0]}\n)" for n in order)
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        head = "WITH RECURSIVE " if m.group(1) else "WITH "
        return head + ctes + ",\n" + body[m.end():]
    return head + ctes + "\n" + body
