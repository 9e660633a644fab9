"""Side-by-side check of a Spark result against DuckDB oracle SQL over the
same parquet tables: row count, column names and an order-insensitive
hash of the values.  Used by the tests; results are small by design
(reports over sf0.01)."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

from dealerlens.sources.fixtures import TABLES


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, _dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, _dt.date):
        return v.strftime("%Y-%m-%d")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _canon(v.asDict())
    return str(v)


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(_canon(r[i]) for i in order) for r in rows)


def digest(columns, rows) -> str:
    h = hashlib.sha256()
    for line in canonical_rows(columns, rows):
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest()


def compare(spark_df, oracle_sql: str, con) -> dict:
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(oracle_sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    out = {
        "rows_spark": len(s_rows), "rows_oracle": len(o_rows),
        "columns_match": sorted(s_cols) == sorted(o_cols),
        "columns_spark": s_cols, "columns_oracle": o_cols,
    }
    out["hash_match"] = out["columns_match"] and digest(s_cols, s_rows) == digest(o_cols, o_rows)
    out["ok"] = out["hash_match"] and len(s_rows) == len(o_rows)
    if not out["ok"] and out["columns_match"]:
        a, b = canonical_rows(s_cols, s_rows), canonical_rows(o_cols, o_rows)
        sa, sb = set(a), set(b)
        out["only_spark"] = [x for x in a if x not in sb][:5]
        out["only_oracle"] = [x for x in b if x not in sa][:5]
    return out
