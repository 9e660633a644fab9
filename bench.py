"""Benchmark: headline dashboard queries at one scale factor.

Every query runs as registered (the same plan that the correctness check
runs).  A measurement covers building the query and running it with the
``noop`` sink (full execution, nothing collected), so work that a query does
while it is built, such as a stored first pass or a stream, counts.  Each is
run once to warm up and then ``BENCH_REPS`` times, keeping the fastest.
``etl_customers`` is the build of the stored customer table.  Prints one JSON
line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPS (default 2), BENCH_QUERIES (comma list, optional).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dealerlens.plans.queries import QUERIES  # noqa: E402
from dealerlens.session import build_session, scratch_path  # noqa: E402
from dealerlens.sources import fixtures as fx  # noqa: E402

HEADLINE = [
    "kpi_summary", "report_processed", "report_trade_in", "report_warranty", "report_untouched",
    "report_low_quality", "report_test_drive", "report_reminders", "close_reason_dist",
    "vehicle_model_dist", "interest_dist", "channel_dist", "calls_by_staff_30", "reasons_by_staff",
    "team_evaluation", "performance_cube", "daily_goal", "birthdays_today", "birthday_calendar", "customer_geo",
    "map_layers", "global_search", "notes_timeline", "customer_profile", "apply_outcome",
    "apply_admin_edit", "delete_note", "complete_reminder", "audit_from_patches", "reminder_due",
    "due_reminder_first", "reminder_alerts", "login_lockout", "login_lockout_page_limits", "station_feed",
    "latest_snapshot", "reminder_alerts_stream", "login_lockout_stream",
]


def timed(build) -> float:
    """Seconds to build a query and run it."""
    t = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app_name="dealerlens-bench")

    # warm the JVM (class loading, codegen caches) outside the timings
    timed(lambda: fx.read_table(spark, sf_dir, "region").groupBy("r_name").count())

    timings: dict[str, float] = {}
    builds = []
    for _ in range(2):
        t = time.perf_counter()
        fx.materialize_customers(spark, sf_dir, scratch_path(spark, "customers"))
        builds.append(time.perf_counter() - t)
    timings["etl_customers"] = round(min(builds), 4)

    for name in names:
        runs = [timed(lambda fn=QUERIES[name]: fn(spark, sf_dir)) for _ in range(max(reps, 1) + 1)]
        timings[name] = round(min(runs[1:]), 4)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
