"""Every registered query against its DuckDB oracle at sf0.01 (row count,
column names, order-insensitive value hash)."""

import pytest

from paths import SF01
from compare import compare
from dealerlens.plans.queries import ORACLE, QUERIES


def test_registry_covers_inventory():
    inventory = {
        # 2.1 sources and sinks
        "load_customers", "schema_gate", "load_with_fallback", "strip_headers", "rebuild_table",
        "audit_append", "audit_log", "station_feed", "latest_snapshot", "report_export",
        # 2.2 scalars
        "norm_token", "to_number", "safe_col", "parse_date", "format_dates", "format_reminder",
        "is_meaningful", "clean_display", "format_phone", "normalize_city", "last_note_ts",
        "warranty_label", "warranty_status", "goal_progress", "customer_tooltip", "map_hover",
        "geo_jitter", "station_name", "note_line",
        # 2.3 segments
        "report_view", "seg_processed", "seg_trade_in", "seg_warranty", "seg_untouched",
        "seg_low_quality", "seg_test_drive", "seg_called", "reminder_list", "birthdays_today",
        "birthdays_month", "mappable_customers", "global_search", "customer_profile", "notes_timeline",
        # 2.4 joins
        "customer_geo", "daily_goal", "birthday_calendar", "apply_outcome", "apply_admin_edit",
        "reminder_pending", "reminder_due",
        # 2.5 aggregates
        "kpi_summary", "close_reason_dist", "vehicle_model_dist", "interest_dist", "channel_dist",
        "calls_by_staff_7", "calls_by_staff_30", "calls_by_staff_365", "reasons_by_staff",
        "distribution_share", "staff_list", "team_evaluation", "station_count",
        # 2.7 ordering
        "processed_archive", "top_reason", "page", "due_reminder_first", "map_layers",
        # 2.8 mutations
        "append_note", "delete_note", "complete_reminder", "audit_from_patches",
        # 2.9 streaming
        "reminder_alerts", "reminder_alerts_stream", "login_lockout", "login_lockout_stream",
    }
    assert inventory <= set(QUERIES), sorted(inventory - set(QUERIES))
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck01, name):
    df = QUERIES[name](spark, SF01)
    r = compare(df, ORACLE[name], duck01)
    assert r["columns_match"], (r["columns_spark"], r["columns_oracle"])
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["hash_match"], {k: v for k, v in r.items() if k.startswith("only")}
