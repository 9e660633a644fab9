"""Report column lists and the report pipeline
(segment -> derive -> format dates -> project)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import format_dates

# FIXED VALUES: display and export column order per report.
REPORT_COLUMNS = {
    "processed": ["customer_id", "action_date", "full_name", "phone", "contact_channel",
                  "vehicle_model", "interested_vehicle", "close_reason", "notes", "operator"],
    "trade_in": ["customer_id", "action_date", "full_name", "phone", "contact_channel",
                 "vehicle_model", "odometer_km", "model_year", "interested_vehicle", "notes", "operator"],
    "warranty": ["customer_id", "action_date", "full_name", "phone", "contact_channel",
                 "vehicle_model", "odometer_km", "model_year", "warranty_label",
                 "interested_vehicle", "notes", "operator"],
    "untouched": ["customer_id", "action_date", "full_name", "phone", "contact_channel",
                  "called_flag", "close_reason", "notes", "operator"],
    "low_quality": ["customer_id", "action_date", "full_name", "contact_channel", "close_reason"],
    "test_drive": ["customer_id", "action_date", "full_name", "phone", "contact_channel",
                   "interested_vehicle", "called_flag", "close_reason", "notes", "operator"],
    "reminders": ["customer_id", "reminder_at", "full_name", "phone", "contact_channel",
                  "close_reason", "notes", "operator"],
    "logs": ["log_ts", "user_name", "action_type", "detail"],
}
EXPORT_COLUMNS = dict(REPORT_COLUMNS)
EXPORT_COLUMNS["reminders"] = ["customer_id", "full_name", "phone", "contact_channel",
                               "reminder_at", "operator", "notes"]
EXPORT_COLUMNS["logs"] = None  # all columns
EXPORT_COLUMNS["general"] = ["customer_id", "full_name", "phone", "contact_channel",
                             "vehicle_model", "occupation", "city", "close_reason"]


def project(df: DataFrame, columns) -> DataFrame:
    """Ordered projection onto the listed columns that exist (all columns
    when the list is None or none of them exists)."""
    if columns is None:
        return df
    keep = [c for c in columns if c in df.columns]
    return df.select(*keep) if keep else df


def report_view(df: DataFrame, report: str) -> DataFrame:
    """Display table of one report: date columns as dd-MM-yyyy, then the
    report's columns."""
    return project(format_dates(df), REPORT_COLUMNS[report])


def report_frame(customers: DataFrame, report: str, as_of=None) -> DataFrame:
    """Full record set behind a report page (all columns, derived ones
    included, dates formatted) — what the page search runs over."""
    from ..operators import segments as S
    builders = {
        "processed": S.processed_archive,
        "trade_in": S.seg_trade_in,
        "warranty": lambda d: S.with_warranty_label(S.seg_warranty(d, as_of), as_of),
        "untouched": S.seg_untouched,
        "low_quality": S.seg_low_quality,
        "test_drive": S.seg_test_drive,
        "reminders": S.reminder_list,
    }
    return format_dates(builders[report](customers))


def report(customers: DataFrame, report_name: str, as_of=None) -> DataFrame:
    return project(report_frame(customers, report_name, as_of), REPORT_COLUMNS[report_name])
