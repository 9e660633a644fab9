"""Distributions and team performance.  Every aggregate is a hash
aggregate with a map-side partial step, so a hot key (one reason or one
operator holding a third of the rows) is pre-counted in every task before
the shuffle moves one row per task and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import goal_met, goal_progress, is_meaningful, parse_ts, ustrip
from ..session import as_of_col
from .segments import seg_called


def _dist(df: DataFrame, column: str, out_name: str, cond=None) -> DataFrame:
    """Count by value, largest first (ties by value).  The sort runs on the
    aggregated rows, one per distinct value."""
    d = df if cond is None else df.where(cond)
    return (d.groupBy(F.col(column).alias(out_name)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(out_name)))


def close_reason_dist(df: DataFrame) -> DataFrame:
    """Count by raw close reason (nulls dropped, blanks kept); a table with
    no reasons at all gives one placeholder row ('Veri Yok', 1)."""
    d = df.where(F.col("close_reason").isNotNull())
    counts = d.groupBy(F.col("close_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    # decided on the aggregated counts (one row per reason): the second use
    # of the same aggregation reuses its shuffle instead of rescanning
    placeholder = (
        counts.agg(F.sum("n").alias("k"))
        .where(F.col("k").isNull())
        .select(F.lit(K.NO_DATA_REASON).alias("reason"), F.lit(1).cast("bigint").alias("n"))
    )
    return counts.unionByName(placeholder).orderBy(F.col("n").desc(), F.col("reason"))


def vehicle_model_dist(df: DataFrame) -> DataFrame:
    return _dist(df, "vehicle_model", "vehicle_model", is_meaningful(F.col("vehicle_model")))


def interest_dist(df: DataFrame) -> DataFrame:
    return _dist(df, "interested_vehicle", "interested_vehicle",
                 is_meaningful(F.col("interested_vehicle")))


def channel_dist(df: DataFrame) -> DataFrame:
    """Contact channels; a table without the column gives no rows."""
    if "contact_channel" not in df.columns:
        return df.sparkSession.createDataFrame([], "contact_channel string, n bigint")
    return _dist(df, "contact_channel", "contact_channel", is_meaningful(F.col("contact_channel")))


def distribution_share(dist: DataFrame, n_col: str = "n") -> DataFrame:
    """Percentage of each slice, against a total that is aggregated to one
    number by a subquery: categories may be free text, so no window gathers
    them in one task."""
    total = dist.agg(F.sum(n_col)).scalar()
    return dist.withColumn("share_pct", F.col(n_col).cast("double") * 100.0 / total)


def called_in_period(df: DataFrame, days: int, as_of=None) -> DataFrame:
    """Calls ('Evet') whose action date is on or after as_of - days (the
    cut-off keeps the time of day, so the boundary day is excluded unless
    as_of is midnight)."""
    cutoff = as_of_col(as_of) - F.make_dt_interval(F.lit(int(days)))
    called = seg_called(df)
    if "action_date" not in df.columns:  # the page shows "no data"
        return called.where(F.lit(False))
    return called.where(parse_ts(F.col("action_date")) >= cutoff)


def calls_by_staff(df: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Calls per operator in the last ``days`` days (no operator column ->
    no rows)."""
    if "operator" not in df.columns:
        return df.sparkSession.createDataFrame([], "operator string, calls bigint")
    return (
        called_in_period(df, days, as_of)
        .where(F.col("operator").isNotNull())
        .groupBy("operator").agg(F.count(F.lit(1)).alias("calls"))
        .orderBy("operator")
    )


def reasons_by_staff(df: DataFrame, staff: str = K.ALL_STAFF) -> DataFrame:
    """Close reasons of the calls, optionally of one staff member (no
    reason column -> no rows)."""
    if "close_reason" not in df.columns:
        return df.sparkSession.createDataFrame([], "reason string, n bigint")
    c = seg_called(df).where(F.col("close_reason").isNotNull() & (F.col("close_reason") != ""))
    if staff != K.ALL_STAFF:
        c = c.where(F.col("operator") == staff)
    return c.groupBy(F.col("close_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def top_reason(df: DataFrame, staff: str = K.ALL_STAFF) -> DataFrame:
    """Most frequent close reason (ties: smallest text).  A min_by
    aggregate over the counted reasons: no global sort."""
    r = reasons_by_staff(df, staff)
    best = F.min_by(F.struct("reason", "n"), F.struct(-F.col("n"), F.col("reason")))
    return r.agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.reason", "b.n")


def staff_list(df: DataFrame) -> DataFrame:
    return seg_called(df).where(F.col("operator").isNotNull()).select("operator").distinct()


def team_evaluation(df: DataFrame, days: int = 30, staff: str = K.ALL_STAFF,
                    as_of=None) -> DataFrame:
    """Period summary: total calls, top close reason, daily average, a
    rating and the page's texts.  No calls in the period at all -> no row."""
    period = called_in_period(df, days, as_of)
    if "close_reason" not in period.columns:
        period = period.withColumn("close_reason", F.lit(None).cast("string"))
    # without an operator column the staff filter is skipped, as on the page
    sel = (F.lit(True) if staff == K.ALL_STAFF or "operator" not in df.columns
           else (F.col("operator") == staff))
    g = (period.withColumn("sel", F.coalesce(sel, F.lit(False)))
         .groupBy("sel", "close_reason").agg(F.count(F.lit(1)).alias("n")))
    return evaluate(g, days, staff)


def evaluate(g: DataFrame, days: int, staff: str) -> DataFrame:
    """Evaluation row from per-(sel, close_reason) call counts of a period
    (sel = the row belongs to the chosen staff member)."""
    valid = F.col("sel") & F.col("close_reason").isNotNull() & (F.col("close_reason") != "")
    agg = g.agg(
        F.sum("n").alias("all_calls"),
        F.coalesce(F.sum(F.when(F.col("sel"), F.col("n"))), F.lit(0)).cast("bigint").alias("total_calls"),
        F.min_by(F.when(valid, F.struct(F.col("close_reason").alias("reason"), F.col("n").cast("bigint").alias("n"))),
                 F.when(valid, F.struct(-F.col("n"), F.col("close_reason")))).alias("top"),
    ).where(F.col("all_calls") > 0)
    avg = F.col("total_calls").cast("double") / float(days) if days > 0 else F.lit(0.0)
    if staff == K.ALL_STAFF:
        rating = F.when(avg > 5, F.lit("active")).otherwise(F.lit("low"))
    else:
        rating = (F.when(avg >= 3, F.lit("very_good")).when(avg >= 1, F.lit("good"))
                  .otherwise(F.lit("needs_work")))
    out = agg.select(
        F.lit(staff).alias("staff"), F.lit(int(days)).alias("days"), "total_calls",
        F.col("top.reason").alias("top_reason"), F.col("top.n").alias("top_count"),
        avg.alias("daily_avg"), rating.alias("rating"),
    )
    total = F.col("total_calls").cast("string")
    comment = None
    for code, text in K.TEAM_COMMENTS.items():
        c = _fill(text, total)
        comment = F.when(F.col("rating") == code, c) if comment is None else comment.when(F.col("rating") == code, c)
    title = (F.lit(K.TEAM_TITLE_ALL) if staff == K.ALL_STAFF
             else F.lit(K.TEAM_TITLE_ONE.replace("{1}", staff)))
    insight = F.when(F.col("top_reason").isNotNull(),
                     _fill(K.TEAM_INSIGHT, F.col("top_reason"), F.col("top_count").cast("string"))
                     ).otherwise(F.lit(K.TEAM_NO_INSIGHT))
    return out.select("*", title.alias("title"), comment.alias("comment"), insight.alias("insight"))


def _fill(template: str, *cols):
    """template with {0}, {1}, ... replaced by columns (concat)."""
    import re
    parts = re.split(r"\{(\d)\}", template)
    pieces = []
    for i, p in enumerate(parts):
        pieces.append(F.lit(p) if i % 2 == 0 else cols[int(p)])
    return F.concat(*pieces)


def daily_counts(df: DataFrame, as_of=None) -> DataFrame:
    """Actions per (trimmed) operator dated today."""
    if "action_date" not in df.columns or "operator" not in df.columns:
        return df.sparkSession.createDataFrame([], "staff_name string, n bigint")
    today = F.date_format(as_of_col(as_of), "yyyy-MM-dd")
    return (df.where(F.col("action_date") == today)
            .groupBy(ustrip(F.coalesce(F.col("operator"), F.lit("None"))).alias("staff_name"))
            .agg(F.count(F.lit(1)).alias("n")))


def daily_goal(df: DataFrame, staff: DataFrame, as_of=None, goal: int = K.DAILY_GOAL) -> DataFrame:
    """Every sales person with today's action count (zero kept), percent of
    the goal and whether it is met."""
    roster = staff.where(F.col("role") == "sales").select("staff_name")
    counts = daily_counts(df, as_of)
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return (roster.join(counts, "staff_name", "left")
            .select("staff_name", n.alias("n"), goal_progress(n, goal).alias("progress_pct"),
                    goal_met(n, goal).alias("goal_met")))


def station_count(stations: DataFrame) -> DataFrame:
    return stations.agg(F.count(F.lit(1)).alias("stations"))
