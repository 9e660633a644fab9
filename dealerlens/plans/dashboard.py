"""Page-level plans that share work between widgets.

The team performance page shows calls per staff member (7/30/365 days),
close reasons per staff member and an evaluation text.  Instead of three
scans of the customer table, the called rows are aggregated once into a
small cube — one row per (operator, close reason, period flags) — and every
widget is a tiny aggregate over it.  The cube has at most
#operators × #reasons × 4 rows (the periods nest), independent of the
table size, so keeping it cached is cheap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse_ts
from ..operators.segments import seg_called
from ..session import as_of_col


def _calls(df: DataFrame) -> DataFrame:
    """(operator, close_reason, action_at) of the 'Evet' rows."""
    for c in ("operator", "close_reason", "action_date"):  # missing -> no data
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return seg_called(df).select("operator", "close_reason", parse_ts(F.col("action_date")).alias("action_at"))


def _in_periods(calls: DataFrame, as_of, periods, *kept: str) -> DataFrame:
    now, action = as_of_col(as_of), F.col("action_at")
    flags = [F.coalesce(action >= now - F.make_dt_interval(F.lit(int(d))), F.lit(False)).alias(f"in_{d}d")
             for d in periods]
    return calls.select("operator", "close_reason", *flags, *kept)


def performance_cube(df: DataFrame, as_of=None, periods=K.PERIODS) -> DataFrame:
    """(operator, close_reason, in_7d, in_30d, in_365d, n) over the
    'Evet' rows; one scan, map-side combined."""
    c = _in_periods(_calls(df), as_of, periods)
    return c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n"))


def call_counts(df: DataFrame) -> DataFrame:
    """(operator, close_reason, action_at, n): the partial aggregate that is
    stored and moved on by changes instead of being counted anew.  It holds for
    every evaluation time.  The dashboard stores dates, so ``action_at`` is a
    day; a table with times of day is counted by those, and stays exact."""
    c = _calls(df)
    return c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n"))


def moved_counts(counts: DataFrame, base: DataFrame, patches: DataFrame,
                 update: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The counts after ``update(base, patches)``: what the patched customers
    counted for before is taken back, what they count for now is added.  ``base``
    is the table before the change, or any part of it that holds the patched
    keys (``KeyedTable.touching``); no other customer is counted."""
    before = base.join(patches.select("customer_id").distinct(), "customer_id", "left_semi").select(base.columns)
    gone = call_counts(before).withColumn("n", -F.col("n"))
    parts = counts.unionByName(gone).unionByName(call_counts(update(before, patches)))
    return (parts.groupBy("operator", "close_reason", "action_at").agg(F.sum("n").alias("n"))
            .where(F.col("n") != 0))


def cube_of_counts(counts: DataFrame, as_of=None, periods=K.PERIODS) -> DataFrame:
    """``performance_cube`` of the table that ``counts`` was taken from."""
    c = _in_periods(counts, as_of, periods, "n")
    return c.groupBy(*[x for x in c.columns if x != "n"]).agg(F.sum("n").alias("n"))


class TeamPerformance:
    """The three widgets of the performance page from one cached cube."""

    def __init__(self, df: DataFrame, as_of=None):
        self._keep(performance_cube(df, as_of), "operator" in df.columns)

    @classmethod
    def from_counts(cls, counts: DataFrame, as_of=None) -> TeamPerformance:
        """The page from stored ``call_counts`` of a table with operators."""
        self = cls.__new__(cls)
        self._keep(cube_of_counts(counts, as_of), True)
        return self

    def _keep(self, cube: DataFrame, has_operator: bool) -> None:
        self.has_operator = has_operator
        self.cube = cube.persist(StorageLevel.MEMORY_AND_DISK)

    def calls_by_staff(self, days: int = 30) -> DataFrame:
        return (self.cube.where(F.col(f"in_{days}d") & F.col("operator").isNotNull())
                .groupBy("operator").agg(F.sum("n").alias("calls")).orderBy("operator"))

    def reasons_by_staff(self, staff: str = K.ALL_STAFF) -> DataFrame:
        c = self.cube.where(F.col("close_reason").isNotNull() & (F.col("close_reason") != ""))
        if staff != K.ALL_STAFF:
            c = c.where(F.col("operator") == staff)
        return (c.groupBy(F.col("close_reason").alias("reason")).agg(F.sum("n").alias("n"))
                .orderBy(F.col("n").desc(), F.col("reason")))

    def staff_list(self) -> DataFrame:
        return self.cube.where(F.col("operator").isNotNull()).select("operator").distinct()

    def evaluation(self, days: int = 30, staff: str = K.ALL_STAFF) -> DataFrame:
        from ..operators.aggregates import evaluate
        period = self.cube.where(F.col(f"in_{days}d"))
        sel = (F.lit(True) if staff == K.ALL_STAFF or not self.has_operator
               else (F.col("operator") == staff))
        g = (period.withColumn("sel", F.coalesce(sel, F.lit(False)))
             .groupBy("sel", "close_reason").agg(F.sum("n").alias("n")))
        return evaluate(g, days, staff)

    def close(self) -> None:
        self.cube.unpersist()
