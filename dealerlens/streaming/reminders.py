"""Reminder alerts over a stream of landed events.

Poll ticks and reminders are two views of the landed events.  Each reminder is
alerted once, in the micro-batch in which a tick of its operator inside
[due - 300 s, due + 7200 s] and the reminder itself have both landed.

A batch is read once.  Its ticks shrink to their earliest and latest per
operator and time bucket before the shuffle, so a hot operator sends a few rows
a task; an operator's reminders are dealt over ``shares``, each of which sees
all of its operator's extremes.  The shares of all operators are dealt over
``slots``, the keys of the state, so that the work per key doesn't grow with the
number of operators; a slot handles its rows as columns.  State per slot: the
extremes of buckets that the watermark hasn't passed, and reminders not alerted
yet whose window is still open.  An event-time timer clears what no row that is
still in time can need.

Nothing is dropped silently.  Rows that can't count go to a side output, which
``strays`` reads: ticks whose whole bucket lies behind the watermark and
reminders whose event does ('late'), rows without a time, an operator or
(reminders) an id ('no time', 'no operator', 'no id').  Results and side output are parts
of one file sink, so a restart neither loses nor repeats rows."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..operators.joins import BUCKET_S
from ..session import scratch_path
from .landed import events_stream, keyed_state, run_to_end, sink_part

# The task-side code below ships by value, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATENESS_S = 3 * 3600
SHARES = 4
#: Keys of the state; at 36 million events a slot holds about 280,000 extremes
#: of 32 bytes.
SLOTS = 512
ALERT_SCHEMA = "operator string, reminder_id long, due_ts timestamp_ntz"
STRAY_SCHEMA = "reason string, operator string, reminder_id long, first_ts timestamp_ntz, last_ts timestamp_ntz, n long"

SECOND = 1_000_000
BUCKET_US, EARLY_US, LATE_US = (s * SECOND for s in (BUCKET_S, K.REMINDER_EARLY_S, K.REMINDER_LATE_S))
LEAD_US = 3600 * SECOND  # a reminder is due an hour after its event

ROWS = "kind string, operator string, reminder_id long, bucket long, first_us long, last_us long, n long"
OUT = "part string, reason string, operator string, reminder_id long, first_us long, last_us long, n long"
ROW_NAMES, OUT_NAMES = ([f.split()[0] for f in s.split(", ")] for s in (ROWS, OUT))


def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(operator, event_id, ts_us, reminder) rows as ROWS: one 'tick' per
    operator and bucket, one 'due' per reminder, and strays."""
    for pdf in batches:
        if pdf.empty:
            continue
        why = np.select([pdf["ts_us"].isna(), pdf["operator"].isna()], ["no time", "no operator"], "")
        parts = []
        for reason in ("no time", "no operator"):
            bad = pdf[why == reason]
            parts.append(pd.DataFrame({"kind": reason, "operator": bad["operator"], "reminder_id": bad["event_id"],
                                       "bucket": 0, "first_us": bad["ts_us"], "last_us": bad["ts_us"], "n": 1}))
        good = pdf[why == ""]
        t = good["ts_us"].astype("int64")
        ticks = pd.DataFrame({"operator": good["operator"], "bucket": t // BUCKET_US, "t": t})
        ticks = ticks.groupby(["operator", "bucket"], as_index=False).agg(
            first_us=("t", "min"), last_us=("t", "max"), n=("t", "size"))
        parts.append(ticks.assign(kind="tick", reminder_id=None))
        new = good[good["reminder"].eq(True)]
        due = new["ts_us"].astype("int64") + LEAD_US
        kind = np.where(new["event_id"].isna(), "no id", "due")
        parts.append(pd.DataFrame({"kind": kind, "operator": new["operator"], "reminder_id": new["event_id"],
                                   "bucket": (due - EARLY_US) // BUCKET_US, "first_us": due, "last_us": due, "n": 1}))
        out = pd.concat([p[ROW_NAMES] for p in parts if len(p)])
        for c in ("reminder_id", "first_us", "last_us"):
            out[c] = out[c].astype("Int64")
        yield out


def packed(*columns) -> bytes:
    """Equally long columns of integers as one value."""
    return np.array(columns, "<i8").tobytes()


def unpacked(value: bytes, width: int) -> list[list[int]]:
    return np.frombuffer(value, "<i8").reshape(width, -1).tolist()


def _columns(value: bytes, width: int) -> np.ndarray:
    return np.frombuffer(value, "<i8").reshape(width, -1)


def _at(owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """(owner, bucket) as one integer; buckets of any time have 32 bits."""
    return (owner << 33) + bucket + (1 << 32)


def _pushed(owner, bucket, first, last):
    """The columns with one row per (owner, bucket), in that order."""
    key = _at(owner, bucket)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    if not len(starts):
        return owner, bucket, first, last
    own = order[starts]
    return (owner[own], bucket[own], np.minimum.reduceat(first[order], starts), np.maximum.reduceat(last[order], starts))


class Alerts(StatefulProcessor):
    """A slot's operators and their shares of reminders.  The whole state of a
    slot is one value, so a slot costs one read and one write a batch however
    many operators it has: ``owners`` lists their (operator, share), ``extremes``
    and ``open`` hold buckets and waiting reminders, ``of_extremes`` and
    ``of_open`` the owner of each."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState(
            "held", "extremes binary, open binary, timer_ms long, owners string, of_extremes binary, of_open binary")

    def _read(self):
        """(owners, [owner, bucket, first, last], [owner, reminder, due], time of the timer)."""
        held = self.held.get()
        if held is None:
            return [], np.empty((4, 0), np.int64), np.empty((3, 0), np.int64), -1
        known = np.concatenate([_columns(held[4], 1), _columns(held[0], 3)])
        waiting = np.concatenate([_columns(held[5], 1), _columns(held[1], 2)])
        return [tuple(o) for o in json.loads(held[3])], known, waiting, held[2]

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        owners, known, waiting, timer = self._read()
        number = {o: i for i, o in enumerate(owners)}
        ticks, dues = [known], [waiting]
        for pdf in rows:
            first, last = (pdf[c].astype("Int64") for c in ("first_us", "last_us"))
            tick, due = (pdf["kind"].eq(k).to_numpy() for k in ("tick", "due"))
            late = np.zeros(len(pdf), bool)
            late[tick] = (pdf["bucket"].to_numpy()[tick] + 1) * BUCKET_US <= mark
            late[due] = first[due].to_numpy(np.int64) - LEAD_US < mark
            share = pdf["share"].to_numpy(np.int64)
            stray = (late & ~tick) | (late & (share == 0)) | ~(tick | due)  # one share reports a tick
            if stray.any():
                bad = pdf[stray].assign(first_us=first[stray], last_us=last[stray], part="stray")
                bad["reason"] = np.where(late[stray], "late", bad["kind"])
                yield bad[OUT_NAMES].astype({c: "Int64" for c in ("reminder_id", "first_us", "last_us")})
            for rows_of, columns, out in ((tick & ~late, ("bucket", "first_us", "last_us"), ticks),
                                          (due & ~late, ("reminder_id", "first_us"), dues)):
                good = pdf[rows_of]
                code, names = pd.factorize(good["operator"].to_numpy(object))
                pair, pairs = pd.factorize(code.astype(np.int64) * (1 << 31) + share[rows_of])
                place = np.array([number.setdefault((names[p >> 31], int(p & 0x7FFFFFFF)), len(number))
                                  for p in pairs.tolist()], np.int64)
                out.append(np.stack([place[pair] if len(pair) else np.empty(0, np.int64),
                                     *[good[c].to_numpy(np.int64) for c in columns]]))
        owners = list(number)
        known = np.stack(_pushed(*np.concatenate(ticks, axis=1)))
        waiting = np.concatenate(dues, axis=1)
        # a reminder that comes again counts as it came last
        again = pd.DataFrame({"o": waiting[0], "r": waiting[1]}).duplicated(keep="last").to_numpy()
        waiting = waiting[:, ~again]
        # a tick of the window's own bucket from its start on, or one of the next bucket up to its end
        owner, reminder, due = waiting
        b = (due - EARLY_US) // BUCKET_US
        at = _at(known[0], known[1])
        seen = np.zeros(len(due), bool)
        if len(at):
            for step in (0, 1):
                i = np.minimum(np.searchsorted(at, _at(owner, b + step)), len(at) - 1)
                there = at[i] == _at(owner, b + step)
                seen |= there & (known[3][i] >= due - EARLY_US if step == 0 else known[2][i] <= due + LATE_US)
        self._keep(owners, known, waiting[:, ~seen], timer, mark)
        if seen.any():
            out = pd.DataFrame({"part": "alert", "reason": None, "operator": [owners[o][0] for o in owner[seen].tolist()],
                                "reminder_id": reminder[seen], "first_us": due[seen], "last_us": due[seen], "n": 1})
            yield out[OUT_NAMES].astype({c: "Int64" for c in ("reminder_id", "first_us", "last_us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        owners, known, waiting, _ = self._read()
        self._keep(owners, known, waiting, -1, timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame(columns=OUT_NAMES)

    def _keep(self, owners, known, waiting, timer, mark) -> None:
        """Store what rows still in time can need, and set a timer for its end."""
        known = known[:, (known[1] + 1) * BUCKET_US > mark]
        waiting = waiting[:, waiting[2] + LATE_US >= mark]
        if not known.size and not waiting.size:
            self.held.clear()
            return
        ends = np.concatenate([known[1] + 1, (waiting[2] + LATE_US) // BUCKET_US + 1])
        end = int(ends.max()) * BUCKET_US // 1000
        if end > timer:
            self.handle.registerTimer(end)
        used, of = np.unique(np.concatenate([known[0], waiting[0]]), return_inverse=True)
        n = known.shape[1]
        self.held.update((packed(*known[1:]), packed(*waiting[1:]), max(end, timer),
                          json.dumps([owners[o] for o in used.tolist()]), packed(of[:n]), packed(of[n:])))

    def close(self) -> None:
        pass


def run_reminder_alerts(spark: SparkSession, sf_dir: str, base: str | None = None, landing_dir: str | None = None,
                        files_per_trigger: int | None = None, lateness_s: int = LATENESS_S,
                        shares: int = SHARES, slots: int = SLOTS) -> DataFrame:
    """Run the alerts to the end of the landed data; all alerts so far.
    ``base`` holds output, side output and the stream's checkpoint; a later
    call with the same ``base`` goes on from there (with the same ``shares`` and
    ``slots``)."""
    base = base or scratch_path(spark, "reminder_alerts")
    events = events_stream(spark, sf_dir, landing_dir, files_per_trigger)
    rows = (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{lateness_s} seconds")
            .select(F.col("user_id").cast("string").alias("operator"), F.col("event_id").cast("long").alias("event_id"),
                    F.unix_micros("ts").alias("ts_us"), F.coalesce(F.col("event_type") == "signup", F.lit(False)).alias("reminder"))
            .mapInPandas(shrink, ROWS))
    every_share = F.sequence(F.lit(0), F.lit(shares - 1))
    own_share = F.array(F.pmod(F.xxhash64("reminder_id", "first_us"), F.lit(shares)).cast("int"))
    rows = rows.withColumn("share", F.explode(F.when(F.col("kind") == "tick", every_share).otherwise(own_share)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("operator", "share"), F.lit(slots)).cast("int"))
    out = keyed_state(rows, ["slot"], Alerts(), OUT)
    run_to_end(out, base)
    found = sink_part(spark, base, OUT, "alert")
    return found.select("operator", "reminder_id", _ntz("first_us").alias("due_ts"))


def _ntz(us: str):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def strays(spark: SparkSession, base: str) -> DataFrame:
    """The side output: rows that could not count, ``n`` events each."""
    return sink_part(spark, base, OUT, "stray").select(
        "reason", "operator", "reminder_id", _ntz("first_us").alias("first_ts"), _ntz("last_us").alias("last_ts"), "n")
