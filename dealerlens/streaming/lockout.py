"""Login lockout as an ordered per-user fold.

Per user, attempts in time order: while attempts >= max and the event is
before the unlock time, the event is ignored (even a right password); a
success clears the state; a failure adds one attempt and sets unlock =
now + lock.  Attempts do not reset when a lock expires, so the next failure
locks again.  Ignored events leave the state untouched, which makes this a
sequential fold rather than a window count.  Only "at the limit" changes
behaviour, so the fold's state is (attempts in 0..max, unlock time); the full
attempts count, which goes on past the limit, is added from the outcomes.

Batch form — a two-pass parallel scan, exact for any lock length and
skew:

1. Events are range-partitioned on (user, ts, event_id), so one user's
   events may span many chunks; each chunk is sorted.
2. Pass 1 follows every entry class of each (user, chunk) run at once:
   attempts 0..max-1, or "at the limit, locked until u" for u up to one
   lock span after the run's first event (the classes are intervals
   between event times).  Equal states merge (union-find), so the cost per
   event is the number of distinct live states.  The run's transfer
   function (entry class -> exit state, intervals run-length compressed) is
   written as one summary row; where all trajectories merged, outcomes are
   final already.
3. A stitch walks each user's summaries in chunk order (at most one row per
   chunk) and yields every run's true entry state.
4. Pass 2 re-folds the unresolved prefixes of the runs from their entry
   states, in parallel.

4'. The count of failures since the last success composes over chunks as
"reset, then k" or "plus k", so it is summed per chunk, carried over one row
per chunk and user, and added back.

Stream form: keyed state per user.  A batch's events are appended to the
user's list; an event-time timer releases those that the watermark (newest
event less the lateness) has passed, and they are folded in event-time order
from where the user stands.  A success removes that standing.  The fold jumps
over what one lock ignores and over runs of successes as arrays, so a user
under attack costs a few steps per lock, not one per attempt.  Attempts behind
the watermark, or without a time, go to the side output.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..session import scratch_path
from .landed import events_stream, keyed_state, run_to_end, sink_part, state_of

# The task-side functions below ship by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT_SCHEMA = "event_id long, user_name string, ts timestamp_ntz, outcome string, attempts long"
STATE_SCHEMA = "user_name string, attempts long, unlock_us long"
NO_LOCK = -(1 << 62)  # "unlock time irrelevant"
NO_ID = -(1 << 63)  # stands for a null event id inside the scan; sorts first as null does


def step(a: int, u: int, t: int, success: bool, max_attempts: int, lock_us: int):
    """One event: returns (a, u, outcome)."""
    if a >= max_attempts and t < u:
        return a, u, "ignored"
    if success:
        return 0, NO_LOCK, "success"
    a = min(a + 1, max_attempts)
    return a, (t + lock_us if a >= max_attempts else NO_LOCK), ("locked" if a >= max_attempts else "failure")


def fold_user(t_us: np.ndarray, success: np.ndarray, a: int, u: int, max_attempts: int, lock_us: int):
    """Fold one user's sorted events from state (a, u).  Returns outcomes,
    attempts after each event and the final (a, u)."""
    n = len(t_us)
    outcome = np.empty(n, dtype=object)
    attempts = np.empty(n, dtype=np.int64)
    for i in range(n):
        a, u, outcome[i] = step(a, u, int(t_us[i]), bool(success[i]), max_attempts, lock_us)
        attempts[i] = a
    return outcome, attempts, a, u


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


# ---------------------------------------------------------------------------
# Two-pass parallel scan: per-chunk transfer summaries, a stitch over the
# summaries, then a re-fold of every chunk from its known entry state.
# ---------------------------------------------------------------------------

SUMMARY_SCHEMA = ("kind string, event_id long, user_name string, ts timestamp_ntz, success boolean, "
                  "outcome string, attempts long, chunk_ts long, chunk_eid long, c_a array<long>, "
                  "c_u array<long>, g_upper array<long>, g_a array<long>, g_u array<long>")
ENTRY_SCHEMA = "user_name string, chunk_ts long, chunk_eid long, entry_a long, entry_u long"


class _Transfer:
    """Exit state of one user's run inside a chunk as a function of its
    entry state.  Entry classes: attempts c in 0..max-1 (unlock time
    irrelevant), and 'at the limit, locked until u' for u up to one lock
    span after the run's first event — such an entry starts counting at
    the first event at or after u, so the classes are the intervals
    (t_{j-1}, t_j] of event times.  Trajectories are followed together;
    equal states merge (union-find), so the work per event is the number
    of distinct live states, small even when lock phases never realign."""

    def __init__(self, t0: int, max_attempts: int, lock_us: int):
        self.M, self.L = max_attempts, lock_us
        self.horizon = t0 + lock_us
        self.pending = True
        self.parent: list[int] = []
        self.states: dict = {}
        self.c_tid = []
        for c in range(max_attempts):
            tid = self._new()
            self.states[(c, NO_LOCK)] = tid
            self.c_tid.append(tid)
        self.g: list[tuple[int, int]] = []  # (upper bound t_j, trajectory id)
        self.merged = False  # one live state left and no entry class pending

    def _new(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def _find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def feed(self, t: int, success: bool):
        """Advance all trajectories; once they have merged, the event's
        final (outcome, attempts), else None."""
        M, L = self.M, self.L
        if self.merged:
            ((a, u), tid), = self.states.items()
            a, u, o = step(a, u, t, success, M, L)
            self.states = {(a, u): tid}
            return o, a
        if self.pending:  # entries locked until a time in (previous event, t]
            key = (M, NO_LOCK)
            if key not in self.states:
                self.states[key] = self._new()
            self.g.append((t, self.states[key]))
        nxt: dict = {}
        for (a, u), tid in self.states.items():
            if a >= M and u <= t:
                u = NO_LOCK
            a, u, _ = step(a, u, t, success, M, L)
            if (a, u) in nxt:
                self.parent[self._find(tid)] = self._find(nxt[(a, u)])
            else:
                nxt[(a, u)] = self._find(tid)
        self.states = nxt
        self.pending = t < self.horizon
        self.merged = not self.pending and len(nxt) == 1
        return None

    def summary(self):
        final = {self._find(tid): st for st, tid in self.states.items()}
        c_exit = [final[self._find(tid)] for tid in self.c_tid]
        g_upper, g_exit = [], []
        for t, tid in self.g:  # consecutive classes with the same exit -> one run
            ex = final[self._find(tid)]
            if g_exit and g_exit[-1] == ex:
                g_upper[-1] = t
            else:
                g_upper.append(t)
                g_exit.append(ex)
        return c_exit, g_upper, g_exit


def _summarize(max_attempts: int, lock_us: int):
    """Pass 1: tag every event with its run's chunk key and emit one
    transfer summary per (user, chunk) run."""
    def run(batches):
        cur, user, key = None, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            users = pdf["user_name"].to_numpy()
            t_us = _micros(pdf["ts"])
            eids = pdf["event_id"].to_numpy()
            succ = pdf["success"].eq(True).to_numpy()
            ck_ts = np.empty(len(pdf), dtype=np.int64)
            ck_eid = np.empty(len(pdf), dtype=np.int64)
            outcome = np.full(len(pdf), None, dtype=object)
            attempts = np.full(len(pdf), None, dtype=object)
            summaries = []
            for i in range(len(pdf)):
                if users[i] != user:
                    if cur is not None:
                        summaries.append(_summary_row(user, key, cur))
                    user, key = users[i], (int(t_us[i]), int(eids[i]))
                    cur = _Transfer(int(t_us[i]), max_attempts, lock_us)
                res = cur.feed(int(t_us[i]), bool(succ[i]))
                if res is not None:
                    outcome[i], attempts[i] = res
                ck_ts[i], ck_eid[i] = key
            none = pd.Series([None] * len(pdf), dtype=object)
            yield pd.DataFrame({"kind": "event", "event_id": pdf["event_id"], "user_name": pdf["user_name"],
                                "ts": pdf["ts"], "success": pdf["success"], "outcome": outcome,
                                "attempts": attempts, "chunk_ts": ck_ts, "chunk_eid": ck_eid,
                                "c_a": none, "c_u": none, "g_upper": none, "g_a": none, "g_u": none})
            if summaries:
                yield _summary_frame(summaries)
        if cur is not None:
            yield _summary_frame([_summary_row(user, key, cur)])
    return run


def _summary_row(user, key, t: _Transfer):
    c_exit, g_upper, g_exit = t.summary()
    return {"kind": "summary", "user_name": user, "chunk_ts": key[0], "chunk_eid": key[1],
            "c_a": [a for a, _ in c_exit], "c_u": [u for _, u in c_exit],
            "g_upper": g_upper, "g_a": [a for a, _ in g_exit], "g_u": [u for _, u in g_exit]}


def _summary_frame(rows):
    df = pd.DataFrame(rows, columns=["kind", "event_id", "user_name", "ts", "success", "outcome", "attempts",
                                     "chunk_ts", "chunk_eid", "c_a", "c_u", "g_upper", "g_a", "g_u"])
    df["event_id"] = pd.Series([None] * len(df), dtype="Int64")
    df["attempts"] = pd.Series([None] * len(df), dtype="Int64")
    df["outcome"] = pd.Series([None] * len(df), dtype=object)
    df["ts"] = pd.Series([pd.NaT] * len(df), dtype="datetime64[us]")
    df["success"] = pd.Series([None] * len(df), dtype="boolean")
    return df


def _stitch(max_attempts: int):
    """Per user, over its chunk summaries in chunk order (at most one per
    chunk, arriving sorted): the true entry state of every chunk.  The
    state carries across Arrow batches."""
    def run(batches):
        user, a, u = None, 0, NO_LOCK
        for pdf in batches:
            if pdf.empty:
                continue
            ea = np.empty(len(pdf), dtype=np.int64)
            eu = np.empty(len(pdf), dtype=np.int64)
            for i, r in enumerate(pdf.itertuples(index=False)):
                if r.user_name != user:
                    user, a, u = r.user_name, min(int(r.init_a), max_attempts), int(r.init_u)
                ea[i], eu[i] = a, u
                if a < max_attempts:
                    a, u = int(r.c_a[a]), int(r.c_u[a])
                else:
                    for k, upper in enumerate(r.g_upper):
                        if u <= upper:
                            a, u = int(r.g_a[k]), int(r.g_u[k])
                            break
                    # u beyond every class: the whole run fell inside the lock
            yield pd.DataFrame({"user_name": pdf["user_name"], "chunk_ts": pdf["chunk_ts"],
                                "chunk_eid": pdf["chunk_eid"], "entry_a": ea, "entry_u": eu})
    return run


def _refold(max_attempts: int, lock_us: int):
    """Pass 2: each (user, chunk) run folded from its entry state."""
    def run(batches):
        key, a, u = None, 0, NO_LOCK
        for pdf in batches:
            if pdf.empty:
                continue
            users = pdf["user_name"].to_numpy()
            cks, cke = pdf["chunk_ts"].to_numpy(), pdf["chunk_eid"].to_numpy()
            ea, eu = pdf["entry_a"].to_numpy(), pdf["entry_u"].to_numpy()
            t_us = _micros(pdf["ts"])
            succ = pdf["success"].eq(True).to_numpy()
            outcome = np.empty(len(pdf), dtype=object)
            attempts = np.empty(len(pdf), dtype=np.int64)
            for i in range(len(pdf)):
                k = (users[i], cks[i], cke[i])
                if k != key:
                    key, a, u = k, int(ea[i]), int(eu[i])
                a, u, outcome[i] = step(a, u, int(t_us[i]), bool(succ[i]), max_attempts, lock_us)
                attempts[i] = a
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_name": pdf["user_name"], "ts": pdf["ts"],
                                "outcome": outcome, "attempts": attempts})
    return run


def user_key(events: DataFrame) -> DataFrame:
    """Attempts keyed as the page keys them: user name stripped and
    lower-cased; an attempt without a user name is not counted."""
    from ..functions import ustrip
    return (events.withColumn("user_name", F.lower(ustrip(F.col("user_name"))))
            .where(F.col("user_name").isNotNull() & (F.col("user_name") != "")))


def attempts(events: DataFrame) -> DataFrame:
    """Login attempts that count: with a user name and a time."""
    return user_key(events).select("event_id", "ts", "user_name", "success").where(F.col("ts").isNotNull())


def login_lockout(events: DataFrame, max_attempts: int = K.MAX_ATTEMPTS,
                  lock_s: int = K.LOCKOUT_S, chunks: int | None = None,
                  state: DataFrame | None = None) -> DataFrame:
    """Outcome of every attempt: success / failure / locked (a failure that
    reaches the limit) / ignored (arrived while locked), with the failures
    since the last success after it.
    ``events``: event_id, ts (timestamp_ntz), user_name, success.
    ``state`` (user_name, attempts, unlock_us): where users stand before the
    first event; users without a row stand at none.

    Pass 1 folds each range chunk of (user, ts) from every entry class at
    once and writes a transfer summary per (user, chunk) run (outcomes are
    final already where the trajectories merged); a stitch over the
    summaries — at most one row per chunk and user — gives each run its
    true entry state; pass 2 re-folds only the unresolved prefixes, in
    parallel.  Pass 1's rows are stored by kind, so that each of the three
    readers reads its own."""
    spark = events.sparkSession
    lock_us = lock_s * 1_000_000
    order = ["user_name", "ts", "event_id"]
    state = state if state is not None else spark.createDataFrame([], STATE_SCHEMA)

    def dealt(df: DataFrame, by: list[str]) -> DataFrame:
        return df.repartition(chunks, *by) if chunks else df.repartition(*by)

    auth = attempts(events).withColumn("event_id", F.coalesce("event_id", F.lit(NO_ID)))
    ranged = auth.repartitionByRange(chunks, *order) if chunks else auth.repartitionByRange(*order)
    first = scratch_path(spark, "lockout-pass1")
    (ranged.sortWithinPartitions(*order).mapInPandas(_summarize(max_attempts, lock_us), SUMMARY_SCHEMA)
     .withColumn("part", F.when(F.col("kind") == "summary", "summary")
                 .when(F.col("outcome").isNull(), "open").otherwise("final"))
     .write.partitionBy("part").parquet(first))
    p1 = spark.read.schema(f"{SUMMARY_SCHEMA}, part string").parquet(first)
    start = state.select("user_name", F.col("attempts").alias("init_a"), F.col("unlock_us").alias("init_u"))
    entries = (dealt(p1.where(F.col("part") == "summary")
                     .select("user_name", "chunk_ts", "chunk_eid", "c_a", "c_u", "g_upper", "g_a", "g_u")
                     .join(start, "user_name", "left")
                     .fillna({"init_a": 0, "init_u": NO_LOCK}), ["user_name"])
               .sortWithinPartitions("user_name", "chunk_ts", "chunk_eid")
               .mapInPandas(_stitch(max_attempts), ENTRY_SCHEMA))
    keys = ["user_name", "chunk_ts", "chunk_eid"]
    resolved = p1.where(F.col("part") == "final").select("event_id", "user_name", "ts", "outcome", "attempts")
    prefix = p1.where(F.col("part") == "open").select("event_id", "ts", "success", *keys)
    refolded = (dealt(prefix.join(entries, keys, "inner"), keys)
                .sortWithinPartitions(*keys, "ts", "event_id")
                .mapInPandas(_refold(max_attempts, lock_us), OUT_SCHEMA))
    out = _with_counts(resolved.unionByName(refolded), state)
    return out.withColumn("event_id", F.nullif("event_id", F.lit(NO_ID)))


def _with_counts(outcomes: DataFrame, state: DataFrame) -> DataFrame:
    """``attempts`` as failures since the user's last success, past the limit
    too, on from the count in ``state``."""
    spark = outcomes.sparkSession
    order = ["user_name", "ts", "event_id"]
    path = scratch_path(spark, "lockout-outcomes")
    laid = (outcomes.drop("attempts").repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()))
    laid.write.parquet(path)
    t = spark.read.schema(laid.schema).parquet(path).withColumn("_pid", F.shiftright("_at", 33))
    run = Window.partitionBy("user_name", "_pid")
    t = t.withColumn("_seg", F.sum((F.col("outcome") == "success").cast("long")).over(run.orderBy("_at")))
    t = t.withColumn("_k", F.sum(F.col("outcome").isin("failure", "locked").cast("long")).over(
        Window.partitionBy("user_name", "_pid", "_seg").orderBy("_at")))
    runs = t.groupBy("user_name", "_pid").agg(F.max_by("_k", "_at").alias("_tail"), F.max("_seg").alias("_resets"))
    runs = runs.join(state.select("user_name", F.col("attempts").alias("_from")), "user_name", "left").fillna({"_from": 0})
    by_user = Window.partitionBy("user_name").orderBy("_pid")
    runs = runs.withColumn("_span", F.sum((F.col("_resets") > 0).cast("long")).over(by_user))
    exit_ = (F.sum("_tail").over(Window.partitionBy("user_name", "_span").orderBy("_pid"))
             + F.when(F.col("_span") == 0, F.col("_from")).otherwise(0))
    runs = runs.withColumn("_exit", exit_).withColumn("_entry", F.coalesce(F.lag("_exit").over(by_user), F.col("_from")))
    j = t.join(runs.select("user_name", "_pid", "_entry"), ["user_name", "_pid"])
    n = F.col("_k") + F.when(F.col("_seg") == 0, F.col("_entry")).otherwise(0)
    return j.select("event_id", "user_name", "ts", "outcome", n.cast("long").alias("attempts"))


LATENESS_S = 3 * 3600
SUCCESS, FAILURE, LOCKED, IGNORED = "success", "failure", "locked", "ignored"


def fold_run(t_us: np.ndarray, success: np.ndarray, n: int, u: int, max_attempts: int, lock_us: int):
    """Fold sorted events of one user who stands at ``n`` failures since the
    last success and, at the limit, is locked until ``u``: outcomes, failures
    after each event, and the standing after all."""
    outcome = np.empty(len(t_us), object)
    count = np.empty(len(t_us), np.int64)
    fails = np.flatnonzero(~success)
    i = 0
    while i < len(t_us):
        if n >= max_attempts and t_us[i] < u:
            j = int(np.searchsorted(t_us, u))
            outcome[i:j], count[i:j] = IGNORED, n
        elif success[i]:
            k = int(np.searchsorted(fails, i))
            j = int(fails[k]) if k < len(fails) else len(t_us)
            n, u = 0, NO_LOCK
            outcome[i:j], count[i:j] = SUCCESS, 0
        else:
            j, n = i + 1, n + 1
            if n >= max_attempts:
                u = int(t_us[i]) + lock_us
            outcome[i], count[i] = (LOCKED if n >= max_attempts else FAILURE), n
        i = j
    return outcome, count, n, u


STREAM_OUT = "part string, reason string, event_id long, user_name string, ts_us long, outcome string, attempts long"
STREAM_NAMES = [f.split()[0] for f in STREAM_OUT.split(", ")]


class Lockouts(StatefulProcessor):
    """One user's attempts."""

    def __init__(self, max_attempts: int, lock_us: int):
        self.max_attempts, self.lock_us = max_attempts, lock_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, ts_us long, success boolean")
        self.standing = handle.getValueState("standing", "attempts long, unlock_us long, timer_ms long")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            why = np.where(pdf["ts_us"].isna(), "no time", np.where(pdf["ts_us"] < mark, "late", ""))
            if (why != "").any():
                bad = pdf[why != ""]
                yield pd.DataFrame({"part": "stray", "reason": why[why != ""], "event_id": bad["event_id"].astype("Int64"),
                                    "user_name": key[0], "ts_us": bad["ts_us"].astype("Int64"), "outcome": None,
                                    "attempts": None})[STREAM_NAMES]
            good = pdf[why == ""]
            if len(good):
                ids = good["event_id"].astype("Int64").astype(object).where(good["event_id"].notna(), None)
                self.waiting.appendList(list(zip(ids, good["ts_us"].astype(int), good["success"].eq(True), strict=True)))
                self._wake(int(good["ts_us"].min()))

    def _wake(self, ts_us: int) -> None:
        """A timer for the moment when the watermark has passed an event."""
        attempts, unlock_us, timer = self.standing.get() or (0, NO_LOCK, None)
        at = ts_us // 1000 + 1
        if timer is None or at < timer:
            self.handle.registerTimer(at)
            self.standing.update((attempts, unlock_us, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda e: (e[1], e[0] is not None, e[0]))
        due = [e for e in held if e[1] < mark]
        attempts, unlock_us, _ = self.standing.get() or (0, NO_LOCK, None)
        if due:
            ids, t, ok = zip(*due, strict=True)
            outcome, count, attempts, unlock_us = fold_run(
                np.array(t, np.int64), np.array(ok, bool), attempts, unlock_us, self.max_attempts, self.lock_us)
            rest = held[len(due):]
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame({"part": "outcome", "reason": None, "event_id": pd.array(ids, "Int64"), "user_name": key[0],
                                "ts_us": t, "outcome": outcome, "attempts": count})[STREAM_NAMES]
            held = rest
        if held or attempts:
            self.standing.update((attempts, unlock_us, None))
        else:
            self.standing.clear()
        if held:
            self._wake(held[0][1])

    def close(self) -> None:
        pass


def run_lockout_stream(spark: SparkSession, sf_dir: str, max_attempts: int = K.MAX_ATTEMPTS,
                       lock_s: int = K.LOCKOUT_S, base: str | None = None, landing_dir: str | None = None,
                       files_per_trigger: int | None = None, lateness_s: int = LATENESS_S) -> DataFrame:
    """Run the lockout over the landed events ('error' = failure, 'signup' =
    success) and return every outcome so far.  Files may land in any order;
    events are folded in event-time order once they are ``lateness_s`` old.
    What still waits at the end of the data is folded in the batch form for
    the result but stays waiting, so that a later call with the same ``base``
    goes on exactly."""
    base = base or scratch_path(spark, "login_lockout")
    events = events_stream(spark, sf_dir, landing_dir, files_per_trigger)
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{lateness_s} seconds")
    rows = (user_key(events.where(F.col("event_type").isin("error", "signup"))
                     .withColumn("user_name", F.col("user_id").cast("string")))
            .select("user_name", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("ts_us"),
                    (F.col("event_type") == "signup").alias("success")))
    run_to_end(keyed_state(rows, ["user_name"], Lockouts(max_attempts, lock_s * 1_000_000), STREAM_OUT), base)
    out = _ts(sink_part(spark, base, STREAM_OUT, "outcome")).select("event_id", "user_name", "ts", "outcome", "attempts")
    waiting, standing = (state_of(spark, base, name) for name in ("waiting", "standing"))
    if waiting is None:
        return out
    waiting = _ts(waiting.select("key.user_name", "list_element.*")).select("event_id", "ts", "user_name", "success")
    standing = standing.select("key.user_name", "value.attempts", "value.unlock_us").where("attempts > 0")
    return out.unionByName(login_lockout(waiting, max_attempts, lock_s, state=standing))


def _ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))


def strays(spark: SparkSession, base: str) -> DataFrame:
    """The side output: attempts behind the watermark or without a time."""
    return _ts(sink_part(spark, base, STREAM_OUT, "stray")).select("reason", "event_id", "user_name", "ts")
