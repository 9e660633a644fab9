"""Edge rows and properties for segments, notes, mutations, joins,
aggregates and the stateful operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paths import SF001, SF01
from dealerlens.operators import aggregates as A
from dealerlens.operators import joins as J
from dealerlens.operators import mutations as M
from dealerlens.operators import notes as N
from dealerlens.operators import segments as S
from dealerlens.sources import fixtures as fx
from dealerlens.streaming.lockout import fold_user, login_lockout

COLS = ["customer_id", "full_name", "phone", "close_reason", "called_flag", "operator", "action_date",
        "reminder_at", "notes", "odometer_km", "model_year", "test_drive_status", "birth_date",
        "vehicle_model", "interested_vehicle", "contact_channel", "city"]
SCHEMA = ", ".join(["customer_id long"] + [f"{c} string" for c in COLS[1:]])


def mk(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLS) for r in rows], SCHEMA)


def ids(df):
    return sorted(r.customer_id for r in df.select("customer_id").collect())


# ----------------------------------------------------------------- segments
def test_flag_segments(spark):
    df = mk(spark, [
        {"customer_id": 1, "called_flag": " Evet "},
        {"customer_id": 2, "called_flag": None},          # null flag: neither
        {"customer_id": 3, "called_flag": "HAYIR", "odometer_km": "60001"},
        {"customer_id": 4, "called_flag": "", "odometer_km": "60000"},
        {"customer_id": 5, "called_flag": "no", "notes": "  \n "},
        {"customer_id": 6, "called_flag": None, "notes": "x"},
    ])
    assert ids(S.seg_processed(df)) == [1, 6]
    assert ids(S.seg_untouched(df)) == [3, 4, 5]
    assert ids(S.seg_trade_in(df)) == [3]
    assert ids(S.seg_called(df)) == []  # ' Evet ' is not exactly 'Evet'


def test_missing_flag_column_makes_everyone_untouched(spark):
    df = mk(spark, [{"customer_id": 1}, {"customer_id": 2}]).drop("called_flag")
    assert ids(S.seg_untouched(df)) == [1, 2]


def test_segments_are_subsets(spark):
    c = fx.customers(spark, SF001)
    n = c.count()
    for seg in (S.seg_processed, S.seg_trade_in, S.seg_warranty, S.seg_untouched,
                S.seg_low_quality, S.seg_test_drive, S.seg_called):
        s = seg(c)
        assert s.count() <= n
        assert s.join(c, "customer_id", "left_anti").count() == 0


def test_fixture_selection_counts(spark):
    """Row counts of FIXTURES.md §3.1 at sf0.001."""
    c = fx.customers(spark, SF001)
    assert S.seg_trade_in(c).count() == 33
    assert S.seg_warranty(c).count() == 36
    assert S.seg_untouched(c).count() == 56
    assert S.seg_processed(c).count() == 84
    assert S.seg_low_quality(c).count() == 39
    assert S.seg_test_drive(c).count() == 34
    assert S.reminder_list(c).count() == 30
    assert J.reminder_due(c).count() == 15
    assert S.birthdays_month(c).count() == 13
    assert S.birthdays_today(c).count() == 1
    assert J.customer_geo(c).count() == 108
    assert [A.called_in_period(c, d).count() for d in (7, 30, 365)] == [3, 6, 27]


def test_calls_boundary_day(spark):
    df = mk(spark, [
        {"customer_id": 1, "called_flag": "Evet", "operator": "a", "action_date": "2001-07-02"},
        {"customer_id": 2, "called_flag": "Evet", "operator": "a", "action_date": "2001-07-03"},
    ])
    # as_of 12:00: the day exactly 30 days back is cut off, the next is kept
    assert A.calls_by_staff(df, 30, "2001-08-01 12:00:00").first().calls == 1
    # at midnight both are kept
    assert A.calls_by_staff(df, 30, "2001-08-01 00:00:00").first().calls == 2


# ----------------------------------------------------------------- notes
NOTES = "\n".join([
    "01.06.2001 09:00 | user | hello",
    "no separator",
    "02.06.2001 09:00 | two-part",
    "03.06.2001 10:00 | bot | text | with pipe",
    "04.06.2001 11:00 | user | MESAJ SİLİNDİ",
])


def test_notes_timeline(spark):
    df = mk(spark, [{"customer_id": 1, "notes": NOTES}, {"customer_id": 2}])
    rows = [tuple(r) for r in N.notes_timeline(df).orderBy("line_idx").collect()]
    assert rows == [
        (1, 0, "01.06.2001 09:00", "user", "hello", False),
        (1, 3, "03.06.2001 10:00", "bot", "text | with pipe", False),
        (1, 4, "04.06.2001 11:00", "user", "MESAJ SİLİNDİ", True),
    ]


def test_delete_note(spark):
    df = mk(spark, [{"customer_id": 1, "notes": NOTES}, {"customer_id": 2, "notes": ""}])
    dels = spark.createDataFrame([(1, 2), (1, 3), (1, 1), (1, 9), (2, 0)], "customer_id long, line_idx int")
    out = {r.customer_id: r.notes for r in M.delete_note(df, dels).collect()}
    lines = out[1].split("\n")
    assert len(lines) == len(NOTES.split("\n"))  # line count kept
    assert lines[1] == "no separator"  # fewer than two parts: unchanged
    assert lines[2] == "02.06.2001 09:00 | two-part | MESAJ SİLİNDİ"
    assert lines[3] == "03.06.2001 10:00 | bot | MESAJ SİLİNDİ"
    assert out[2] == ""


def test_global_search(spark):
    df = mk(spark, [{"customer_id": 1, "full_name": "Ali Veli", "phone": "0532"},
                    {"customer_id": 2, "full_name": "Ayşe", "phone": None}])
    assert ids(N.global_search(df, "VELI")) == [1]
    assert ids(N.global_search(df, "none", columns=["phone"])) == [2]  # null reads 'None'
    assert ids(N.global_search(df, r"\D", columns=["phone"])) == [1]  # lower-cased to \d
    assert ids(N.global_search(df, "a.", literal=True)) == []
    assert ids(N.global_search(df, "")) == [1, 2]


def test_customer_profile_point_lookup(spark):
    c = fx.customers(spark, SF001)
    p = N.customer_profile(c, 7).collect()
    assert len(p) == 1 and p[0].customer_id == 7 and p[0].occupation == "-"


# ----------------------------------------------------------------- mutations
def patches(spark, rows):
    return spark.createDataFrame(rows, "patch_ts timestamp_ntz, seq long, customer_id long, user_name string, "
                                       "reason string, reminder string, note string")


def test_apply_outcome_edges(spark):
    t = dt.datetime(2001, 8, 1, 10, 0)
    base = mk(spark, [
        {"customer_id": 1, "close_reason": "old", "notes": None, "reminder_at": "r-old"},
        {"customer_id": 2, "close_reason": "old", "notes": "", "reminder_at": "r-old"},
        {"customer_id": 3, "close_reason": "old", "notes": "nan"},
        {"customer_id": 4, "close_reason": "old", "notes": "first"},
        {"customer_id": 5, "close_reason": "keep", "notes": "untouched"},
    ])
    p = patches(spark, [
        (t, 1, 1, "u", None, "", "n1"),
        (t, 2, 2, "u", "", "2001-08-02T10:00", "n2"),
        (t, 3, 3, "u", "new", None, "n3"),
        (t, 4, 4, "u", "new", None, "n4"),
        (t + dt.timedelta(minutes=1), 5, 4, "v", None, None, "n5"),
    ])
    out = {r.customer_id: r for r in M.apply_outcome(base, p).collect()}
    assert out[1].close_reason == "old" and out[1].reminder_at == "r-old"
    assert out[1].notes == "01.08.2001 10:00 | u | n1"
    assert out[2].close_reason == "" and out[2].reminder_at == "2001-08-02T10:00"
    assert out[2].notes == "01.08.2001 10:00 | u | n2 (⏰ Hatırlatıcı Kuruldu: 2001-08-02 10:00)"
    assert out[3].notes == "01.08.2001 10:00 | u | n3"
    assert out[4].notes == "first\n01.08.2001 10:00 | u | n4\n01.08.2001 10:01 | v | n5"
    assert out[4].operator == "v" and out[4].close_reason == "new" and out[4].called_flag == "Evet"
    assert out[4].action_date == "2001-08-01"
    assert out[5].notes == "untouched" and out[5].called_flag is None


def test_apply_outcome_idempotent_without_notes(spark):
    c = fx.customers(spark, SF001)
    p = fx.outcome_patches(spark, SF01).withColumn("note", F.lit(None).cast("string"))
    once = M.apply_outcome(c, p)
    twice = M.apply_outcome(once, p)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_apply_admin_edit_edges(spark):
    t = dt.datetime(2001, 8, 1, 10, 0)
    base = mk(spark, [{"customer_id": 1, "full_name": "a", "phone": "1", "notes": ""},
                      {"customer_id": 2, "full_name": "b", "phone": "2", "notes": None},
                      {"customer_id": 3, "full_name": "c", "phone": "3", "notes": "x"}])
    p = spark.createDataFrame(
        [(t, 1, 1, "Admin", "A", None, "r", "note"), (t, 2, 2, "Admin", "B", "22", None, None)],
        "patch_ts timestamp_ntz, seq long, customer_id long, user_name string, full_name string, "
        "phone string, close_reason string, note string")
    out = {r.customer_id: r for r in M.apply_admin_edit(base, p).collect()}
    assert out[1].notes == "\n01.08.2001 10:00 | Admin | note"  # leading newline kept
    assert out[1].phone is None and out[1].full_name == "A"
    assert out[2].notes == "" and out[2].close_reason is None
    assert out[3].notes == "x" and out[3].full_name == "c"


def test_complete_reminder(spark):
    base = mk(spark, [{"customer_id": 1, "reminder_at": "x"}, {"customer_id": 2, "reminder_at": "y"}])
    done = spark.createDataFrame([(1,), (1,)], "customer_id long")
    out = {r.customer_id: r.reminder_at for r in M.complete_reminder(base, done).collect()}
    assert out == {1: None, 2: "y"}


# ----------------------------------------------------------------- aggregates
def test_distribution_counts_sum(spark):
    c = fx.customers(spark, SF01)
    d = A.vehicle_model_dist(c)
    total = d.agg(F.sum("n")).first()[0]
    from dealerlens.functions import is_meaningful
    assert total == c.where(is_meaningful(F.col("vehicle_model"))).count()
    share = A.distribution_share(d).agg(F.sum("share_pct")).first()[0]
    assert abs(share - 100.0) < 1e-9


def test_close_reason_placeholder(spark):
    df = mk(spark, [{"customer_id": 1}])
    assert [tuple(r) for r in A.close_reason_dist(df).collect()] == [("Veri Yok", 1)]


def test_performance_widgets_with_missing_columns(spark):
    df = mk(spark, [{"customer_id": 1, "called_flag": "Evet", "operator": "a", "action_date": "2001-07-30",
                     "close_reason": "r"}])
    assert A.calls_by_staff(df.drop("action_date"), 30).count() == 0
    assert A.calls_by_staff(df.drop("operator"), 30).count() == 0
    assert A.reasons_by_staff(df.drop("close_reason")).count() == 0
    assert A.team_evaluation(df.drop("action_date"), 30).count() == 0
    ev = A.team_evaluation(df.drop("operator"), 30, "somebody").first()
    assert ev.total_calls == 1 and ev.top_reason == "r"  # staff filter skipped
    ev = A.team_evaluation(df.drop("close_reason"), 30).first()
    assert ev.total_calls == 1 and ev.top_reason is None
    from dealerlens.plans.dashboard import TeamPerformance
    for missing in ("operator", "close_reason", "action_date"):
        d = df.drop(missing)
        page = TeamPerformance(d)
        try:
            assert page.calls_by_staff(30).collect() == A.calls_by_staff(d, 30).collect()
            assert page.reasons_by_staff().collect() == A.reasons_by_staff(d).collect()
            assert page.evaluation(30, "somebody").collect() == A.team_evaluation(d, 30, "somebody").collect()
        finally:
            page.close()


def test_team_evaluation_empty_period(spark):
    df = mk(spark, [{"customer_id": 1, "called_flag": "Evet", "action_date": "1990-01-01"}])
    assert A.team_evaluation(df, 7).count() == 0


# ----------------------------------------------------------------- calendar
def test_birthday_calendar_feb29(spark):
    df = mk(spark, [{"customer_id": 1, "full_name": "leap", "birth_date": "1980-02-29"},
                    {"customer_id": 2, "full_name": "other", "birth_date": "1980-02-03"}])
    leap = J.birthday_calendar(df, "2004-02-10 12:00:00")
    plain = J.birthday_calendar(df, "2001-02-10 12:00:00")
    assert leap.count() == 29 and plain.count() == 28
    assert leap.where("customer_id = 1").first().day == 29
    assert plain.where("customer_id = 1").count() == 0
    # 1 Feb 2001 was a Thursday: Monday-first weekday 3 in week row 0
    first = plain.where("day = 1").first()
    assert (first.week, first.weekday) == (0, 3)


def test_map_without_city_column(spark):
    df = mk(spark, [{"customer_id": 1, "city": "Bursa"}]).drop("city")
    assert J.mappable_customers(df).count() == 0 and J.customer_geo(df).count() == 0


def test_birthday_calendar_without_birth_dates(spark):
    df = mk(spark, [{"customer_id": 1, "full_name": "a"}]).drop("birth_date")
    cal = J.birthday_calendar(df, "2001-08-10 12:00:00")
    assert cal.count() == 31 and cal.where("customer_id IS NOT NULL").count() == 0


# ----------------------------------------------------------------- lockout
def plain_loop(events, max_attempts, lock_s):
    state, out = {}, {}
    for ev in sorted(events, key=lambda e: (e.user_name, e.ts, e.event_id)):
        a, u = state.get(ev.user_name, (0, 0.0))
        t = ev.ts.timestamp()
        if a >= max_attempts and t < u:
            out[ev.event_id] = ("ignored", a)
            continue
        if ev.success:
            state.pop(ev.user_name, None)
            out[ev.event_id] = ("success", 0)
        else:
            a += 1
            state[ev.user_name] = (a, t + lock_s)
            out[ev.event_id] = ("locked" if a >= max_attempts else "failure", a)
    return out


def test_login_lockout_matches_plain_loop(spark):
    ev = fx.auth_events(spark, SF01)
    got = {r.event_id: (r.outcome, r.attempts) for r in login_lockout(ev, 3, 86400).collect()}
    assert got == plain_loop(ev.collect(), 3, 86400)
    counts = {}
    for v, _ in got.values():
        counts[v] = counts.get(v, 0) + 1
    assert counts["locked"] == 408 and counts["ignored"] == 395


def test_login_lockout_many_chunks(spark):
    """Users split over many range chunks (and a hot user spanning most of
    them) give exactly the sequential result."""
    ev = fx.auth_events(spark, SF01)
    hot = ev.withColumn("user_name", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("user_name")))
    for data, lock in ((ev, 86400), (hot, 86400), (hot, 180), (ev, 7200)):
        got = {r.event_id: (r.outcome, r.attempts) for r in login_lockout(data, 3, lock, chunks=64).collect()}
        want = plain_loop(data.collect(), 3, lock)
        assert got == want
    parts = login_lockout(hot, 3, 180, chunks=64)
    assert parts.count() == hot.count()


def test_login_lockout_splits_a_hot_user_with_long_locks(spark):
    """A user with a third of the attempts and a one-day lock (lock phases
    never realign): spread over many chunks, each summarised by a small
    transfer table."""
    from dealerlens.streaming import lockout as LK
    ev = fx.auth_events(spark, SF01)
    hot = ev.withColumn("user_name", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("user_name")))
    order = ["user_name", "ts", "event_id"]
    p1 = (hot.repartitionByRange(64, *order).sortWithinPartitions(*order)
          .mapInPandas(LK._summarize(3, 86400 * 10**6), LK.SUMMARY_SCHEMA))
    s = p1.where("kind = 'summary' AND user_name = 'hot'").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.size("g_upper")).alias("g")).first()
    n_hot = hot.where("user_name = 'hot'").count()
    assert s.chunks >= 16 and s.g < n_hot / s.chunks


def test_lockout_user_key_is_normalised(spark):
    t = dt.datetime(2001, 8, 1)
    rows = [(1, " Ali@X.com", t, False), (2, "ali@x.com", t + dt.timedelta(seconds=1), False),
            (3, "ALI@x.com ", t + dt.timedelta(seconds=2), False), (4, "ali@x.com", t + dt.timedelta(seconds=3), True),
            (5, "", t, False), (6, None, t, False)]
    df = spark.createDataFrame(rows, "event_id long, user_name string, ts timestamp_ntz, success boolean")
    got = {r.event_id: (r.user_name, r.outcome) for r in login_lockout(df, 3, 180).collect()}
    assert got == {1: ("ali@x.com", "failure"), 2: ("ali@x.com", "failure"),
                   3: ("ali@x.com", "locked"), 4: ("ali@x.com", "ignored")}


def test_lockout_edges():
    import numpy as np
    s = 1_000_000
    # 3 failures lock; right password while locked is ignored; the first
    # failure after expiry locks again (attempts do not reset)
    t = np.array([0, 1, 2, 3, 200, 201]) * s
    ok = np.array([False, False, False, True, False, True])
    out, att, a, u = fold_user(t, ok, 0, 0, 3, 180 * s)
    assert list(out) == ["failure", "failure", "locked", "ignored", "locked", "ignored"]
    assert list(att) == [1, 2, 3, 3, 3, 3]  # the fold's state is capped at the limit


def test_stream_equals_batch(spark):
    from dealerlens.streaming.lockout import run_lockout_stream
    from dealerlens.streaming.reminders import run_reminder_alerts
    batch = J.reminders_alerted(fx.poll_ticks(spark, SF001), fx.stream_reminders(spark, SF001))
    stream = run_reminder_alerts(spark, SF001)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    assert stream.count() == 29
    lb = login_lockout(fx.auth_events(spark, SF001), 3, 86400)
    ls = run_lockout_stream(spark, SF001, 3, 86400)
    assert lb.exceptAll(ls).count() == 0 and ls.exceptAll(lb).count() == 0


def _same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


YEARS = 10 * 366 * 86400


@pytest.mark.parametrize("order,lateness", [(range(6), 3 * 3600), (range(5, -1, -1), YEARS)])
def test_streams_over_several_micro_batches(spark, order, lateness):
    """Events landed as six files, one per micro-batch, in time order or in
    reverse with enough lateness: the results equal the batch forms."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming.lockout import run_lockout_stream
    from dealerlens.streaming.reminders import run_reminder_alerts
    from landing import land_events
    landing = land_events(spark, SF01, scratch_path(spark, "landing"), files=6, slices=order)
    batch = J.reminders_alerted(fx.poll_ticks(spark, SF01), fx.stream_reminders(spark, SF01))
    assert batch.count() == 350
    one = {"landing_dir": landing, "files_per_trigger": 1, "lateness_s": lateness}
    assert _same(run_reminder_alerts(spark, SF01, **one), batch)
    locks = run_lockout_stream(spark, SF01, 3, 86400, **one)
    assert locks.count() == 4031
    assert _same(locks, login_lockout(fx.auth_events(spark, SF01), 3, 86400))


def test_late_rows_are_accounted_for(spark):
    """With too little lateness nothing is lost silently: what is not in the
    output is in the side output."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming import lockout, reminders
    from landing import land_events
    landing = land_events(spark, SF01, scratch_path(spark, "landing"), files=4, slices=range(3, -1, -1))
    base = scratch_path(spark, "locks")
    locks = lockout.run_lockout_stream(spark, SF01, 3, 86400, base=base, landing_dir=landing, files_per_trigger=1)
    late = lockout.strays(spark, base)
    assert late.count() > 0
    assert locks.count() + late.count() == fx.auth_events(spark, SF01).count()
    assert locks.join(late, "event_id").count() == 0
    base = scratch_path(spark, "alerts")
    alerts = reminders.run_reminder_alerts(spark, SF01, base=base, landing_dir=landing, files_per_trigger=1)
    late = reminders.strays(spark, base)
    ticks = late.where("reminder_id IS NULL").agg(F.sum("n")).first()[0]
    assert 0 < ticks < spark.read.parquet(f"{SF01}/events.parquet").count()
    batch = J.reminders_alerted(fx.poll_ticks(spark, SF01), fx.stream_reminders(spark, SF01))
    assert alerts.exceptAll(batch).count() == 0
    # an alert of the batch form that is missing: its reminder or its operator's ticks came late
    missing = batch.exceptAll(alerts)
    assert missing.count() == missing.join(late.select("operator").distinct(), "operator", "left_semi").count() > 0


def test_rows_that_cannot_count_are_in_the_side_output(spark):
    """Events without a time, a user or an id, spread over two micro-batches."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming import lockout, reminders
    t = dt.datetime(2024, 1, 5, 12)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(1, t, 7, "signup"), (2, None, 7, "signup"), (3, t, None, "signup"), (None, t, 7, "signup"),
            (4, None, None, "error"), (5, t + dt.timedelta(hours=1), 7, "view"), (6, t, 8, "error"), (7, t, 8, None)]
    sf, landing = scratch_path(spark, "sf"), scratch_path(spark, "landing")
    df = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    df.limit(0).write.parquet(f"{sf}/events.parquet")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1 OR event_id IS NULL"):
        df.where(part).coalesce(1).write.mode("append").parquet(landing)
    base = scratch_path(spark, "alerts")
    got = reminders.run_reminder_alerts(spark, sf, base=base, landing_dir=landing, files_per_trigger=1)
    assert [tuple(r) for r in got.collect()] == [("7", 1, t + dt.timedelta(hours=1))]
    assert sorted((r.reason, r.operator or "", r.reminder_id or 0) for r in reminders.strays(spark, base).collect()) == [
        ("no id", "7", 0), ("no operator", "", 3), ("no time", "", 4), ("no time", "7", 2)]
    base = scratch_path(spark, "locks")
    got = lockout.run_lockout_stream(spark, sf, base=base, landing_dir=landing, files_per_trigger=1)
    assert {(r.event_id, r.user_name, r.outcome) for r in got.collect()} == {
        (1, "7", "success"), (None, "7", "success"), (6, "8", "failure")}
    assert [(r.reason, r.event_id, r.user_name) for r in lockout.strays(spark, base).collect()] == [("no time", 2, "7")]


def test_hot_operator_in_the_streams(spark):
    """A user with a third of all events; ticks of a batch shrink to extremes,
    reminders are dealt over shares."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming import lockout, reminders
    from landing import land_events
    sf = scratch_path(spark, "sf")
    events = spark.read.parquet(f"{SF01}/events.parquet")
    events = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))
    events.coalesce(1).write.parquet(f"{sf}/events.parquet")
    landing = land_events(spark, sf, scratch_path(spark, "landing"), files=3)
    user = F.col("user_id").cast("string").alias("operator")
    ticks = events.select(user, F.col("ts").alias("tick_ts"))
    due = (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("due_ts")
    batch = J.reminders_alerted(ticks, events.where("event_type = 'signup'").select(
        user, F.col("event_id").alias("reminder_id"), due))
    one = {"landing_dir": landing, "files_per_trigger": 1}
    for shares in (1, 3):
        assert _same(reminders.run_reminder_alerts(spark, sf, shares=shares, **one), batch)
    auth = events.where(F.col("event_type").isin("error", "signup")).select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user_name"), (F.col("event_type") == "signup").alias("success"))
    assert _same(lockout.run_lockout_stream(spark, sf, 3, 7200, **one), login_lockout(auth, 3, 7200))


def test_reminder_state_is_bounded(spark):
    """What the watermark has passed leaves the state."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming import reminders
    from dealerlens.streaming.landed import state_of
    from landing import land_events
    base = scratch_path(spark, "alerts")
    landing = land_events(spark, SF01, scratch_path(spark, "landing"), files=6)
    reminders.run_reminder_alerts(spark, SF01, base=base, landing_dir=landing, files_per_trigger=1, lateness_s=3600, shares=1)
    held = [r.value for r in state_of(spark, base, "held").collect()]
    buckets = [b for v in held for b in reminders.unpacked(v.extremes, 3)[0]]
    # five of the six files lie behind the last watermark that was in force
    first = spark.read.parquet(f"{SF01}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    passed = (first[0] + (first[1] - first[0]) * 5 / 6 - dt.timedelta(hours=1)).timestamp()
    assert buckets and min(buckets) >= passed * 1_000_000 // reminders.BUCKET_US - 1


def test_reminder_state_keys_do_not_grow_with_operators(spark):
    """Operators by the hundred share a few slots, over several micro-batches."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming import reminders
    from dealerlens.streaming.landed import state_of
    from landing import land_events
    sf, base = scratch_path(spark, "sf"), scratch_path(spark, "alerts")
    start = F.timestamp_seconds(F.lit(1704067200) + (F.col("event_id") * 7919) % 90000).cast("timestamp_ntz")
    events = spark.range(6000).select(
        F.col("id").alias("event_id"), (F.col("id") % 700).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "signup").otherwise("view").alias("event_type"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props")).withColumn("ts", start)
    events.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{sf}/events.parquet")
    landing = land_events(spark, sf, scratch_path(spark, "landing"), files=3)
    got = reminders.run_reminder_alerts(spark, sf, base=base, landing_dir=landing, files_per_trigger=1, slots=16)
    batch = J.reminders_alerted(fx.poll_ticks(spark, sf), fx.stream_reminders(spark, sf))
    assert batch.count() > 50 and _same(got, batch)
    assert 0 < state_of(spark, base, "held").count() <= 16


def test_streams_read_a_folder_table(spark):
    """events.parquet as a folder of part files, as large tables are."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming.lockout import run_lockout_stream
    from dealerlens.streaming.reminders import run_reminder_alerts
    sf = scratch_path(spark, "sf")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(3).write.parquet(f"{sf}/events.parquet")
    assert run_reminder_alerts(spark, sf).count() == 29
    assert run_lockout_stream(spark, sf, 3, 86400).count() == 400


def test_lockout_standing_goes_with_a_success(spark):
    from dealerlens.session import scratch_path
    from dealerlens.streaming.landed import state_of
    from dealerlens.streaming.lockout import run_lockout_stream
    t = dt.datetime(2024, 1, 5, 12)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    days = [[(1, t, 1, "error"), (2, t, 2, "error"), (3, t + dt.timedelta(seconds=1), 1, "signup")],
            [(4, t + dt.timedelta(days=1), 3, "error")], [(5, t + dt.timedelta(days=2), 4, "error")]]
    sf, landing, base = (scratch_path(spark, n) for n in ("sf", "landing", "locks"))
    spark.createDataFrame([], schema).write.parquet(f"{sf}/events.parquet")
    for day in days:
        (spark.createDataFrame([(*r, None, None) for r in day], schema).coalesce(1)
         .write.mode("append").parquet(landing))
        out = run_lockout_stream(spark, sf, 3, 180, base=base, landing_dir=landing)
    assert {(r.event_id, r.outcome) for r in out.collect()} == {
        (1, "failure"), (2, "failure"), (3, "success"), (4, "failure"), (5, "failure")}
    standing = {r.key.user_name: r.value.attempts for r in state_of(spark, base, "standing").collect()}
    # user 1 has none, 3's and 4's events still wait
    assert standing == {"2": 1, "3": 0, "4": 0} or standing == {"2": 1, "3": 1, "4": 0}


def test_team_performance_from_cube_equals_direct(spark):
    from dealerlens.plans.dashboard import TeamPerformance
    c = fx.customers(spark, SF01)
    page = TeamPerformance(c)
    try:
        for d in (7, 30, 365):
            assert page.calls_by_staff(d).collect() == A.calls_by_staff(c, d).collect()
        for staff in ("HEPSİ", "Supplier#000000001", "Supplier#000000002"):
            assert sorted(page.reasons_by_staff(staff).collect()) == sorted(A.reasons_by_staff(c, staff).collect())
            for d in (7, 30, 365):
                assert page.evaluation(d, staff).collect() == A.team_evaluation(c, d, staff).collect()
        assert sorted(page.staff_list().collect()) == sorted(A.staff_list(c).collect())
    finally:
        page.close()


def test_streams_survive_restart(spark):
    """Stop after half the files, land the rest, restart from the same
    checkpoints: outputs equal the batch results, nothing twice."""
    from dealerlens.session import scratch_path
    from dealerlens.streaming.lockout import run_lockout_stream
    from dealerlens.streaming.reminders import run_reminder_alerts
    from landing import land_events
    landing = scratch_path(spark, "landing")
    alerts_out, lock_out = scratch_path(spark, "alerts"), scratch_path(spark, "lockout")
    land_events(spark, SF01, landing, files=6, slices=range(0, 3))
    first = run_reminder_alerts(spark, SF01, base=alerts_out, landing_dir=landing).count()
    run_lockout_stream(spark, SF01, 3, 86400, base=lock_out, landing_dir=landing)
    land_events(spark, SF01, landing, files=6, slices=range(3, 6))
    alerts = run_reminder_alerts(spark, SF01, base=alerts_out, landing_dir=landing)
    locks = run_lockout_stream(spark, SF01, 3, 86400, base=lock_out, landing_dir=landing)
    batch = J.reminders_alerted(fx.poll_ticks(spark, SF01), fx.stream_reminders(spark, SF01))
    assert 0 < first < alerts.count() == batch.count()
    assert batch.exceptAll(alerts).count() == 0 and alerts.exceptAll(batch).count() == 0
    lb = login_lockout(fx.auth_events(spark, SF01), 3, 86400)
    assert _same(locks, lb)
