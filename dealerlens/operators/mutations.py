"""Table updates as new table versions: base LEFT JOIN reduced patches.

Patches are first reduced to one row per customer with aggregates that
combine map-side (max_by / min over structs), so a customer with very many
patches is pre-reduced in every task.  Only the appended note lines of a
customer are gathered, because they become part of that customer's one
notes cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import as_text, note_line, urstrip, ustrip


def _order() -> Column:
    return F.struct("patch_ts", "seq")


def _ordered_lines(line: Column) -> Column:
    """Lines of a key in patch order (null lines skipped); null when none."""
    arr = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("patch_ts", "seq", line.alias("l")))))
    return F.when(F.size(arr) > 0, F.array_join(F.transform(arr, lambda x: x["l"]), "\n"))


def reduce_outcomes(patches: DataFrame) -> DataFrame:
    """Per customer: last user and date, last non-null reason, last
    non-empty reminder, and the ordered note lines."""
    note = F.col("note")
    line = F.when(note.isNotNull() & (note != ""),
                  urstrip(note_line(F.col("patch_ts"), F.col("user_name"), note, F.col("reminder"))))
    rem = F.col("reminder")
    return patches.groupBy("customer_id").agg(
        F.max_by("user_name", _order()).alias("p_user"),
        F.date_format(F.max("patch_ts"), "yyyy-MM-dd").alias("p_date"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), _order())).alias("p_reason"),
        F.max_by("reminder", F.when(rem.isNotNull() & (rem != ""), _order())).alias("p_reminder"),
        _ordered_lines(line).alias("p_lines"),
    )


def append_note(base: DataFrame, notes: DataFrame) -> DataFrame:
    """Append note lines (patch_ts, seq, customer_id, user_name, note,
    reminder) to the notes cells, in order; blank notes add nothing, an old
    cell that is null, '' or 'nan' is replaced, and the result is stripped.
    The other columns stay as they are."""
    note = F.col("note")
    line = F.when(note.isNotNull() & (note != ""),
                  urstrip(note_line(F.col("patch_ts"), F.col("user_name"), note, F.col("reminder"))))
    lines = notes.groupBy("customer_id").agg(_ordered_lines(line).alias("p_lines"))
    j = base.join(lines, "customer_id", "left")
    return j.select(*[(_appended() if c == "notes" else F.col(c)).alias(c) for c in base.columns])


def _appended() -> Column:
    """The notes cell with the new lines after it."""
    old = F.col("notes")
    kept = F.when(old.isNotNull() & (old != "") & (old != "nan"), old)
    return F.when(F.col("p_lines").isNotNull(), ustrip(F.concat_ws("\n", kept, F.col("p_lines")))).otherwise(old)


def apply_outcome(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Save call outcomes: flag 'Evet', operator and date of the last save,
    reason = COALESCE(new, old) (an empty new reason overwrites), reminder
    = COALESCE(new unless empty, old), note lines appended (old null, ''
    or 'nan' is replaced; the result is stripped)."""
    red = reduce_outcomes(patches).withColumn("_m", F.lit(True))
    j = base.join(red, "customer_id", "left")
    m = F.col("_m").isNotNull()
    upd = {
        "called_flag": F.when(m, F.lit(K.CALLED_EXACT)).otherwise(F.col("called_flag")),
        "operator": F.when(m, F.col("p_user")).otherwise(F.col("operator")),
        "action_date": F.when(m, F.col("p_date")).otherwise(F.col("action_date")),
        "close_reason": F.coalesce(F.col("p_reason"), F.col("close_reason")),
        "reminder_at": F.coalesce(F.col("p_reminder"), F.col("reminder_at")),
        "notes": _appended(),
    }
    return j.select(*[upd.get(c, F.col(c)).alias(c) for c in base.columns])


def apply_admin_edit(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Admin edit: name, phone and reason overwritten by the last patch
    (nulls included); notes become old (or '') + newline + line for every
    patch with a note — an empty old note leaves a leading newline."""
    note = F.col("note")
    line = F.when(note.isNotNull() & (note != ""),
                  note_line(F.col("patch_ts"), F.col("user_name"), note))
    red = patches.groupBy("customer_id").agg(
        F.max_by(F.struct("full_name", "phone", "close_reason"), _order()).alias("p"),
        _ordered_lines(line).alias("p_lines"),
    ).withColumn("_m", F.lit(True))
    j = base.join(red, "customer_id", "left")
    m = F.col("_m").isNotNull()
    old = F.coalesce(F.col("notes"), F.lit(""))
    appended = F.when(F.col("p_lines").isNotNull(), F.concat(F.lit("\n"), F.col("p_lines"))).otherwise(F.lit(""))
    upd = {
        "full_name": F.when(m, F.col("p.full_name")).otherwise(F.col("full_name")),
        "phone": F.when(m, F.col("p.phone")).otherwise(F.col("phone")),
        "close_reason": F.when(m, F.col("p.close_reason")).otherwise(F.col("close_reason")),
        "notes": F.when(m, F.concat(old, appended)).otherwise(F.col("notes")),
    }
    return j.select(*[upd.get(c, F.col(c)).alias(c) for c in base.columns])


def delete_note(base: DataFrame, deletions: DataFrame) -> DataFrame:
    """Replace addressed note lines with 'ts | author | MESAJ SİLİNDİ' when
    the line has at least two '|' parts; an index past the end or an empty
    cell leaves the text unchanged."""
    idx = deletions.groupBy("customer_id").agg(F.collect_set("line_idx").alias("_idx"))
    j = base.join(idx, "customer_id", "left")
    old = F.col("notes")

    def fix(x, i):
        p = F.split(x, r"\|", 3)
        tomb = F.concat(ustrip(p[0]), F.lit(" | "), ustrip(p[1]), F.lit(" | " + K.DELETED_MARK))
        return F.when(F.array_contains(F.col("_idx"), i) & (F.size(p) >= 2), tomb).otherwise(x)

    new = F.array_join(F.transform(F.split(old, "\n"), fix), "\n")
    upd = {"notes": F.when(F.col("_idx").isNotNull() & old.isNotNull() & (old != ""), new).otherwise(old)}
    return j.select(*[upd.get(c, F.col(c)).alias(c) for c in base.columns])


def complete_reminder(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Clear the reminder of the given customers."""
    done = ids.select("customer_id").distinct().withColumn("_m", F.lit(True))
    j = base.join(done, "customer_id", "left")
    upd = {"reminder_at": F.when(F.col("_m").isNull(), F.col("reminder_at"))}
    return j.select(*[upd.get(c, F.col(c)).alias(c) for c in base.columns])


def still_notified(notified: DataFrame, completed: DataFrame) -> DataFrame:
    """The notified ids without those whose reminder was completed: a new
    reminder of such a customer alerts again."""
    return notified.join(completed.select("customer_id").distinct(), "customer_id", "left_anti")


def _log(ts: Column, user: Column, action: str, detail: Column) -> list[Column]:
    return [F.date_format(ts, K.LOG_TS_FORMAT).alias("log_ts"), as_text(user).alias("user_name"),
            F.lit(action).alias("action_type"), detail.alias("detail")]


def _fmt(template: str, *cols: Column) -> Column:
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for c, p in zip(cols, pieces[1:]):
        out += [c, F.lit(p)]
    return F.concat(*out)


def audit_from_patches(base: DataFrame, outcomes: DataFrame | None = None,
                       admin: DataFrame | None = None, deletions: DataFrame | None = None,
                       completions: DataFrame | None = None) -> DataFrame:
    """One audit row per applied change, with the dashboard's texts.  Names
    are looked up in the table after the change (unknown -> default)."""
    names = base.select("customer_id", F.col("full_name").alias("_name"))
    parts = []
    if outcomes is not None:
        o = outcomes.join(names, "customer_id", "left")
        name = F.coalesce(F.col("_name"), F.lit(K.UNKNOWN_CUSTOMER))
        parts.append(o.select(*_log(F.col("patch_ts"), F.col("user_name"), K.AUDIT_OUTCOME[0],
                                    _fmt(K.AUDIT_OUTCOME[1], name, F.col("customer_id").cast("string")))))
    if admin is not None:
        parts.append(admin.select(*_log(F.col("patch_ts"), F.col("user_name"), K.AUDIT_ADMIN[0],
                                        _fmt(K.AUDIT_ADMIN[1], F.col("customer_id").cast("string")))))
    if deletions is not None:
        parts.append(deletions.select(*_log(F.col("patch_ts"), F.col("user_name"), K.AUDIT_DELETE[0],
                                            _fmt(K.AUDIT_DELETE[1], F.col("customer_id").cast("string")))))
    if completions is not None:
        c = completions.join(names, "customer_id", "left")
        name = F.coalesce(F.col("_name"), F.lit(K.UNKNOWN_CUSTOMER))
        parts.append(c.select(*_log(F.col("patch_ts"), F.col("user_name"), K.AUDIT_COMPLETE[0],
                                    _fmt(K.AUDIT_COMPLETE[1], name, F.col("customer_id").cast("string")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
