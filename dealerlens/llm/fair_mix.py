"""Mixing sources to target weights by weighted fair queueing.

Within its source a document stands at a place set by a hash of its id; its
virtual finish time is the source's cumulative words, this document included,
divided by the source's target.  A second lap of the source follows the first
with the source's whole size added.  All laps are range-sorted by finish time
and the queue is cut where the words reach the budget, so at the cut every
source has been served its target to within a document.

Targets: sources in code-point order (null last) weigh ``weights`` in rotation
and share ``share`` of all words; none exceeds ``laps`` times its source, the
excess going to the others by weight.

Defined results: a null text has size 0; sources without words have target 0
and take nothing; repeated rows queue separately (equal keys in an arbitrary
but stored order); an empty table gives an empty result; other columns are
ignored.  The source table is never collected: the water level is found by
repeated aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, global_rank, prepare, range_sorted, stored, unlike

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LAPS = 2
#: Breaks ties of the finish time.
PLACE = ("_src", "_key", "doc_id", "size")
#: Columns that the queue is worked out with.
WORKING = ("_src", "_key", "_pid", "_idx", "_mid", "_sum", "_off", "_cum")


def source_key(source: Column) -> Column:
    """Never null and ordered as the contract: code points, null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, laps: int = LAPS) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size)."""
    ranked = global_rank(sizes, [F.col("_src")], "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stored(ranked.select("_src", "source_size", w.alias("_w")), "mix-weights")
    cap = F.col("source_size") * F.lit(float(laps))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("_w")
        r = src.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))),
                    F.sum(full.cast("int"))).first()
        if (r[2] or 0) == capped or not r[1]:
            break
        capped = r[2] or 0
        level = (share * total - r[0]) / r[1]
    target = F.least(cap, F.lit(level) * F.col("_w")) if r[1] else cap
    return src.select("_src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, laps: int = LAPS, seed: int = 7,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of
    ``docs``: ``copies`` (0..laps) of it enter the mix, ``taken`` words in
    all.  Texts do not travel; ``keep`` names columns to carry along, such as
    a row id by which a caller joins them back; those named like one of the
    result's columns or like a working column (``WORKING``) give way."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", source_key(F.col("source")).alias("_src"),
                       word_count(F.col("text")).alias("size"),
                       *unlike(keep, "doc_id", "size", "source_size", "target", "copies", "taken", *WORKING))
    return _queue(rows, weights, share, laps, seed)


def _queue(rows: DataFrame, weights, share, laps, seed) -> DataFrame:
    """The queue over (doc_id, _src, size, ...)."""
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    keyed = rows.withColumn("_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    order = [F.col("_src"), F.col("_key"), F.col("doc_id"), F.col("size")]
    t = range_sorted(keyed, order, "mix-rows")
    per = stored(t.groupBy("_pid", "_src").agg(F.sum("size").alias("_sum")), "mix-ranges")
    targets = source_targets(per.groupBy("_src").agg(F.sum("_sum").alias("source_size")), weights, share, laps)
    off = per.withColumn("_off", F.sum("_sum").over(Window.partitionBy("_src").orderBy("_pid")) - F.col("_sum"))
    off = off.join(targets, "_src").drop("_sum")
    run = Window.partitionBy("_pid", "_src").orderBy("_idx")
    cum = t.withColumn("_cum", F.sum("size").over(run)).join(off, ["_pid", "_src"])
    cum = cum.withColumn("_cum", F.col("_cum") + F.col("_off"))
    base = stored(cum.drop("_pid", "_idx", "_off"), "mix-base")

    def finish(lap: Column) -> Column:
        return F.when(F.col("target") > 0, (F.col("_cum") + lap * F.col("source_size")) / F.col("target"))

    queue = (base.where("size > 0 AND target > 0")
             .withColumn("_lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))
             .select(finish(F.col("_lap")).alias("_fin"), *PLACE, "_lap"))
    cut = _cut(queue, share)
    if cut is None:
        kept = F.lit(0)
    else:
        last = F.struct(F.lit(cut["_fin"]), *[F.lit(cut[c]).cast(base.schema[c].dataType) for c in PLACE],
                        F.lit(cut["_lap"]))
        kept = sum((F.when(F.struct(finish(F.lit(k)), *PLACE, F.lit(k)) <= last, 1).otherwise(0)
                    for k in range(laps)), F.lit(0))
    kept = F.when((F.col("size") > 0) & (F.col("target") > 0), kept).otherwise(0)
    return (base.withColumn("copies", kept).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
            .drop("_mid", "_cum", "_src", "_key"))


def _cut(queue: DataFrame, share: float):
    """The last entry of the queue whose running words stay within the
    budget, or None when none does.  Only the one range that holds the
    cut is scanned row by row."""
    order = ["_fin", *PLACE, "_lap"]
    s = range_sorted(queue, [F.col(c) for c in order], "mix-queue")
    sums = s.groupBy("_pid").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_pid")) - F.col("_sum")
    sums = stored(sums.withColumn("_off", before), "mix-queue-sums")
    total = queue.where("_lap = 0").agg(F.sum("size")).first()[0]
    if not total:
        return None
    budget = share * total
    first = sums.where(F.col("_off") <= budget).orderBy(F.col("_pid").desc()).limit(1).first()
    run = Window.partitionBy("_pid").orderBy("_idx")

    def last(pid: int, off: int):
        rows = s.where(F.col("_pid") == pid).withColumn("_cum", F.sum("size").over(run) + F.lit(off))
        return rows.where(F.col("_cum") <= budget).agg(F.max(F.struct(*order))).first()[0]

    hit = last(first["_pid"], first["_off"])
    if hit is None:
        prev = sums.where(F.col("_pid") < first["_pid"]).orderBy(F.col("_pid").desc()).limit(1).first()
        hit = last(prev["_pid"], prev["_off"]) if prev else None
    return hit
