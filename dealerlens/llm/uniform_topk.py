"""Exact top-k inner products by the three-phase uniform threshold.

A score is the sum of ``PARTS`` partial scores, each over every ``PARTS``-th
component; a list holds one part's scores of one query.  Lists are computed in
cells of a grid, a block of queries against a chunk of vectors, by one matrix
product per part.  Partial scores count from the list's lowest value.

1. Every cell gives, per query and part, its list's ``k`` highest entries with
   their whole scores, the last of those entries' partial score, and the list's
   lowest value.  The k-th highest score among them is a safe cutoff: k rows
   reach it.
2. A row that reaches the cutoff has a part of at least the cutoff's share, the
   uniform threshold.  Where the last listed entry of each part lies below it,
   phase 1 has listed all that could count; to the other cells the query goes
   once more, with the cutoff and the lowest values, and they collect the
   entries above the threshold.
3. Entries whose remaining parts don't lift them to the cutoff go; the few left
   of both phases have exact scores and are ranked.

Vectors with equal components tie everywhere, so only the ``k + 1`` smallest
ids of each distinct vector can rank (one may be the query's own); the others
are left out of the lists without loss.

Defined results: vectors that are null, or hold null or non-finite
components, and rows without an id take no part; equal rows count once; an id
with several vectors is a candidate with each and queries with the least;
shorter vectors are filled with zeros; empty vectors score 0; other columns
are ignored.  Scores are exact for components of any size (whole numbers of
any length where doubles would round); a part of a score beyond 2**61 raises an
error, since sums of scores have to fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

K = 10
PARTS = 2
SCALE = 1024
BLOCK_QUERIES = 1024
CHUNK_VECTORS = 4096
#: Doubles are exact up to here; parts below there have 64-bit sums and bounds.
EXACT, FITS = 1 << 53, 1 << 61
#: Rows of large components that are multiplied at a time.
SLICE = 64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the rows that take part; ``q`` holds whole numbers as
    doubles, which are exact: a double beyond 2**53 is whole."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v):
        y = F.lit(float(scale)) * v.cast("double")
        # no negative zero: equal vectors have equal components
        return F.when(F.abs(y) < float(EXACT), F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)

    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q")))


def _matrix(rows: pd.Series, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def _whole(a: np.ndarray) -> np.ndarray:
    """Python integers."""
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)


def _partials(queries: pd.Series, vectors: pd.Series) -> list[np.ndarray]:
    """Integer partial scores (queries x vectors) of every part: by doubles
    where those are exact, by Python's integers in the rows of larger
    components."""
    width = max(map(len, [*queries, *vectors]), default=0)
    a, b = _matrix(queries, width, float), _matrix(vectors, width, float)
    if not np.isfinite(a).all() or not np.isfinite(b).all():
        raise ValueError("a component does not fit a double after scaling")
    limit = np.sqrt(EXACT / max(width, 1)) - 1
    large_a, large_b = np.abs(a).max(1, initial=0) > limit, np.abs(b).max(1, initial=0) > limit
    out = []
    for j in range(PARTS):
        x, y = a[:, j::PARTS], b[:, j::PARTS]
        p = (np.where(large_a[:, None], 0, x) @ np.where(large_b[:, None], 0, y).T).astype(np.int64)
        for rows, whole in ((np.flatnonzero(large_a), np.arange(len(b))),
                            (np.flatnonzero(~large_a), np.flatnonzero(large_b))):
            other = _whole(y[whole]).T if len(rows) and len(whole) else None
            for k in range(0, len(rows), SLICE) if other is not None else ():
                r = rows[k:k + SLICE]
                exact = _whole(x[r]) @ other if x.shape[1] else np.zeros((len(r), len(whole)), object)
                if max(abs(exact.max()), abs(exact.min())) >= FITS:
                    raise ValueError("a partial score does not fit 61 bits")
                p[np.ix_(r, whole)] = exact.astype(np.int64)
        out.append(p)
    return out


LISTS = "query_id long, chunk int, part int, row long, vec_id long, score long, last long, low long"
RESOLVED = "query_id long, vec_id long, row long, score long"


def _frame(schema: str, *columns) -> pd.DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return pd.DataFrame(dict(zip(names, columns or [[]] * len(names), strict=True)))


def _lists(k: int):
    def lists(cell, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """Phase 1 in one cell; ``last`` is null where a list has no more."""
        out = [_frame(LISTS)]
        if len(queries) and len(vectors):
            parts = _partials(queries["q"], vectors["q"])
            score = sum(parts)
            asker, ids, rows = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
            own = asker[:, None] == ids[None, :]
            n = min(k, len(vectors))
            more = (~own).sum(1) > n
            for j, p in enumerate(parts):
                low = p.min(1)
                top = np.argpartition(np.where(own, np.iinfo(np.int64).max, -p), n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(len(asker)), n)
                c = top.ravel()
                last = pd.array(np.take_along_axis(p, top, 1).min(1), "Int64")
                last[~more] = pd.NA
                use = ~own[i, c]
                i, c = i[use], c[use]
                out.append(_frame(LISTS, asker[i], int(cell[1]), j, rows[c], ids[c], score[i, c], last[i], low[i]))
        return pd.concat(out)

    return lists


def _resolve(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """Phases 2 and 3 in one cell: the entries above the uniform threshold,
    and of those the ones whose whole score reaches the cutoff."""
    if not len(queries) or not len(vectors):
        return _frame(RESOLVED)
    parts = _partials(queries["q"], vectors["q"])
    asker, ids = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
    cutoff, lows = queries["cutoff"].to_numpy(np.int64), _matrix(queries["lows"], PARTS, np.int64)
    above = cutoff - lows.sum(1)
    collected = np.zeros(parts[0].shape, bool)
    for j, p in enumerate(parts):
        collected |= (p - lows[:, j:j + 1]) * PARTS >= above[:, None]
    collected &= asker[:, None] != ids[None, :]
    i, c = np.nonzero(collected)
    score = sum(p[i, c] for p in parts)
    left = score >= cutoff[i]
    i, c = i[left], c[left]
    return _frame(RESOLVED, asker[i], ids[c], vectors["row"].to_numpy()[c], score[left])


def top_k(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``every``
    the ``k`` best other rows, ties to the smaller id."""
    prepare(vectors.sparkSession)
    rows = stored(quantised(vectors).groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("n")).drop("n")
                  .withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"))
                     .agg(F.min("q").alias("q")), "topk-queries")
    place = F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))
    able = stored(rows.withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place"), "topk-vectors")
    chunks = max(1, -(-able.count() // CHUNK_VECTORS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    cell = ["block", "chunk"]

    def every_one(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")

    dealt = (able.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
             .withColumn("block", every_one(blocks)).groupBy(cell))

    # 1: local lists, cutoff and lowest values
    asked = queries.withColumn("block", block).withColumn("chunk", every_one(chunks))
    lists = stored(asked.groupBy(cell).cogroup(dealt).applyInPandas(_lists(k), LISTS), "topk-lists")
    best = lists.groupBy("query_id", "row").agg(F.max("score").alias("score"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    # with fewer than k rows in all, everything counts
    kth = F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(-(1 << 62)))
    cutoff = best.withColumn("_n", n).where(F.col("_n") <= k).groupBy("query_id").agg(kth.alias("cutoff"))
    low = lists.groupBy("query_id").pivot("part", list(range(PARTS))).agg(F.min("low"))
    low = low.select("query_id", F.array(*[F.col(str(j)) for j in range(PARTS)]).alias("lows"))

    # 2: the cells whose lists may lack entries above the threshold
    bounds = stored(cutoff.join(low, "query_id"), "topk-bounds")
    whole = F.aggregate("lows", F.lit(0).cast("long"), lambda s, x: s + x)
    over = (F.col("last") - F.col("lows")[F.col("part")]).cast("decimal(38,0)") * PARTS >= F.col("cutoff") - whole
    cells = (lists.groupBy("query_id", "chunk", "part").agg(F.min("last").alias("last")).join(bounds, "query_id")
             .where(over).select("query_id", "chunk").distinct())
    cells = stored(cells, "topk-again")
    again = queries.join(bounds, "query_id").join(cells, "query_id").withColumn("block", block)
    collected = again.groupBy(cell).cogroup(dealt).applyInPandas(_resolve, RESOLVED)

    # 3: what reaches the cutoff, ranked
    listed = (lists.join(bounds, "query_id").where("score >= cutoff")
              .select("query_id", "vec_id", "row", "score"))
    exact = (listed.unionByName(collected).groupBy("query_id", "row")
             .agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
