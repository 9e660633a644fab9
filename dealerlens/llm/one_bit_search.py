"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred on their mean, rotated by a random matrix into ``BITS``
bits a component, and only the signs are kept, packed into 64-bit words.  With
o a centred unit vector, x the unit vector of its signs and f = <x, o>, the
inner product of o and a centred query s is estimated by <x, s> / f; its error
has the scale |s| * sqrt(1 / f**2 - 1) / sqrt(bits - 1), so ``BOUND`` times
that scale bounds it nearly always.  The correction scalars of a vector are its
centred length, f and its inner product with the mean.  A query is rotated too
and rounded to ``PLANES`` bits a dimension; <x, s> is then a weighted sum of
bit counts of code and bit plane.

Queries and codes meet in a grid of blocks and chunks.  In a cell a query first
takes the vectors with the best estimates, whose exact inner products give a
cutoff that the cell's k-th best reaches; every vector whose estimate plus its
error bound reaches the cutoff is chosen and ranked by its exact inner
product in double precision.  The cells' lists of k are merged.  A vector that
very many rows hold is spread over all chunks like different ones.

Every row is indexed.  The mean covers all rows; the rotation depends on the
dimension and a seed only, so any task computes it for itself.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without an id take no part; equal rows count once; an id
with several vectors is a candidate with each and queries with the least;
shorter vectors are filled with zeros; equal scores go to the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

K, EVERY = 20, 20
#: Bits of a code for each component, and of a query's rounded dimensions.
BITS, PLANES = 2, 5
#: Error scales that an estimate may be off.
BOUND = 2.5
SEED = 7
BLOCK_QUERIES = 1024
CHUNK_VECTORS = 16384

ONE = np.uint64(1)


@lru_cache(maxsize=2)
def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """``width`` orthonormal columns in a whole number of 64-bit words."""
    bits = max(64, -(-BITS * width // 64) * 64)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, width)))[0]


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def encoded(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code words, correction scalars: centred length, f, <vector, mean>)."""
    turn = rotation(x.shape[1])
    v = (x - mean) @ turn.T
    length = np.linalg.norm(v, axis=1)
    f = np.abs(v).sum(1) / np.sqrt(turn.shape[0]) / np.where(length > 0, length, 1)
    return packed(v > 0), np.column_stack([length, np.where(length > 0, f, 1.0), x @ mean])


class Query:
    """One query against codes."""

    def __init__(self, x: np.ndarray, mean: np.ndarray):
        s = rotation(len(x)) @ (x - mean)
        self.length, self.shift, self.bits = np.linalg.norm(s), float((x - mean) @ mean), len(s)
        self.low = s.min()
        self.step = (s.max() - self.low) / ((1 << PLANES) - 1) or 1.0
        level = np.rint((s - self.low) / self.step).astype(np.int64)
        self.total = self.low * self.bits + self.step * level.sum()
        self.planes = packed((level[None, :] >> np.arange(PLANES)[:, None]) & 1)

    def estimates(self, code: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products with the vectors, error bounds).  ``code``
        holds one row a word, ``scalars`` one row a scalar."""
        ones = np.zeros(code.shape[1], np.int64)
        hits = np.zeros(code.shape[1], np.int64)
        for word, row in enumerate(code):
            ones += np.bitwise_count(row)
            for p in range(PLANES):
                hits += np.bitwise_count(row & self.planes[p, word]).astype(np.int64) << p
        # signs are +1 where a bit is set and -1 elsewhere
        along = 2 * (self.low * ones + self.step * hits) - self.total
        length, f, own = scalars
        scale = length / f
        off = self.length * np.sqrt(np.maximum(1 - f * f, 0) / (self.bits - 1)) + self.step / np.sqrt(12)
        return scale * along / np.sqrt(self.bits) + own + self.shift, BOUND * scale * off


FOUND = "query_id long, vec_id long, row long, score double"


def _search(k: int, mean: np.ndarray):
    def cell(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = np.empty(0, np.int64)
        out = [(none, none, none, np.empty(0))]
        if len(queries) and len(vectors):
            x = matrix(vectors["x"], len(mean))
            ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
            code = np.ascontiguousarray(matrix_of_words(vectors["code"]).T)
            scalars = np.ascontiguousarray(matrix(vectors["scalars"], 3).T)
            for asker, q in zip(queries["query_id"].to_numpy(), matrix(queries["x"], len(mean)), strict=True):
                got, score = best(Query(q, mean), q, x, ids, code, scalars, ids != asker, k)
                out.append((np.full(len(got), asker), ids[got], rows[got], score))
        names = [f.split()[0] for f in FOUND.split(", ")]
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    return cell


def matrix_of_words(code: pd.Series) -> np.ndarray:
    return np.array(code.tolist(), np.int64).view(np.uint64)


def best(query: Query, q: np.ndarray, x: np.ndarray, ids: np.ndarray, code: np.ndarray, scalars: np.ndarray,
         other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the ``k`` nearest chosen vectors."""
    about, off = query.estimates(code, scalars)
    about = np.where(other, np.nan_to_num(about, nan=np.inf), -np.inf)
    reach = np.where(other, np.nan_to_num(about + off, nan=np.inf, posinf=np.inf), -np.inf)
    n = min(len(about), 2 * k)
    pilot = np.argpartition(-about, n - 1)[:n]
    pilot = pilot[other[pilot]]
    cutoff = -np.inf
    if len(pilot) >= k:
        cutoff = np.sort((x[pilot] * q).sum(1))[-k]
    picked = other & (reach >= cutoff)
    picked[pilot] = True
    chosen = np.flatnonzero(picked)
    score = (x[chosen] * q).sum(1)
    order = np.lexsort((ids[chosen], -score))[:k]
    return chosen[order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite & F.exists(x, lambda v: v != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x")))


def mean_of(rows: DataFrame) -> np.ndarray:
    """Mean of all vectors; as long as the longest."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return np.zeros(0)
    return np.array(rows.agg(*[F.avg(F.coalesce(F.get("x", F.lit(i)), F.lit(0.0))) for i in range(width)]).first(), float)


def index(rows: DataFrame, mean: np.ndarray) -> DataFrame:
    """``rows`` with their code and correction scalars."""
    def run(batches):
        for pdf in batches:
            code, scalars = encoded(matrix(pdf["x"], len(mean)), mean)
            yield pdf.assign(code=list(code.view(np.int64)), scalars=list(scalars))

    return rows.mapInPandas(run, "vec_id long, x array<double>, row long, code array<long>, scalars array<double>")


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``every``
    the ``k`` nearest other rows found."""
    prepare(vectors.sparkSession)
    rows = stored(usable(vectors).groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("n")).drop("n")
                  .withColumn("row", F.monotonically_increasing_id()), "onebit-rows")
    mean = mean_of(rows)
    codes = stored(index(rows, mean), "onebit-codes")
    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"))
                     .agg(F.min("x").alias("x")), "onebit-queries")
    chunks = max(1, -(-codes.count() // CHUNK_VECTORS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    cell = ["block", "chunk"]

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))

    asked = dealt(queries, "query_id", "block", blocks, "chunk", chunks).groupBy(cell)
    held = dealt(codes, "row", "chunk", chunks, "block", blocks).groupBy(cell)
    found = asked.cogroup(held).applyInPandas(_search(k, mean), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
