"""Sharding by a keyed permutation of global row numbers.

Rows are numbered in doc_id order (ties by checksum, then size), the numbers
go through a Feistel network on pairs of base-``m`` digits, ``m`` the square
root of the row count rounded up, and a number that lands outside the rows is
walked along its cycle until it falls inside.  The permuted number ``p`` gives
shard ``p % shards`` and slot ``p // shards``, so counts differ by one at most
(law ``rows``) and anyone holding (rows, seed) can compute a row's place.

DataFrame expressions only.  Null texts count as empty; null ids come first in
the numbering; repeated rows get numbers of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, prepare

SHARDS = 16
SEED = 20260
ROUNDS = 6
#: Moduli of the round function; products stay below 2**62.
P1, P2 = 2147483647, 2147483629


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, from a linear recurrence."""
    x, keys = seed % P1 or 1, []
    for _ in range(rounds):
        x = (x * 48271) % P1
        a = x
        x = (x * 48271) % P1
        keys.append((a, x))
    return keys


def permute_once(x: int, m: int, keys: list[tuple[int, int]]) -> int:
    """The network on plain integers (what the column form computes)."""
    left, right = divmod(x, m)
    for a, b in keys:
        left, right = right, (left + ((right * a + b) % P1) ** 2 % P2) % m
    return left * m + right


def _network(x: Column, m: int, keys: list[tuple[int, int]]) -> Column:
    rounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                       for a, b in keys])
    m_ = F.lit(m).cast("long")

    def step(s: Column, k: Column) -> Column:
        v = F.pmod(s["r"] * k["a"] + k["b"], F.lit(P1).cast("long"))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(v * v, F.lit(P2).cast("long")), m_).alias("r"))

    low = F.pmod(x, m_)
    start = F.struct(F.call_function("div", x - low, m_).alias("l"), low.alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * m_ + s["r"])


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """Column form of the permutation of 0..n-1.  A walk leaves the rows for
    at most ``m*m - n`` steps, which bounds the sequence; it is evaluated only
    for the few numbers whose first image lies outside."""
    m = max(1, math.isqrt(max(n - 1, 0)) + 1)
    keys = round_keys(seed)
    n_ = F.lit(n).cast("long")
    first = _network(x, m, keys)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(m * m - n + 1)), first,
                       lambda acc, _: F.when(acc < n_, acc).otherwise(_network(acc, m, keys)))
    return F.when(first < n_, first).otherwise(walk)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    ranked = global_rank(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "feistel")
    n = ranked.count()
    return (ranked.withColumn("_p", permute(F.col("rank"), n, seed))
            .select("doc_id", "size", "text_crc32",
                    F.pmod("_p", F.lit(shards).cast("long")).cast("int").alias("shard"),
                    F.expr(f"_p div {shards}").alias("slot")))
