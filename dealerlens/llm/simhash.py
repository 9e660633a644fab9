"""SimHash fingerprints and the search for close ones.

A text's terms are its runs of ``width`` words, the text padded with blanks at
both ends so that short texts have terms too.  Each occurrence of a term votes
with its hash's signed bits, so a term weighs as often as it occurs; the sign
of every bit's sum is the fingerprint's bit (a tie gives 1).

Search: the bits are cut into ``radius + extra`` blocks; two fingerprints
within the radius agree on at least ``extra`` blocks, so each choice of
``extra`` blocks is a table in which they meet.  Candidates are verified by
their Hamming distance.  Equal fingerprints are one class beforehand, so
copies are never paired.

Defined results: null, empty and blank texts have no words and share the
fingerprint of no terms, all ones; repeated rows get equal fingerprints; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, prepare, spare, stored, unlike
from .words import MIX1, hashes, scramble

BITS = 128
WIDTH = 5
_PAD = np.uint64(0xB1A4)


def votes(text: str, width: int = WIDTH, bits: int = BITS) -> np.ndarray:
    """Signed sums per bit over all term occurrences."""
    words = text.split()
    if not words:
        return np.zeros(bits, np.int64)
    w = np.full(len(words) + 2 * (width - 1), _PAD, np.uint64)
    w[width - 1:width - 1 + len(words)] = hashes(words)
    n = len(words) + width - 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = scramble(h * MIX1 + w[k:k + n])
    total = np.zeros(bits, np.int64)
    lanes = [scramble(h + np.uint64(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) for j in range(bits // 64)]
    both = np.stack(lanes, 1)
    for at in range(0, n, 4096):
        part = np.unpackbits(both[at:at + 4096].view(np.uint8), axis=1)
        total += 2 * part.sum(0, dtype=np.int64) - len(part)
    return total


def fingerprint(text: str | None, width: int = WIDTH, bits: int = BITS) -> str:
    """Hexadecimal fingerprint."""
    return np.packbits(votes(text or "", width, bits) >= 0).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal bits."""
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (4 * len(a))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint",
                 keep: tuple[str, ...] | None = None, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the fingerprint of ``text`` as
    ``out``, to which a column of that name gives way."""
    prepare(docs.sparkSession)
    keep = unlike(docs.columns if keep is None else keep, out)
    inner = docs.select(*keep, F.col(text).alias(spare(keep, "__text")))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            f = [fingerprint(t, width, bits) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(f, pa.string())],
                                             names=[*keep, out])

    return inner.mapInArrow(run, schema)


def _distance(a: Column, b: Column) -> Column:
    """Hamming distance of two hexadecimal columns, 60 bits at a time."""
    total = F.lit(0)
    for k in range(0, BITS // 4, 15):
        x, y = (F.conv(F.substring(c, k + 1, min(15, BITS // 4 - k)), 16, 10).cast("long") for c in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def near_pairs(prints: DataFrame, radius: int, extra: int = 2, column: str = "fingerprint") -> DataFrame:
    """(a, b, distance), a < b: all pairs of different fingerprints of
    ``prints`` within ``radius`` bits.  Expand to rows through the column."""
    digits = BITS // 4
    blocks = radius + extra
    if blocks > digits:
        raise ValueError("radius too large for blocks of whole hexadecimal digits")
    cuts = np.linspace(0, digits, blocks + 1).astype(int)
    block = [F.substring("f", int(lo) + 1, int(hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    one = stored(prints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct(), "simhash-classes")
    keys = F.array(*[F.concat_ws("-", F.lit(str(k)), *[block[i] for i in c])
                     for k, c in enumerate(combinations(range(blocks), extra))])
    table = one.select("f", F.explode(keys).alias("key"))
    a, b = table.withColumnRenamed("f", "a"), table.withColumnRenamed("f", "b")
    pairs = a.join(b, "key").where("a < b").select("a", "b", _distance(F.col("a"), F.col("b")).alias("distance"))
    return pairs.where(F.col("distance") <= radius).distinct()


def with_edits(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half
    (rounded down, in code points) is replaced by as many first code points of
    the next document in falling doc_id order (after the last: the first).

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.)  Documents are dealt into id ranges; the first
    document of a range is also given to the range before it, so that a task
    reads its documents in order and always finds the next.  Equal ids follow
    the order of their texts; null ids come last."""
    spark = prepare(docs.sparkSession)
    ranges = max(16, partitions(spark))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_cuts = [k / ranges for k in range(1, ranges)]
    ids = rows.where("doc_id IS NOT NULL")
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", n_cuts, 0.2 / ranges) or []), reverse=True)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1))
    lows = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = bucket.otherwise(F.size(F.filter(lows, lambda c: c >= F.col("doc_id")))).cast("int")
    dealt = rows.withColumn("bucket", bucket)
    first = (dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).select("bucket", "top"))
    have = [(r["bucket"], r["top"]) for r in first.collect()]  # one row per range
    have.sort()
    send = {have[k][0]: have[k - 1][0] for k in range(len(have))}  # the first range's first goes to the last
    tops = spark.createDataFrame([(b, t, send[b], i == 0) for i, (b, t) in enumerate(have)],
                                 "bucket int, top long, to int, wraps boolean")
    heads = (dealt.join(F.broadcast(tops), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")))
             .groupBy("bucket", "to", "wraps").agg(F.min("text").alias("text")))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("bucket"),
                         F.lit(1).alias("sentinel"))
    every = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("sentinel")).unionByName(heads)
    laid = (every.repartitionByRange(ranges, "bucket")
            .sortWithinPartitions("bucket", "sentinel", F.col("doc_id").desc_nulls_last(), "text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
                           T.StructField("fingerprint", T.StringType()),
                           T.StructField("edited_fingerprint", T.StringType()),
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        from hashlib import sha256
        held = None  # (doc_id, text, fingerprint) that waits for its next document
        for b in batches:
            out = []
            for doc, text, sentinel in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(),
                                           b.column("sentinel").to_pylist(), strict=True):
                own = fingerprint(text, width, bits)
                if held:
                    old, before, f = held
                    half = len(before) // 2
                    edited = before[:len(before) - half] + text[:half]
                    g = f if edited == before else fingerprint(edited, width, bits)
                    out.append((old, len(before), sha256(edited.encode("utf-8", "replace")).hexdigest(), f, g,
                                likeness(f, g), likeness(f, own)))
                held = None if sentinel else (doc, text, own)
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                       pa.float64(), pa.float64()), strict=True)],
                names=[f.name for f in schema])

    return laid.select("doc_id", "text", "sentinel").mapInArrow(run, schema)
