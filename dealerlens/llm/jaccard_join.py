"""N-gram Jaccard join by a partition of the shingle universe.

Documents are sets of word shingles; two link when their sets' Jaccard
similarity reaches ``num / den``.  Equal sets are one class, represented by
its smallest id, and only representatives go on.

Candidates.  Set sizes fall into bands whose ends differ by the similarity at
most, so linked sets lie in one band or in neighbouring ones.  In the scheme
of a band two linked sets differ in at most ``H`` shingles.  Hashing deals the
universe into ``m = H + 1`` segments.  If segment ``i`` is given ``v_i`` in
{0, 1, 2} with the ``v_i`` adding up to ``H + 1``, some segment differs in
fewer than ``v_i`` shingles: it is equal (v = 1) or equal after dropping one
shingle (v = 2).  A set is indexed by every segment's subset and, in the last
``q`` segments, by its one-deletion neighbours.  It probes as its own costs
suggest: empty segments, whose lists are long, get 0, and as many of the last
segments, those with the rarest neighbourhoods first, get 2.  A pair meets
if either member probes for it.  On the way to its list a signature names its
document by 32 bits; ids and sizes are joined to the lists, which are few.

Candidates whose parity sketches differ in more bits than linked sets may
differ in shingles are dropped at once: a bit of the sketch is the parity of
the shingles hashed to it, so each differing shingle flips one bit at most.
Large sets have a second sketch with as many bits as shingles, which only the
pairs that pass the first, a few of each document, are joined with: whole sets
travel once for each pair that passes both.
Verification is exact, on whole sets.  Only components are wanted, so a list
is not expanded into all its pairs: in a few rounds each list's members meet
the list's pivot, a document is verified against one pivot of each component
that it met, and components are formed; what still lies in different components
of a list is then verified pair by pair, a pair of many lists in the first of
them as far as the first few lists of both tell.  Every pair that shares a list
is thus verified or already connected.  Whole sets are made only of documents
that a round's pairs name, and deleted when it ends.

Words and shingles are compared through 64-bit hashes, equal sets through
128-bit digests.

Defined results: null, empty and blank texts have no shingles and form
components of their own; repeated rows get equal results; rows sharing an id
with different texts are one vertex; rows without an id link with nothing and
have no component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest, xxh64_intdigest

from .common import components, partitions, passing, prepare, stored, within, without
from .words import MIX1, scramble

WIDTH, NUM, DEN = 5, 80, 100
#: Rounds of verification against one pivot per list.
PIVOT_ROUNDS = 4
#: Lists of a document that tell whether a pair was made in an earlier list.
FIRST_LISTS = 8
#: Shingles per bucket of signatures; a shingle has about one signature of ten
#: bytes (of 18 in the task that sorts them).
BUCKET_SHINGLES = 1_000_000
#: 64-bit words of the parity sketch.
SKETCH = 8


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes.  bytes.lower() folds A-Z only and
    bytes.split() splits at the six blanks of the contract."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, k if k < width else 0, np.uint64)
    for j in range(k):
        h = scramble(h * MIX1 + w[j:j + n])
    return np.unique(h)


@lru_cache(maxsize=None)
def band_starts(num: int, den: int, top: int) -> tuple[int, ...]:
    """First sizes of the bands up to the one that holds ``top``."""
    starts = [1]
    while starts[-1] <= top:
        starts.append(starts[-1] * den // num + 1)
    return tuple(starts)


@lru_cache(maxsize=None)
def scheme(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """(segments, segments indexed with neighbourhoods) for pairs whose
    smaller set has lo..hi shingles."""
    most = hi + hi * den // num
    m = most * (den - num) // (den + num) + 1
    empty = m * exp(-lo / m)
    two = 1 - exp(-lo / m) * (1 + lo / m)  # of the segments hold two shingles or more
    return m, min(m, ceil((empty + 3 * sqrt(empty)) / two) + 1)


def signatures(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes, whether the set probes with each)."""
    size = len(s)
    starts = band_starts(num, den, max(64, 1 << size.bit_length()))
    own = int(np.searchsorted(starts, size, side="right")) - 1
    sigs, probes = [], []
    for band in (own, own - 1):
        if band < 0:
            continue
        lo, hi = starts[band], starts[band + 1] - 1
        if band < own and hi * den < size * num:
            continue
        m, q = scheme(lo, hi, num, den)
        if m == 1:
            continue  # only equal sets
        seg = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, val = seg[order], scramble(s[order])
        count = np.bincount(seg, minlength=m)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(val, dtype=np.uint64)))
        end = np.cumsum(count)
        total = run[end] - run[end - count]
        tag = scramble(np.arange(m, dtype=np.uint64) + np.uint64((band << 32) + 1))
        sigs.append(scramble(total ^ tag))
        skipped = int((count == 0).sum())
        probe = count > 0
        last = np.arange(m - q, m)
        # the fuller a segment, the fewer share it less one shingle; less its
        # only shingle it would be the empty one
        two = last[np.argsort(-count[last], kind="stable")]
        two = two[count[two] > 1][:skipped]
        if len(two) < skipped:  # too few: probe the first empty ones after all
            probe[np.flatnonzero(count == 0)[:skipped - len(two)]] = True
        probes.append(probe)
        tail = seg >= m - q
        sigs.append(scramble((total[seg[tail]] - val[tail]) ^ tag[seg[tail]]))
        deep = np.zeros(m, bool)
        deep[two] = True
        probes.append(deep[seg[tail]])
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, bool)
    return np.concatenate(sigs), np.concatenate(probes)


def key(doc_id: int | None, s: np.ndarray) -> int:
    """32 bits of an id and a set, by which signatures name their row."""
    return xxh64_intdigest(s.tobytes(), (doc_id or 0) & 0xFFFFFFFFFFFFFFFF) & 0xFFFFFFFF


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, key) of every row; equal digests, equal sets."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            found = [shingles(t, width) for t in b.column("text").to_pylist()]
            keys = [key(d, s) for d, s in zip(b.column("doc_id").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in found], pa.int64()),
                 pa.array([xxh3_128_hexdigest(s.tobytes()) for s in found], pa.string()), pa.array(keys, pa.int64())],
                names=["doc_id", "n_shingles", "digest", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest string, key long")


def _signature_blobs(reps: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(bucket, blob): the signatures of some hundred documents that fall into
    one bucket, ten bytes each and nothing else, so that more buckets don't take
    more room: 48 bits of the signature, the lowest telling whether the document
    probes with it, and the document's key."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            sig, doc = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(t, width)
                if len(s):
                    g, p = signatures(s, num, den)
                    sig.append((g << np.uint64(1)) | p.astype(np.uint64))
                    doc.append(np.full(len(g), key(d, s), "<u4"))
            if not sig:
                continue
            sig, doc = np.concatenate(sig), np.concatenate(doc)
            place = ((sig >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=buckets))
            sig, doc = sig[order], doc[order]
            low = ((sig >> np.uint64(16)) & np.uint64(0xFFFFFFFE) | sig & np.uint64(1)).astype("<u4")
            high = (sig >> np.uint64(48)).astype("<u2")
            out = [(k, low[lo:hi].tobytes() + doc[lo:hi].tobytes() + high[lo:hi].tobytes())
                   for k, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if hi > lo]
            for at in range(0, len(out), 256):
                part = out[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()),
                                                  pa.array([x for _, x in part], pa.binary())], names=["bucket", "blob"])

    return reps.mapInArrow(run, "bucket int, blob binary")


def _lists(blobs: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket the rows (sig, key, probe) of all signatures that different
    keys share and one of them probes with."""
    sigs, docs = [], []
    for x in blobs["blob"]:
        rows = len(x) // 10
        sigs.append(np.frombuffer(x, "<u4", rows).astype(np.uint64)
                    | np.frombuffer(x, "<u2", rows, 8 * rows).astype(np.uint64) << np.uint64(32))
        docs.append(np.frombuffer(x, "<u4", rows, 4 * rows))
    sig, doc = np.concatenate(sigs), np.concatenate(docs)
    order = np.argsort(sig, kind="stable")
    sig, doc = sig[order], doc[order]
    probe, sig = (sig & np.uint64(1)).astype(np.int32), sig >> np.uint64(1)
    starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    keep = ((np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))
            & (np.maximum.reduceat(probe, starts) == 1))
    rows = np.repeat(keep, np.diff(np.append(starts, len(sig))))
    bucket = np.uint64(blobs["bucket"].iloc[0])
    return pd.DataFrame({"sig": (sig[rows] | bucket << np.uint64(47)).view(np.int64), "key": doc[rows].astype(np.int64),
                         "probe": probe[rows]})


def sketch(s: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity sketch of a set as ``words`` (a power of two) signed 64-bit words."""
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes | None:
    """Parity sketch with a bit for each shingle at least, of sets that have
    more shingles than SKETCH words have bits: with so few bits the sketches of
    large sets without a common shingle are as close as those of linked ones."""
    return None if len(s) <= 64 * SKETCH else sketch(s, 1 << (-(-len(s) // 64) - 1).bit_length()).tobytes()


def wide_apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ; the longer is folded to the other's bits."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum())


def _sketches(reps: DataFrame, width: int) -> DataFrame:
    """(id, size, wide sketch, k0.. sketch words)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids, sizes, wide, bits = b.column("doc_id"), [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, width)
                sizes.append(len(s))
                wide.append(wide_sketch(s))
                bits.append(sketch(s))
            bits = np.array(bits, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()),
                                              *[pa.array(bits[:, k]) for k in range(SKETCH)]],
                                             names=["id", "size", "wide", *[f"k{k}" for k in range(SKETCH)]])

    return reps.mapInArrow(run, "id long, size long, wide binary, " + ", ".join(f"k{k} long" for k in range(SKETCH)))


def alike(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) without those whose wide sketches (``wide``: id, size,
    wide) differ in more bits than linked sets may differ in shingles."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            x, y, size = (b.column(c).to_pylist() for c in ("wa", "wb", "size"))
            may = pa.array([n is None or wide_apart(p, q) * (den + num) <= n * (den - num)
                            for p, q, n in zip(x, y, size, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(may), b.column("b").filter(may)], names=["a", "b"])

    for x in "ab":
        pairs = pairs.join(wide.select(F.col("id").alias(x), F.col("wide").alias(f"w{x}"), F.col("size").alias(f"n{x}")), x, "left")
    return (pairs.select("a", "b", "wa", "wb", (F.col("na") + F.col("nb")).alias("size"))
            .mapInArrow(run, "a long, b long"))


def _arrays(reps: DataFrame, width: int) -> DataFrame:
    """(id, s sorted shingles)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            found = [shingles(t, width).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    return reps.mapInArrow(run, "id long, s array<long>")


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """Of two rows (id, size, probe, comp): different components, one probes,
    and the sizes don't rule the pair out."""
    least, most = (f(f"{a}.size", f"{b}.size") for f in (F.least, F.greatest))
    return ((F.col(f"{a}.comp") != F.col(f"{b}.comp")) & (F.col(f"{a}.probe") + F.col(f"{b}.probe") > 0)
            & (least * den >= most * num))


def near(a: str, b: str, size: Column, num: int, den: int) -> Column:
    """Sketches that differ in no more bits than linked sets of ``size``
    shingles in all may differ in shingles."""
    apart = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH)), F.lit(0))
    return apart * (den + num) <= size * (den - num)


def list_pairs(now: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ``now`` (sig, id, size, probe, comp) that share a list
    and may link; some come more than once.  ``first`` names the first lists
    that a document probes with: a pair meets in every list that both name, so
    only lists up to the earliest of these make it."""
    first = (now.where("probe = 1").groupBy("id")
             .agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST_LISTS).alias("first")))
    # both sides are one plan, so that they share a shuffle
    rows = now.join(sketches, "id").join(first, "id", "left")
    earliest = F.array_min(F.array_intersect("r.first", "p.first"))
    return (rows.alias("r").join(rows.alias("p"), F.expr("r.sig = p.sig") & (F.col("r.comp") < F.col("p.comp"))
                                 & may_link("r", "p", num, den)
                                 & near("r.k", "p.k", F.col("r.size") + F.col("p.size"), num, den)
                                 & (F.coalesce(earliest, F.col("r.sig")) >= F.col("r.sig")))
            .select(F.least("r.id", "p.id").alias("a"), F.greatest("r.id", "p.id").alias("b")))


def pivot_pairs(now: DataFrame, sketches: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of documents of ``now`` and pivots of their lists that may
    link: in round 0 one pivot for each document, later one of each component."""
    row = F.struct("id", "size", "probe", "comp")
    # first one order for all lists, so that a group's lists agree on a pivot,
    # then an order of each list's own
    order = F.xxhash64("id") if k == 0 else F.xxhash64("sig", "id", F.lit(k))
    pivot = now.groupBy("sig").agg(F.min_by(row, F.struct(order, "id")).alias("p"))
    met = now.select("sig", row.alias("r")).join(pivot, "sig").where(may_link("r", "p", num, den))
    met = (met.groupBy(F.col("r.id").alias("a"), F.col("p.id").alias("b"))
           .agg(F.max(F.col("r.size") + F.col("p.size")).alias("size"), F.max("p.comp").alias("comp")))
    met = met.join(sketches.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a")
    met = met.join(sketches.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    one = ["a"] if k == 0 else ["a", "comp"]
    pairs = (met.where(near("ka", "kb", F.col("size"), num, den)).groupBy(*one)
             .agg(F.min_by("b", F.struct(F.xxhash64("b", F.lit(k)), "b")).alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def listed(named: DataFrame, rows: DataFrame) -> DataFrame:
    """(sig, id, size, probe) of ``named`` (sig, key, probe) by ``rows`` (id,
    key, size).  Rows that happen to share a key stand in each other's lists and
    in one of their own, so that they meet too."""
    shared = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.bitwise_not("key").alias("sig"), "key", F.lit(1).alias("probe")))
    return named.unionByName(shared).join(rows, "key").select("sig", "id", "size", "probe")


def links(reps: DataFrame, rows: DataFrame, buckets: int, width: int = WIDTH, num: int = NUM,
          den: int = DEN) -> DataFrame:
    """(id, comp) of the documents of ``reps`` (doc_id, text) that link with
    another; sets are assumed different.  ``rows`` has their distinct (id, key,
    size).  Signatures are dealt into ``buckets``, each of which one task sorts
    in memory."""
    spark = reps.sparkSession
    lists = Window.partitionBy("sig")
    with passing(spark):
        with passing(spark):
            named = stored(_signature_blobs(reps, width, num, den, buckets).groupBy("bucket")
                           .applyInPandas(_lists, "sig long, key long, probe int"), "jaccard-lists", lasting=True)
        hits = stored(listed(named, rows), "jaccard-hits", lasting=True)
        ids = stored(hits.select(F.col("id").alias("doc_id")).distinct(), "jaccard-ids")
        sketches = stored(_sketches(within(reps, ids, ("doc_id",)), width), "jaccard-sketches", lasting=True)
    wide = sketches.where("wide IS NOT NULL").select("id", "size", "wide")
    sketches = sketches.select("id", F.array(*[f"k{k}" for k in range(SKETCH)]).alias("k"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
        arrays = stored(_arrays(within(reps, ids, ("doc_id",)), width), f"{name}-sets")
        a, b = (arrays.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        size = F.size("sa").cast("long") + F.size("sb")
        out = (pairs.join(a, "a").join(b, "b")
               .select("a", "b", (both * den >= (size - both) * num).alias("linked")))
        return stored(out, name, lasting=True)

    comp, tested = None, None
    for k in range(PIVOT_ROUNDS + 1):
        with passing(spark):
            if comp is None:
                now = hits.withColumn("comp", F.col("id"))
            else:  # only lists that still hold different components
                now = hits.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
                now = (now.withColumn("lo", F.min("comp").over(lists)).withColumn("hi", F.max("comp").over(lists))
                       .where("lo <> hi").drop("lo", "hi"))
                now = stored(now, "jaccard-open")
                if now.isEmpty():
                    break
            if k < PIVOT_ROUNDS:
                pairs = pivot_pairs(now, sketches, k, num, den)
            else:
                pairs = list_pairs(now, sketches, num, den)
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            pairs = stored(alike(pairs, wide, num, den), f"jaccard-met-{k}")
            new = verified(pairs, f"jaccard-pairs-{k}")
        tested = new if tested is None else tested.unionByName(new)
        comp = components(tested.where("linked"), "jaccard")
    return comp


def groups(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    prepare(docs.sparkSession)
    base = stored(sets(docs, width), "jaccard-base")
    known = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    rep_ids = classes.select(F.col("rep").alias("doc_id")).distinct()
    copies = stored(known.select("doc_id").distinct().join(rep_ids, "doc_id", "left_anti"), "jaccard-copies")
    reps = without(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), copies, ("doc_id",))
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    rows = stored(without(known, copies, ("doc_id",)).select(
        F.col("doc_id").alias("id"), "key", F.col("n_shingles").cast("int").alias("size")).distinct(), "jaccard-rows")
    comp = links(reps, rows, max(partitions(docs.sparkSession), -(-total // BUCKET_SHINGLES)), width, num, den)
    # ids that stand for several sets bind those sets' classes together
    held = known.join(classes, "digest").select("doc_id", "rep").distinct()
    held = held.withColumn("lo", F.min("rep").over(Window.partitionBy("doc_id")))
    bind = stored(held.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")), "jaccard-bind")
    if not bind.isEmpty():
        comp = components(bind.unionByName(comp.where("id <> comp").select(
            F.col("id").alias("a"), F.col("comp").alias("b"))), "jaccard-bound")
    rep_comp = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    final = base.join(rep_comp, "digest", "left")
    return final.select("doc_id", "n_shingles",
                        F.when(F.col("doc_id").isNotNull(),
                               F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep"))
                               .otherwise(F.col("doc_id"))).alias("component_id"))
