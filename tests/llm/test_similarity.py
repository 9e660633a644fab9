import random
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dealerlens.llm import jaccard_join, simhash, uniform_topk


def test_fingerprints_follow_overlap():
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(600)]
    a = " ".join(words)
    near = simhash.fingerprint(a + " end")
    half = simhash.fingerprint(" ".join(words[:300]) + " " + " ".join(reversed(words[300:])))
    far = simhash.fingerprint(" ".join(reversed(words)))
    own = simhash.fingerprint(a)
    assert simhash.likeness(own, near) > simhash.likeness(own, half) > simhash.likeness(own, far)
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == "f" * 32


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_near_pairs_equal_brute_force(spark, radius):
    rng = random.Random(radius)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(128)
        prints.append(base)
        for _ in range(3):
            flips = sum(1 << b for b in rng.sample(range(128), rng.randint(0, 8)))
            prints.append(base ^ flips)
    rows = [(f"{p:032x}",) for p in prints] + [(f"{prints[0]:032x}",), (None,)]
    got = simhash.near_pairs(spark.createDataFrame(rows, "fingerprint string"), radius).collect()
    distinct = sorted({f"{p:032x}" for p in prints})
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for i, a in enumerate(distinct) for b in distinct[i + 1:]
            if (int(a, 16) ^ int(b, 16)).bit_count() <= radius}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def check_edits(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = simhash.with_edits(docs).collect()
    assert len(out) == len(rows)
    want = []
    for k, (d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        e = t[:len(t) - half] + after[:half]
        f, g, h = map(simhash.fingerprint, (t, e, after))
        want.append((d, len(t), sha256(e.encode()).hexdigest(), f, g, simhash.likeness(f, g), simhash.likeness(f, h)))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_edited_texts_equal_brute_force(spark, odd_docs, labelled):
    check_edits(odd_docs)
    check_edits(labelled)
    check_edits(labelled.limit(1))
    assert simhash.with_edits(labelled.where("false")).count() == 0
    clash = simhash.fingerprints(labelled.withColumn("FINGERPRINT", F.lit("x")).withColumn("__text", F.lit("y")))
    assert [c.lower() for c in clash.columns].count("fingerprint") == 1
    assert all(r.fingerprint == simhash.fingerprint(r.text) and r["__text"] == "y" for r in clash.collect())


def brute_groups(rows, width, num, den):
    """Component of every id, from all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    comp = {d: d for d in sets}
    while True:
        before = dict(comp)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]):
                    comp[a] = min(comp[a], comp[b])
        if comp == before:
            return {d: (len(s), comp[d]) for d, s in sets.items()}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (1, 50)])
def test_groups_equal_brute_force(spark, width, num):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([2, 5, 12, 40, 150]))
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(docs, width, num, 100).collect()}
    assert got == brute_groups(rows, width, num, 100)
    assert len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize("num", [50, 80, 90])
def test_linked_sets_share_a_signature(num):
    """The pigeonhole: whichever of two linked sets probes, they meet."""
    rng = np.random.default_rng(num)
    linked = 0
    for _ in range(600):
        size = int(rng.integers(1, 25) if rng.random() < 0.4 else rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64) * np.uint64(2654435761))
        drop = int(rng.integers(0, size * (100 - num) // 100 + 1))
        add = rng.integers(0, 2 ** 63, int(rng.integers(0, drop + 1)), dtype=np.uint64) * np.uint64(40503)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], add)))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < num * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        linked += 1
        (sa, pa), (sb, pb) = jaccard_join.signatures(a, num, 100), jaccard_join.signatures(b, num, 100)
        assert set(sa[pa]) & set(sb) and set(sb[pb]) & set(sa)
        assert sum(int(x ^ y).bit_count() for x, y in zip(jaccard_join.sketch(a).view(np.uint64), jaccard_join.sketch(b).view(np.uint64))) \
            <= len(a) + len(b) - 2 * both
    assert linked > 100


def test_signatures_take_no_more_room_in_more_buckets(spark):
    """More input has more buckets: what a bucket holds beside its signatures
    would grow with documents times buckets."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(2000)], k=200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    few, many = (jaccard_join._signature_blobs(docs, 5, 80, 100, n).agg(F.sum(F.length("blob"))).first()[0] for n in (4, 4000))
    assert few == many
    blobs = jaccard_join._signature_blobs(docs, 5, 80, 100, 7).toPandas()
    twice = jaccard_join._signature_blobs(docs.withColumn("doc_id", F.col("doc_id") + 60), 5, 80, 100, 7).toPandas()
    lists = [jaccard_join._lists(b) for _, b in pd.concat([blobs, twice]).groupby("bucket")]
    want = {i: jaccard_join.key(i, jaccard_join.shingles(rows[i % 60][1], 5)) for i in range(120)}
    got = pd.concat(lists).groupby("sig")["key"].agg(set)
    assert {frozenset(g) for g in got} == {frozenset((want[i], want[i + 60])) for i in range(60)}


def test_rows_that_share_a_key_meet(spark):
    named = spark.createDataFrame([(5, 1, 1), (5, 2, 0)], "sig long, key long, probe int")
    rows = spark.createDataFrame([(10, 1, 30), (11, 1, 31), (12, 2, 32)], "id long, key long, size int")
    got = jaccard_join.listed(named, rows).collect()
    assert {tuple(r) for r in got if r.sig == 5} == {(5, 10, 30, 1), (5, 11, 31, 1), (5, 12, 32, 0)}
    assert {(r.id, r.size, r.probe) for r in got if r.sig != 5} == {(10, 30, 1), (11, 31, 1)}
    assert len({r.sig for r in got}) == 2


@pytest.mark.parametrize("num", [50, 80, 90])
def test_wide_sketches_lose_no_linked_sets(num):
    rng = np.random.default_rng(num)
    far = 0
    for _ in range(150):
        a = rng.integers(0, 2 ** 63, int(rng.integers(500, 6000)), dtype=np.uint64)
        drop = int(rng.integers(0, len(a) * (100 - num) // 100 + 1))
        b = np.concatenate((a[drop:], rng.integers(0, 2 ** 63, int(rng.integers(0, drop + 1)), dtype=np.uint64)))
        other = rng.integers(0, 2 ** 63, len(b), dtype=np.uint64)
        x, y, z = map(jaccard_join.wide_sketch, (a, b, other))
        assert (x is None) == (len(a) <= 512)
        if x is not None and y is not None:
            size = len(a) + len(b)
            assert jaccard_join.wide_apart(x, y) == jaccard_join.wide_apart(y, x) <= size - 2 * len(np.intersect1d(a, b))
            far += num == 50 or jaccard_join.wide_apart(x, z) * (100 + num) > size * (100 - num)
    assert far > 100


def test_whole_sets_meet_only_in_pairs_that_wide_sketches_leave(spark, monkeypatch):
    """Large documents with a passage in common are no reason to join whole sets."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9000)]
    passage = rng.choices(words, k=2000)
    rows = [(i, " ".join(rng.choices(words, k=3000) + passage)) for i in range(8)]
    rows.append((8, rows[7][1] + " and more"))
    made = {}
    write = jaccard_join.stored

    def stored(df, name, lasting=False):
        out = write(df, name, lasting)
        if name.startswith("jaccard-pairs-") and "a" in out.columns:
            made[name] = {(r.a, r.b) for r in out.collect()}
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    got = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(8)}, 8: 7}
    assert set().union(*made.values()) == {(7, 8)}


def test_a_pair_is_made_once_and_none_is_lost(spark):
    """Members of a group share many lists: their pairs don't grow with the
    lists; lists met in any order, by probes of one side too, keep every pair."""
    zeros = [0] * jaccard_join.SKETCH
    sketches = spark.createDataFrame([(i, zeros) for i in range(60)], "id long, k array<long>")
    cols = "sig long, id long, size int, probe int, comp long"
    group = [(s, i, 100, 1, i) for s in range(40) for i in range(30)]
    made = jaccard_join.list_pairs(spark.createDataFrame(group, cols), sketches, 80, 100).collect()
    assert len(made) == len(set(made)) == 30 * 29 // 2
    rng = random.Random(5)
    mixed = [(s, i, 100 + 30 * (i % 2), int(rng.random() < 0.5), i // 2) for s in range(80) for i in rng.sample(range(60), 12)]
    made = jaccard_join.list_pairs(spark.createDataFrame(mixed, cols), sketches, 80, 100).collect()
    want = {(a[1], b[1]) for a in mixed for b in mixed if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]
            and a[2] == b[2] and a[3] + b[3] > 0}
    assert {(r.a, r.b) for r in made} == want


def test_a_document_meets_a_pivot_of_each_component(spark):
    """After round 0 one list's pivot doesn't hide those of other components."""
    zeros = [0] * jaccard_join.SKETCH
    sketches = spark.createDataFrame([(i, zeros) for i in range(6)], "id long, k array<long>")
    rows = [(s, i, 100, 1, i) for s in range(1, 6) for i in (0, s)]
    now = spark.createDataFrame(rows, "sig long, id long, size int, probe int, comp long")
    pairs = jaccard_join.pivot_pairs(now, sketches, 1, 80, 100).distinct().collect()
    assert {(r.a, r.b) for r in pairs} == {(0, s) for s in range(1, 6)}


def test_groups_of_odd_rows(spark, odd_docs, no_docs):
    out = jaccard_join.groups(odd_docs).collect()
    assert len(out) == odd_docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4)
    assert got[1] == (3, 1) and got[7] == (3, 1) and got[8] == (1, 8) and got[None] == (1, None)
    assert jaccard_join.groups(no_docs).count() == 0


def test_an_id_with_two_texts_binds_them(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (4, "m n o p q")]
    out = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 1, 3: 1, 4: 4}


def brute_top(rows, k):
    clean = {(i, tuple(int(np.floor(1024.0 * x)) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in clean if i % 100 == 0}):
        v = min(w for i, w in clean if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, w) for i, w in clean if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("n,dims", [(1, 3), (7, 4), (350, 8)])
def test_top_k_equals_brute_force(spark, n, dims, monkeypatch):
    monkeypatch.setattr(uniform_topk, "CHUNK_VECTORS", 60)
    monkeypatch.setattr(uniform_topk, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=dims).round(2).tolist()) for i in range(n)]
    rows += [(i, [0.5] * dims) for i in range(1000, 1040)]  # many equal vectors
    rows += [rows[0], (500, None), (501, [float("nan")] * dims), (502, [None] + [1.0] * (dims - 1)), (None, [9.0] * dims),
             (503, [float("inf")] * dims), (600, [1.0]), (601, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in uniform_topk.top_k(df).collect()) == sorted(brute_top(rows, 10))


@pytest.mark.parametrize("size", [20_000.0, 3e5])
def test_top_k_is_exact_for_large_components(spark, size, monkeypatch):
    monkeypatch.setattr(uniform_topk, "CHUNK_VECTORS", 20)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * (size if i % 4 else 1.0)).tolist()) for i in range(130)]
    rows += [(200, [size, 1.0]), (201, [size * 1.5, 0.0]), (202, [-size, -0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in uniform_topk.top_k(df).collect()) == sorted(brute_top(rows, 10))


def test_top_k_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e300, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        uniform_topk.top_k(df).collect()


def test_top_k_goes_back_only_to_lists_that_may_hide_entries(spark, monkeypatch):
    """One near chunk's worth of high entries among low ones: the low cells'
    lists end below the threshold, so they are not asked again."""
    monkeypatch.setattr(uniform_topk, "CHUNK_VECTORS", 30)
    asked = []
    plain = uniform_topk.stored

    def noted(df, name):
        out = plain(df, name)
        if name == "topk-again":
            asked.extend(out.collect())
        return out

    monkeypatch.setattr(uniform_topk, "stored", noted)
    rows = [(0, [1.0, 1.0])] + [(i, [0.0, i / 1000]) for i in range(1, 300)] + [(300 + i, [9.0, 9.0 + i]) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in uniform_topk.top_k(df).collect()) == sorted(brute_top(rows, 10))
    assert len(asked) < 11


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, row int, q string")
    assert uniform_topk.top_k(df).count() == 0
