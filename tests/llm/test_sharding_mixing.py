import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dealerlens.llm import fair_mix, feistel


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000])
def test_the_network_permutes(n):
    """Walking cycles of the digit network visits every row number once."""
    m = max(1, math.isqrt(max(n - 1, 0)) + 1)
    keys = feistel.round_keys(5)
    seen = set()
    for x in range(n):
        y = feistel.permute_once(x, m, keys)
        while y >= n:
            y = feistel.permute_once(y, m, keys)
        seen.add(y)
    assert seen == set(range(n))


def test_columns_equal_the_plain_network(spark):
    n = 977
    m = math.isqrt(n - 1) + 1
    keys = feistel.round_keys(feistel.SEED)
    for r in spark.range(n).withColumn("p", feistel.permute(F.col("id"), n)).collect():
        y = feistel.permute_once(r.id, m, keys)
        while y >= n:
            y = feistel.permute_once(y, m, keys)
        assert r.p == y


def test_shards_are_gapless_and_level(spark, odd_docs, no_docs):
    out = feistel.shard(odd_docs, shards=5).collect()
    assert len(out) == odd_docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in out:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    key = ["doc_id", "shard", "slot"]
    again = feistel.shard(odd_docs.repartition(3), shards=5)
    assert sorted(map(str, again.select(key).collect())) == sorted(str(r) for r in feistel.shard(odd_docs, shards=5).select(key).collect())
    assert feistel.shard(no_docs).count() == 0


def test_mix_reaches_targets(spark):
    import random
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 30), "en", s, 0) for i, s in enumerate(rng.choices("abcd", [6, 2, 1, 1], k=600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = fair_mix.mix(docs).collect()
    src = {r[0]: r[3] for r in rows}
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = src[r.doc_id]
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    total = sum(size.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    for s in "abcd":
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 60
    # weights 3, 1, 2, 3: what is below its cap is shared by weight
    free = [s for s in "abcd" if target[s] < 2 * size[s] - 1e-9]
    w = dict(zip("abcd", (3, 1, 2, 3)))
    assert len({round(target[s] / w[s], 6) for s in free}) == 1
    assert sorted(map(str, out)) == sorted(map(str, fair_mix.mix(docs.repartition(5)).collect()))


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    out = fair_mix.mix(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert {r.size for r in out if r.doc_id in (2, 3, 4)} == {0}
    kept = fair_mix.mix(odd_docs.withColumn("_sum", F.lit("s")).withColumn("TAKEN", F.lit("t")),
                        keep=("score", "target", "copies", "size", "_sum", "TAKEN"))
    assert kept.columns == ["doc_id", "size", "score", "source_size", "target", "copies", "taken"]
    assert sorted(map(str, kept.drop("score").collect())) == sorted(map(str, out))
    assert fair_mix.mix(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in fair_mix.mix(empty).collect()} == {(0.0, 0)}
