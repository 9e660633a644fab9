import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from dealerlens.llm import centroid_clusters, one_bit_search, queries, token_alignment
from paths import SF001, SF01

VECTORS = "vec_id long, embedding array<double>"


# ------------------------------------------------------------- 11: alignment
def coders():
    import sentencepiece
    path_a, path_b = token_alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = token_alignment.byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), bytes_a, b.encode, bytes_b


def aligned_by_hand(text, encode_a, bytes_a, encode_b, bytes_b):
    """Groups and links from the plain definition."""
    if not text:
        return [], Counter()
    a, b = encode_a(text), encode_b(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
        return [], Counter()
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, a), (bytes_b, b))]
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, at = [], [0, 0]
    for e in shared:
        to = [ends[s].index(e) + 1 for s in (0, 1)]
        groups.append((tuple(a[at[0]:to[0]]), tuple(b[at[1]:to[1]])))
        at = to
    return groups, Counter((x[-1], y[-1]) for x, y in groups)


def alignments_by_hand(texts):
    tools = coders()
    found = [aligned_by_hand(t, *tools) for t in texts]
    total = sum((links for _, links in found), Counter())
    top = {}
    for (_, y), n in total.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for groups, links in found:
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups),
                    sum(n for p, n in links.items() if total[p] == top[p[1]]), sum(n * total[p] for p, n in links.items()),
                    sha256(line.encode()).hexdigest() if line else ""))
    return out


ODD = [None, "", " ", "  ", "a", "a ", " a  b ", "▁", "x▁y", "<unk> <s> <0x41>", "<|endoftext|> end", "tab\tline\n\n\r end",
       "日本語 😀 é é ﬁ ½", "a\0b", "don't can't 123 4567", "a" * 300, "　wide　space", "x" * 70 + " " + "y" * 80]


def test_alignment_of_odd_texts_equals_the_definition(spark, tmp_path):
    rng = random.Random(3)
    letters = "ab  a '’sS \n\t　é日😀ß1२<>|́\r\x1c\x85▁"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, groups int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(alignments_by_hand(texts)))


def test_alignment_query_equals_the_definition(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), alignments_by_hand([r.text for r in rows]), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_token_alignment(spark, SF001).collect()} == want


def test_cuts_of_generated_ends():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.flatnonzero(rng.random(n) < p) for p in rng.random(2))
        a, b = (np.unique(np.append(x, n)) for x in (a, b))
        assert token_alignment.cuts(a, b).tolist() == np.isin(a, b).tolist()
    assert token_alignment.cuts(np.empty(0, int), np.empty(0, int)).tolist() == []


def test_ids_of_a_come_from_its_file():
    encode_a, bytes_a, encode_b, _ = coders()
    path_a, path_b = token_alignment.default_paths()
    a, b = token_alignment.byte_tokens(path_a), token_alignment.piece_tokens(path_b)
    texts = [t for t in ODD if t and "▁" not in t]
    assert a.encode(texts) == [encode_a(t) for t in texts]
    assert b.encode(texts) == [encode_b(t) for t in texts]
    # every token's own text takes the same way in both forms of the vocabulary
    own = [t.decode() for t in a.table if t.decode("utf-8", "ignore").encode() == t and t.startswith(b" ")]
    assert a.encode([t[1:] for t in own]) == [encode_a(t[1:]) for t in own] and len(own) > 20_000
    assert [a.table[i] for i in encode_a("don't")] == [bytes_a(i) for i in encode_a("don't")]


def test_alignment_takes_odd_rows(spark, odd_docs, no_docs):
    out = token_alignment.with_strengths(token_alignment.align(odd_docs, keep=("doc_id", "length", "rank"))).collect()
    assert len(out) == 12 and all(r.length == "l" and r["rank"] == "r" for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].asDict() | {"doc_id": 7} == by[7].asDict() and by[3].n_a == by[2].n_a == 0 < by[5].n_a
    assert by[5].n_groups > 10_000 and by[None].n_a > 0
    assert token_alignment.with_strengths(token_alignment.align(no_docs)).count() == 0
    clash = odd_docs.withColumnRenamed("size", "n_a")
    assert token_alignment.align(clash, keep=("doc_id", "n_a")).columns[:2] == ["doc_id", "n_a"]


# ------------------------------------------------------------ 12: clustering
def clusters_by_hand(rows, k=40, rounds=5, scale=256, width=64, seed=2):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cents = [q for _, q in first]

    def near(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            own = [q for (_, q), o in zip(kept, of, strict=True) if o == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [near(q) for _, q in kept]
    total = Counter()
    for d, j in last:
        total[j] += d
    return [(i, j, d, total[j], sum(total.values()), sha256(",".join(map(str, cents[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, last, strict=True)]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("big", [1.0, 1.35e6])
def test_clusters_equal_plain_rounds(spark, big):
    rng = np.random.default_rng(6)
    rows = [(i, (big * rng.normal(size=3)).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (1, rows[1][1]), (61, None), (62, [1.0, 2.0]), (63, [1.0, None, 2.0]),
             (64, [1.0, float("nan"), 0.0]), (65, [float("inf"), 0.0, 0.0]), (None, [0.0, 0.0, 0.0]), (66, [])]
    rows += [(70 + i, [0.5, 0.5, 0.5]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{VECTORS}, cluster string")
    small = {"k": 7, "rounds": 4, "width": 3}
    got = centroid_clusters.clustered(df, **small).collect()
    assert in_order(got) == in_order(clusters_by_hand(rows, **small))


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [-5.0, 1.0])]
    got = centroid_clusters.clustered(spark.createDataFrame(rows, VECTORS), width=2).collect()
    assert in_order(got) == in_order(clusters_by_hand(rows, width=2))
    assert centroid_clusters.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        centroid_clusters.clustered(spark.createDataFrame([(1, [1e300, 1.0])], VECTORS), width=2)


def test_a_round_shuffles_centroids_only(spark):
    rows = centroid_clusters.quantised(spark.read.parquet(f"{SF001}/embeddings.parquet"))
    near = rows.select("q", centroid_clusters.nearest(rows["q"], [[0] * 64, [9] * 64])["cluster"].alias("cluster"))
    plan = near.groupBy("cluster").agg({"cluster": "count"})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1 and "partial_count" in plan


# ---------------------------------------------------------------- 13: search
def exact_neighbours(rows, k, every):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i in sorted({i for i in ids.tolist() if i % every == 0}):
        score = (x * x[np.flatnonzero(ids == i)[0]]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_search_finds_the_nearest(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact_neighbours(rows, one_bit_search.K, one_bit_search.EVERY)
    got = queries.op13_one_bit_search(spark, SF01).collect()
    assert len(got) == sum(map(len, want.values()))
    found = 0
    for r in got:
        near = dict(want[r.query_id])
        found += r.vec_id in near
        assert abs(r.score - near.get(r.vec_id, r.score)) < 1e-12
    assert found >= 0.99 * len(got)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))


@pytest.mark.parametrize("shape", ["clusters", "uneven", "one hot vector"])
def test_search_recall_in_many_cells(spark, monkeypatch, shape):
    monkeypatch.setattr(one_bit_search, "CHUNK_VECTORS", 500)
    monkeypatch.setattr(one_bit_search, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 48))
    if shape == "clusters":
        x = x * 0.3 + rng.normal(size=(20, 48))[rng.integers(0, 20, 2000)] + 2
    elif shape == "uneven":
        x *= np.exp(rng.normal(size=(2000, 1)))
    else:
        x[rng.random(2000) < 0.35] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = exact_neighbours(rows, 20, 20)
    got = one_bit_search.search(spark.createDataFrame(rows, VECTORS)).collect()
    near = {(q, i) for q, found in want.items() for i, _ in found}
    assert len(got) == len(near)
    assert len({(r.query_id, r.vec_id) for r in got} & near) >= 0.97 * len(near)


def test_search_takes_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]),
            (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (None, [1.0, 1.0]), (7, []), (20, [3.0]), (8, [1.0, 2.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{VECTORS}, score string, row int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in one_bit_search.search(df).collect()}
    assert got == {(0, 1): (1, 5.0), (0, 2): (8, 5.0), (0, 3): (20, 3.0),
                   (20, 1): (0, 3.0), (20, 2): (1, 3.0), (20, 3): (8, 3.0)}
    assert one_bit_search.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert one_bit_search.search(spark.createDataFrame([(20, [1.0])], VECTORS)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    mean = x.mean(0)
    code, scalars = one_bit_search.encoded(x, mean)
    outside = 0
    for q in x[:40]:
        about, off = one_bit_search.Query(q, mean).estimates(code.T, scalars.T)
        outside += (np.abs(about - x @ q) > off).mean() / 40
    assert outside < 0.02
