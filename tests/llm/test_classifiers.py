import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealerlens.llm import kn_toxicity, line_crf
from dealerlens.llm.labels import held_out, sample


def accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", label).collect()
    return np.mean([(r.score >= threshold) == (r[label] == 1) for r in rows]), len(rows)


def test_held_out_fold_is_never_learnt(spark, labels):
    ids = {r.doc_id for r in sample(labels, "toxic", 1000, balanced=False).collect()}
    assert ids == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    balanced = sample(labels, "toxic", 50, balanced=True).groupBy("y").count().collect()
    assert {r["count"] for r in balanced} == {50}


def test_toxicity_on_held_out_rows(spark, labelled, labels):
    model = kn_toxicity.fit(labelled, labels)
    acc, n = accuracy(kn_toxicity.score(labelled, model), labels, "toxic", kn_toxicity.THRESHOLD)
    assert n > 50 and acc >= 0.95


def test_spelling_models_are_distributions(spark, labelled, labels):
    """After any history the probabilities of all characters sum to one."""
    model = kn_toxicity.fit(labelled, labels)
    o = model.orders[kn_toxicity.ORDER]
    assert (o.mass >= 0).all() and (o.backoff >= 0).all() and (o.backoff <= 1 + 1e-6).all()
    # an inflected word that the sample never held still stands out
    strange, plain = model.word_ratios(["blargly", "tarenolu"])
    assert strange > plain + 1


def test_counting_n_grams_takes_bounded_memory(grams_task):
    """120,000 distinct words in one task: each n-gram's total is right and the
    work beside the words stays small."""
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (120_000, 9))]
    n = Counter()
    tracemalloc.start()
    batches = grams_task([" ".join(words)])
    peak = 0
    while (b := next(batches, None)) is not None:
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        for g, k in zip(b.column("g").to_pylist(), b.column("n").to_pylist(), strict=True):
            n[g] += k
        del b
        tracemalloc.start()
    tracemalloc.stop()
    whole = Counter(g for w in words for p in [kn_toxicity.BEGIN + w + kn_toxicity.END]
                    for g in (p[k:k + kn_toxicity.ORDER] for k in range(len(w) + 1)))
    assert n == whole
    assert peak < 60e6, peak


def test_shared_model_counts_every_document(spark, labelled, labels):
    """The shared model holds the n-grams of documents without labels too, and
    its probabilities of all characters after a history sum to one."""
    others = spark.createDataFrame([(1000 + i, w, "ru", "s", 0) for i, w in enumerate(
        ["привет мир", "приветы миру", "примеры мира", "приз", "priwet"])], labelled.schema)
    shared = kn_toxicity.fit(labelled.unionByName(others), labels).shared
    n = {r.g: r.n for r in shared.grams[kn_toxicity.ORDER].where("g IN ('\x02\x02\x02\x02\x02п', '\x02приве')").collect()}
    assert n == {"\x02\x02\x02\x02\x02п": 4, "\x02приве": 2}
    chars = [r.g for r in shared.grams[1].select("g").collect()]
    for history in ("\x02\x02при", "\x02\x02\x02ta", "zzzzz"):
        spelt = spark.createDataFrame([(history + c,) for c in [*chars, "ß"]], "g string")
        p = {r.g: r.p for r in shared.probabilities(spelt).collect()}
        assert len(p) == len(chars) + 1 and min(p.values()) > 0 and np.isclose(sum(p.values()), 1)
    in_corpus = shared.grams[kn_toxicity.ORDER].select("g", "p").limit(50)
    want = {r.g: r.p for r in in_corpus.collect()}
    got = {r.g: r.p for r in shared.probabilities(spark.createDataFrame([(g,) for g in want], "g string")).collect()}
    assert got == want


def test_rare_ngrams_keep_some_mass():
    """An n-gram seen once or twice in a class is likelier there than one
    never seen, at every order, and what it leaves goes to the lower order."""
    words = ["once", "twice", "often", "other"]
    orders = kn_toxicity._class_orders(words, np.array([[0, 0, 50, 50], [1, 2, 50, 0]], float))
    for k, o in orders.items():
        for w, c in (("once", 1), ("twice", 1), ("other", 0)):
            at, known = kn_toxicity._find(o.grams, kn_toxicity.grams([w], [k])[0][k])
            assert known.all() and (o.mass[c][at] > 0).all()
        last = kn_toxicity._find(o.grams, kn_toxicity.grams(["once"], [k])[0][k])[0]
        assert (o.mass[0][last] == 0).any()
    for seen in ([5, 4, 3, 2], [100, 1, 1, 1], [3, 0, 0, 0], [0, 0, 0, 0], [1, 50, 1, 90]):
        d = kn_toxicity.discounts(seen)
        assert all(0 < x < i for i, x in enumerate(d, 1))


def test_joined_ratios_equal_broadcast_ones(spark, labelled, labels, odd_docs):
    """Scores don't depend on how many n-grams' ratios are broadcast."""
    model = kn_toxicity.fit(labelled, labels)
    for docs in (labelled, odd_docs):
        whole = {(r.doc_id, r.mark) for r in kn_toxicity.score(docs, model, out="mark").collect()}
        model_known, model.known = model.known, kn_toxicity._frequent(model.ratios, 20)
        assert 0 < len(model.known[0]) <= 20
        assert {(r.doc_id, r.mark) for r in kn_toxicity.score(docs, model, out="mark").collect()} == whole
        model.known = model_known


def plain_log_ratio(samples, gram, low):
    """Toxic minus ordinary log probability of the last character of ``gram``
    by dictionaries of strings; ``samples`` are the words' counts by class."""
    n, begin, out = kn_toxicity.ORDER, "\x02", []
    for sample_words in samples:
        seen = {n: {}}
        for w, times in sample_words.items():
            marked = begin * (n - 1) + w + "\x03"
            for i in range(len(w) + 1):
                g = marked[i:i + n]
                seen[n][g] = seen[n].get(g, 0) + times
        raw = seen[n]
        for k in range(n - 1, kn_toxicity.LOWEST - 1, -1):
            seen[k] = {}
            for g in {g[-k:] for g in raw}:
                left = {h[-k - 1:] for h in raw if h.endswith(g)}
                seen[k][g] = sum(t for h, t in raw.items() if h.endswith(g)) if g[0] == begin else len(left)
        p = low
        for k in range(kn_toxicity.LOWEST, n + 1):
            values = list(seen[k].values())
            d = [0.0, *kn_toxicity.discounts([values.count(i) for i in (1, 2, 3, 4)])]
            same = {g: t for g, t in seen[k].items() if g[:-1] == gram[-k:-1]}
            if same:
                total = sum(same.values())
                own = same.get(gram[-k:], 0)
                p = (own - d[min(own, 3)]) / total + sum(d[min(t, 3)] for t in same.values()) / total * p
        out.append(p)
    return np.log(out[1]) - np.log(out[0])


def test_class_models_equal_dictionaries(monkeypatch):
    monkeypatch.setattr(kn_toxicity, "WORDS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 8))) for _ in range(60)})
    n = rng.integers(0, 5, (2, len(words))).astype(float)
    samples = [{w: int(t) for w, t in zip(words, c, strict=True) if t} for c in n]
    orders = kn_toxicity._class_orders(words, n)
    cp, at, _ = kn_toxicity.places([*words[::3], "abababab", "zz", "éé"])
    spelt = sorted(set(kn_toxicity._spelt(cp, at)))
    low = rng.uniform(0.01, 0.2, len(spelt))
    got = kn_toxicity.gram_ratios(orders, spelt, low)[1] / kn_toxicity.UNIT
    want = [plain_log_ratio(samples, g, p) for g, p in zip(spelt, low, strict=True)]
    assert np.allclose(got, want, atol=1e-5)


def test_evidence_is_what_words_exceed_the_floor_by(spark, labelled, labels, odd_docs):
    model = kn_toxicity.fit(labelled, labels)
    for docs in (labelled.limit(60), odd_docs):
        got = {(r.doc_id, r.text): r.x for r in kn_toxicity.evidence(docs, model, "text", "x", ("doc_id", "text")).collect()}
        found = {k: kn_toxicity.TERM.findall((k[1] or "").lower()) for k in got}
        words = sorted({w for ws in found.values() for w in ws})
        over = dict(zip(words, np.maximum(model.word_ratios(words) - kn_toxicity.FLOOR, 0), strict=True))
        for k, ws in found.items():
            assert np.isclose(got[k], np.log1p(sum(over[w] for w in ws) / max(1, len(ws)) ** 0.5), atol=1e-6)


@pytest.mark.parametrize("module,label", [(kn_toxicity, "toxic"), (line_crf, "quality")])
def test_a_column_named_like_the_score_gives_way(spark, labelled, labels, module, label):
    docs = labelled.withColumn("Score", F.lit("old")).withColumn("c0", F.lit(1)).withColumn("row", F.lit(2))
    out = module.score(docs, module.fit(docs, labels))
    assert [c for c in out.columns if c.lower() == "score"] == ["score"] and {"c0", "row"} <= set(out.columns)
    assert all(0 <= r.score <= 1 for r in out.select("score").collect())
    assert module.score(docs, None).select("score").distinct().count() == 1


def test_quality_on_held_out_rows(spark, labelled, labels):
    field = line_crf.fit(labelled, labels)
    acc, n = accuracy(line_crf.score(labelled, field), labels, "quality", line_crf.THRESHOLD)
    assert n > 50 and acc >= 0.95


@pytest.mark.parametrize("sizes", [[1], [3, 1, 4], [2, 5]])
def test_marginals_equal_enumeration(sizes):
    rng = np.random.default_rng(0)
    score, edge = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    got, pairs, log_z = line_crf.marginals(score, np.array(sizes), edge)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        paths = list(product((0, 1), repeat=n))
        w = np.array([np.exp(sum(score[at + i] * y for i, y in enumerate(p)) + sum(edge[a, b] for a, b in zip(p, p[1:])))
                      for p in paths])
        want_z += np.log(w.sum())
        want += [sum(x for x, p in zip(w, paths) if p[i]) / w.sum() for i in range(n)]
        for x, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += x / w.sum()
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


@pytest.mark.parametrize("module,label", [(kn_toxicity, "toxic"), (line_crf, "quality")])
def test_odd_rows_have_scores(spark, odd_docs, no_docs, labelled, labels, module, label):
    model = module.fit(labelled, labels, label)
    out = module.score(odd_docs, model, out="mark").collect()
    assert len(out) == odd_docs.count()
    assert all(0 <= r.mark <= 1 for r in out)
    assert out[0].asDict().keys() == {*odd_docs.columns, "mark"}
    assert len({r.mark for r in out if r.doc_id == 8}) == 1
    assert len({r.mark for r in out if r.doc_id in (2, 3)}) == 1
    assert module.score(no_docs, model).count() == 0
    # labels without documents, and none at all
    for nothing in (module.fit(no_docs, labels, label), module.fit(labelled, labels.where("false"), label)):
        assert nothing is None
        assert module.score(odd_docs, nothing, out="mark").select("mark").distinct().count() == 1
