import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
SF001 = "/root/testdata/sf0.001"
from dealerlens.llm import block_labeller as bl
from dealerlens.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>Title words</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies.</div>
<article><h1>Head&nbsp;line {n}</h1><p>First   para &amp; <b>bo</b>ld {n}<br>second line<p>Open para {n} goes on &lt;here&gt;
<form><input value="x"><p>Your mail</p></form><div class="comments"><p>Nice post {n}</p></div></article>
<aside><p>Related things {n}</p></aside><footer>&copy; site {n}</footer></body></html>"""
TEXT = "Head line {n} First para & bold {n} second line Open para {n} goes on <here>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", PAGE.format(n=f"nr{i}")) for i in range(120)]
    rows += [(500, None, None), (501, "u", ""), (502, "u", "   "), (None, "u", PAGE.format(n="nrx")), (7, "http://x/7", PAGE.format(n="nr7")),
             (503, "u", "<article>" + "<p>many words in a row here</p>" * 3000), (504, "u", "<p <b>> broken & <"), (505, "u", "no tags")]
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")


def test_main_text_of_pages(spark, pages):
    out = bl.extract(pages, bl.fit(pages), keep=("page_id", "url")).collect()
    assert len(out) == pages.count()
    got = {r.page_id: r.text for r in out}
    exact = sum(got[i] == TEXT.format(n=f"nr{i}") for i in range(120))
    assert exact >= 118
    assert got[500] == got[501] == got[502] == ""
    assert got[None].startswith("Head line nrx")
    assert got[503].count("many words") == 3000
    clash = bl.extract(pages.withColumn("__html", F.lit("h")), bl.fit(pages), keep=("page_id", "__html", "text"))
    assert clash.columns == ["page_id", "__html", "text"]
    assert {(r.page_id, r["__html"], r.text) for r in clash.collect()} == {(r.page_id, "h", r.text) for r in out}
    assert bl.extract(pages.where("false"), bl.fit(pages)).count() == 0
    assert bl.fit(pages.where("false")) is None


def test_blocks_keep_inline_text_together():
    got = [(b.path[-1] if b.path else "", b.text) for b in bl.blocks("<p>a<i>b</i>c<br>d<p>e<script>x</script>f")]
    assert got == [("p", "abc d"), ("p", "ef")]


@pytest.mark.parametrize("page,texts", [
    ("<p>Before words. <svg/> After words", ["Before words. After words"]),
    ('<p>one <svg class="x" viewBox="0 0 1 1" /> two</p><p>three</p>', ["one two", "three"]),
    ("<p>one <object data=x /> two</p><p>three</p>", ["one two", "three"]),
    ("<template-card>one</template-card><p>two</p>", ["one", "two"]),
    ("<p>a</p><template><p>b<template>c</template>d</p></template><p>e</p>", ["a", "e"]),
    ("<p>a</p><svg><text>x</text><svg>y</svg>z</svg><p>b</p>", ["a", "b"]),
    ("<p>a</p><iframe src=x><p>b</p>", ["a", "b"]),
    ("<p>a</p></svg><p>b</p><select-list>c</select-list>", ["a", "b", "c"]),
    ("<p>a</p><script>if (a < b) x = '</p>'</script ><p>b</p><scripted>c</scripted>", ["a", "b", "c"]),
    ("<p>a</p><script/>never closed <p>b", ["a"]),
    ("<p>a</p><textarea>b <svg> c</textarea><p>d</p>", ["a", "d"]),
])
def test_elements_that_are_not_read(page, texts):
    assert [b.text for b in bl.blocks(page)] == texts


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    x, live = bl._pad([rng.normal(size=(n, bl.INPUT)) for n in (4, 2)])
    w = rng.normal(0, 0.2, (bl.INPUT + bl.HIDDEN, 4 * bl.HIDDEN))
    d = rng.normal(size=(4, 2, bl.HIDDEN)) * live[..., None]
    tape = []
    bl.Lstm(w).run(x, live, tape)
    g = bl.Lstm(w).back(d, tape)
    for i, j in [(0, 0), (3, 20), (bl.INPUT + 2, 40), (bl.INPUT + 5, 63), (10, 17)]:
        up, down = w.copy(), w.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        diff = ((bl.Lstm(up).run(x, live) - bl.Lstm(down).run(x, live)) * d).sum() / 2e-5
        assert abs(diff - g[i, j]) < 1e-5


def test_padding_does_not_change_labels():
    rng = np.random.default_rng(1)
    m = bl.Labeller(*(rng.normal(0, 0.3, s) for s in ((bl.INPUT + bl.HIDDEN, 4 * bl.HIDDEN),) * 2), rng.normal(size=2 * bl.HIDDEN + 1))
    pages = [rng.normal(size=(n, bl.INPUT)) for n in (3, 1, 7, 0, 5)]
    together = m.label(pages)
    for p, q in zip(pages, together):
        assert np.allclose(m.label([p])[0], q)


def test_stages_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF001), f"test-{name}")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert packed.agg({"length": "sum"}).first()[0] >= sizes[4]
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = odd_docs.select(*no_docs.columns)
    out = stage(spark, docs, SF001)
    assert out.count() > 0
    assert stage(spark, no_docs, SF001).count() == 0
    if k == 2:  # one of each group: 1 and 7 are copies, 8 is there twice
        ids = [r.doc_id for r in out.collect()]
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, None, 8, 9, 10], key=str)


def test_queries_are_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLE) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    from compare import compare, duck_connect
    con = duck_connect(SF001)
    r = compare(queries.QUERIES[name](spark, SF001), queries.ORACLE[name], con)
    assert r["ok"], r


def test_unrelated_texts_that_share_an_id_stay(spark):
    def text(word, n=40):
        return " ".join(f"{word}{i}" for i in range(n))

    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a") + " more"), (3, text("c")), (4, text("c"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, SF001).collect()
    # 1's first text stands for 2, its second is one row; 3 stands for 4
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, text("a")), (1, text("b")), (3, text("c"))])


def test_tables_of_finished_work_are_deleted(spark):
    import os
    from dealerlens.llm.common import passing, stored
    with passing(spark):
        gone = stored(spark.range(3), "passing").inputFiles()[0]
        kept = stored(spark.range(4), "lasting", lasting=True)
    assert not os.path.exists(gone.removeprefix("file://")) and kept.count() == 4
    assert stored(spark.range(2), "outside").count() == 2
