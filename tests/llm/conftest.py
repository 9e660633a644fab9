"""Small tables with the awkward cases every operator has to take."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = "long text of many words " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank and very long texts, repeated
    rows, and columns whose names operators might use themselves."""
    rows = [(1, "one two three four five six seven", "en", "a", 33), (2, "", "en", "a", 0), (3, None, None, None, None),
            (4, " \n\t ", "de", "b", 4), (5, LONG, "en", "b", len(LONG)), (6, "x", "en", None, 1),
            (7, "one two three four five six seven", "en", "a", 33), (None, "no id at all", "en", "c", 12),
            (8, "again and again", "en", "c", 15), (8, "again and again", "en", "c", 15),
            (9, "ünïcode 日本語   text 😀!", "fr", "é", 22), (10, "line\nline\nline !!! | a | b", "es", "a", 26)]
    extra = "size int, rank string, score string, copies string, target string, length string, bucket string, id string, _n int"
    return spark.createDataFrame([(*r, 1, "r", "s", "c", "t", "l", "b", "i", 0) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    """Labels of made-up documents: every third toxic, every fourth poor."""
    rows = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(400)] + [(401, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def labelled(spark):
    import random
    rng = random.Random(4)
    syllables = ["ta", "re", "mi", "no", "lu", "ka", "so", "ve"]

    def words(n):
        return ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]

    rows = []
    for i in range(400):
        lines = []
        for _ in range(rng.randint(2, 6)):
            w = words(rng.randint(8, 20))
            if i % 3 == 0:
                w.insert(rng.randrange(len(w)), rng.choice(["blarg", "blargish", "unblarg"]))
            lines.append(" ".join(w) + ".")
        if i % 4 == 0:
            lines[rng.randrange(len(lines))] = " | ".join(x.upper() + "!!" for x in words(15))
        rows.append((i, "\n".join(lines), "en", "s", 0))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def grams_task(spark):
    """The task that counts n-grams, as a function of one batch's texts, in
    this process."""
    import pyarrow as pa

    from dealerlens.llm import kn_toxicity

    class Docs:
        def select(self, *_):
            return self

        groupBy = agg = select

        def mapInArrow(self, task, _):
            self.task = task
            return self

    docs = kn_toxicity.count_grams(Docs())
    return lambda texts: docs.task(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]))
