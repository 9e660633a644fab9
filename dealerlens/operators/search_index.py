"""Trigram index for the page search.

``build`` writes, beside a customer table, lists of the customers whose records
hold the same three characters: each task lists the customers of a batch, so
what is shuffled is lists, one row for up to ``LISTED`` customers of a trigram.
They are range-partitioned and sorted by trigram: the statistics of the files
lead to a trigram, and a trigram that a third of the customers hold spans many
files.  ``search`` takes the customers that hold
every trigram a hit must hold and applies the page search to them alone, so it
returns what the scan returns.  A query without three plain characters in a row
gives no trigram and scans.

The index describes the table as it was built; after a change of the table it
is built again.  Customers without a key are always searched."""

from __future__ import annotations

import re
import sys
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_text
from .notes import global_search

# The task-side code below ships by value, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Up to so many candidates their keys become a filter that reaches the scan;
#: more meet the table in a join.
PUSHED_KEYS = 1000
KEY = "customer_id"


#: Customers in one row of the index, and characters that a task lists at once.
LISTED, CHARS = 512, 2_000_000


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, trigram of three code points as one integer) of
    every run of three characters."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = np.flatnonzero(row[:-2] == row[2:])
    return row[inside], cp[inside] << 42 | cp[inside + 1] << 21 | cp[inside + 2]


def _listed(columns: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of a batch's texts (a list per column) the trigrams in order, the ends
    of their lists and the places listed: each place once per trigram, a
    trigram again for more than LISTED places."""
    n = len(columns[0])
    row, gram = (np.concatenate(x) for x in zip(*map(_trigrams, columns), strict=True))
    grams, number = np.unique(gram, return_inverse=True)
    both = np.unique(number * n + row)
    number, row = both // n, both % n
    first = np.searchsorted(number, np.arange(len(grams)))
    starts = np.flatnonzero((np.arange(len(number)) - first[number]) % LISTED == 0)
    cp = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4")
    text = cp.tobytes().decode("utf-32-le")
    return [text[3 * i:3 * i + 3] for i in number[starts].tolist()], np.append(starts, len(number)), row


def _lists(batches):
    import pyarrow as pa
    for b in batches:
        b = b.filter(b.column(KEY).is_valid())
        columns = [[x.decode("utf-8", "replace") for x in c.to_pylist()] for c in b.columns[1:]]
        size = np.sum([[len(x) for x in c] for c in columns], axis=0, dtype=np.int64)
        part = np.cumsum(size) // CHARS
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, [p, p + 1]).tolist()
            grams, ends, row = _listed([c[lo:hi] for c in columns])
            keys = b.column(KEY).slice(lo, hi - lo).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)], names=["gram", "keys"])


def build(df: DataFrame, path: str) -> DataFrame:
    """Write the index of ``df`` over all its columns and return it: (gram,
    keys), a trigram in any number of rows."""
    texts = [F.lower(as_text(F.col(c))).cast("binary").alias(f"t{k}") for k, c in enumerate(df.columns)]
    rows = df.select(KEY, *texts).mapInArrow(_lists, f"gram string, keys array<{df.schema[KEY].dataType.simpleString()}>")
    first = F.col("keys")[0]
    rows.repartitionByRange("gram", first).sortWithinPartitions("gram", first).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def needed(query: str, literal: bool = False) -> list[str]:
    """Trigrams that every text with a hit holds.  Of a regular expression only
    runs of plain characters count, without one that a quantifier makes
    optional; expressions with classes, groups, escapes or alternatives give
    none."""
    q = query.lower()
    if literal:
        runs = [q]
    elif re.search(r"[\\|()\[\]{}]", q):
        runs = []
    else:
        runs = re.split(r"[.^$*+?]", re.sub(r".[*?]", ".", q, flags=re.DOTALL))
    # outside the basic plane an engine may count a character twice
    return sorted({r[i:i + 3] for r in runs for i in range(len(r) - 2) if max(r[i:i + 3]) < "\ud800"})


def search(df: DataFrame, index: DataFrame, query: str | None, literal: bool = False) -> DataFrame:
    """``global_search(df, query, literal=literal)`` through the index of
    ``df``."""
    grams = needed(query, literal) if query else []
    if not grams:
        return global_search(df, query, literal=literal)
    hits = (index.where(F.col("gram").isin(grams)).select("gram", F.explode("keys").alias(KEY))
            .groupBy(KEY).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(KEY))
    few = [r[KEY] for r in hits.limit(PUSHED_KEYS + 1).collect()]
    if len(few) <= PUSHED_KEYS:
        keys = [k for k in few if k is not None]
        near = df.where(reduce(lambda a, b: a | b, [F.col(KEY).isin(keys)] if keys else [], F.col(KEY).isNull()))
    else:
        near = df.join(hits.where(F.col(KEY).isNotNull()), KEY, "left_semi").unionByName(df.where(F.col(KEY).isNull()))
    return global_search(near.select(df.columns), query, literal=literal)
