"""Alignment of two tokenizers' tokens of a text.

Tokens of either tokenizer cover the same bytes.  Where a token of A and a
token of B end at one byte offset lies a cut; the tokens between two cuts form
a group, and the two tokens that end at a cut are linked.

Cuts are found by divide and conquer.  Of a range of A's tokens the middle end
is looked up among B's ends by bisection; where B has none there, the search
leaps on: B's next end is looked up among A's, and so on, to the right of the
middle and, when nothing is left there, to its left.  The cut nearest to the
middle on that side splits the range, what lies between it and the middle
holds none, and both remainders are searched in the same way; a range without
a cut is a leaf.  All ranges of one depth, of all texts of a batch, go through
each step together as arrays.

Links are counted over the corpus: ``strengths`` gives each id pair's number
of links and whether it is its B id's most frequent one, ``with_strengths``
brings these back to the texts.

A is a byte-level BPE in a tokenizers file, B a SentencePiece model with byte
fallback.  A's ids are computed by tiktoken on the ranks of the same file.

Defined results: null and empty texts, and texts whose tokens of A or of B
don't add up to the bytes of a space and the text (B may rewrite characters),
have no tokens, no groups and no links; repeated rows get equal results and
their links count once each; ``keep`` names the columns to carry along (of
those named like a result, the result stays); an empty table gives an empty
result; a row without an id is treated like any other.
"""

from __future__ import annotations

import json
import re
from collections import ChainMap
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, spare, stored

#: Texts that are aligned together; one longer text is aligned alone.
BATCH_CHARS = 400_000

RESULTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
           "links": "array<struct<a:int,b:int,n:int>>"}


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter of a byte-level vocabulary -> its byte: visible Latin-1
    letters stand for themselves, the other bytes follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Ids of texts by one tokenizer, and the bytes of each id."""

    def __init__(self, encode, table: list[bytes]):
        self.encode, self.table = encode, table
        self.length = np.array([len(t) for t in table], np.int64)


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> Tokens:
    """A: ids of a space and the text."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    coder = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        table[i] = t
    return Tokens(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], table)


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> Tokens:
    """B: ids of the text; the model itself puts a space before it."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def content(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    pieces = (model.id_to_piece(i) for i in range(len(model)))
    lone = model.is_unknown(model.piece_to_id("▁"))
    if lone or any("▁" in p.lstrip("▁") for p in pieces):  # pieces reach over spaces
        encode = partial(model.encode, num_threads=1)
    else:
        encode = _WordCoder(model)
    return Tokens(encode, [content(i) for i in range(len(model))])


class _WordCoder:
    """Ids by words, for a model none of whose pieces holds a space behind
    another character: merges then never leave a word and the spaces before
    it, so each different word is encoded once.  The memory of words starts
    anew when full.  (A text that itself holds the space sign has no tokens
    here, as its bytes differ.)"""

    WORD = re.compile(" *[^ ]+| +")
    MEMORY, LONGEST = 200_000, 64

    def __init__(self, model):
        self.model, self.known = model, {}
        self.space = {" ": [model.piece_to_id("▁")]}  # the model puts none before an empty text

    def __call__(self, texts: Sequence[str]) -> list[list[int]]:
        words = [self.WORD.findall(" " + t) for t in texts]
        if len(self.known) > self.MEMORY:
            self.known = {}
        self.known.update(self.space)
        new = list(set(chain.from_iterable(words)) - self.known.keys())
        # the model puts one space before each
        ids = dict(zip(new, self.model.encode([w[1:] for w in new], num_threads=1), strict=True))
        look = ChainMap(ids, self.known) if any(len(w) > self.LONGEST for w in new) else None
        self.known.update((w, i) for w, i in ids.items() if len(w) <= self.LONGEST)
        look = (look or self.known).__getitem__
        return [list(chain.from_iterable(map(look, ws))) for ws in words]


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the ends ``a`` are also ends of ``b``, both ascending and with
    the same last element."""
    found = np.zeros(len(a), bool)
    if not len(a):
        return found
    found[-1] = True
    lo, hi = np.array([0]), np.array([len(a) - 2])
    while len(lo := lo[keep := lo <= hi]):
        hi = hi[keep]
        mid = (lo + hi) >> 1
        cut = _leap_right(a, b, mid)
        right = cut <= hi
        found[cut[right]] = True
        # nothing from the middle on: look to its left
        lo_l, mid_l = lo[~right], mid[~right]
        back = _leap_left(a, b, mid_l)
        left = back >= lo_l
        found[back[left]] = True
        lo, hi = (np.concatenate((lo[right], cut[right] + 1, lo_l[left])),
                  np.concatenate((mid[right] - 1, hi[right], back[left] - 1)))
    return found


def _leap_right(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each index the first from it on whose end both sides share (the last
    end is shared, so there is one)."""
    at = start.copy()
    todo = np.arange(len(at))
    while len(todo):
        theirs = b[np.searchsorted(b, a[at[todo]])]
        miss = theirs != a[at[todo]]
        todo, theirs = todo[miss], theirs[miss]
        at[todo] = np.searchsorted(a, theirs)
    return at


def _leap_left(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each index the last before it whose end both sides share, or -1."""
    at = start.copy()
    todo = np.arange(len(at))
    while len(todo):
        j = np.searchsorted(b, a[at[todo]], side="right") - 1
        theirs = np.where(j >= 0, b[j], -1)
        miss = theirs != a[at[todo]]
        todo, theirs = todo[miss], theirs[miss]
        at[todo] = np.searchsorted(a, theirs, side="right") - 1
        todo = todo[at[todo] >= 0]
    return at


@lru_cache(maxsize=1)
def _words(size: int) -> np.ndarray:
    """Ids in decimal followed by ',', '|' or ';', three of each id."""
    out = np.empty(3 * size, object)
    out[:] = [b"%d%c" % (i, s) for i in range(size) for s in b",|;"]
    return out


def _flat(ids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def align_texts(texts: Sequence[str | None], a: Tokens, b: Tokens) -> list[list]:
    """Columns of RESULTS for some texts."""
    has = [k for k, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([texts[k] for k in has]), b.encode([texts[k] for k in has])
    rows, kept = [], []
    for n, k in enumerate(has):
        whole = b" " + texts[k].encode("utf-8", "replace")
        if all(b"".join(map(s.table.__getitem__, ids[n])) == whole for s, ids in ((a, ids_a), (b, ids_b))):
            rows.append(k)
            kept.append(n)
    ia, na = _flat([ids_a[n] for n in kept])
    ib, nb = _flat([ids_b[n] for n in kept])
    # ends in the bytes of all texts one after another
    ea, eb = np.cumsum(a.length[ia]), np.cumsum(b.length[ib])
    cut_a = cuts(ea, eb)
    at_a = np.flatnonzero(cut_a)
    at_b = np.searchsorted(eb, ea[at_a])
    cut_b = np.zeros(len(eb), bool)
    cut_b[at_b] = True
    last_a, last_b = np.cumsum(na), np.cumsum(nb)
    groups = np.diff(np.concatenate(([0], np.cumsum(cut_a)))[np.concatenate(([0], last_a))])

    # group by group: A's ids, then B's
    before_a = np.concatenate(([0], np.cumsum(cut_a)[:-1])) if len(ea) else np.empty(0, np.int64)
    before_b = np.concatenate(([0], np.cumsum(cut_b)[:-1])) if len(eb) else np.empty(0, np.int64)
    ends_a, ends_b = np.concatenate(([0], at_a + 1)), np.concatenate(([0], at_b + 1))
    code = np.empty(len(ia) + len(ib), np.int64)
    code[np.arange(len(ia)) + ends_b[before_a]] = 3 * ia + cut_a
    code[np.arange(len(ib)) + ends_a[before_b + 1]] = 3 * ib + 2 * cut_b
    words = _words(max(len(a.table), len(b.table)))[code].tolist()
    lines = []
    for end, n in zip(np.cumsum(na + nb), na + nb, strict=True):
        lines.append(b"".join(words[end - n:end])[:-1].decode())

    # links of each text, equal ones together
    size_b, size = len(b.table), len(a.table) * len(b.table)
    text = np.repeat(np.arange(len(rows)), groups)
    pair, times = np.unique(text * size + ia[at_a] * size_b + ib[at_b], return_counts=True)
    edges = np.searchsorted(pair, np.arange(len(rows) + 1) * size)

    out: list[list] = [[0] * len(texts) for _ in range(4)] + [[""] * len(texts)]
    for n, k in enumerate(rows):
        for column, value in zip(out, (int(na[n]), int(nb[n]), int(groups[n]), int(groups[n]), lines[n]), strict=True):
            column[k] = value
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[np.array(rows, np.int64) + 1] = np.diff(edges)
    return [*out, [np.cumsum(offsets), pair % size // size_b, pair % size_b, times]]


def _pieces(texts: Sequence[str | None]) -> Iterator[slice]:
    """Consecutive slices of at most BATCH_CHARS characters or one text."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > BATCH_CHARS:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def align(docs: DataFrame, keep: Sequence[str] = ("doc_id",), paths: tuple[str, str] | None = None) -> DataFrame:
    """``keep`` and, per row: the tokens of A and of B, groups and links of the
    text (n_a, n_b, n_groups, n_links), its groups as 'a1,a2|b1;a3|b2,b3', and
    its links, equal ones as one element (a, b, n)."""
    prepare(docs.sparkSession)
    keep = [c for c in keep if c not in RESULTS]
    path_a, path_b = paths or default_paths()

    def run(batches):
        import pyarrow as pa
        a, b = byte_tokens(path_a), piece_tokens(path_b)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for piece in _pieces(texts):
                *plain, (offsets, left, right, times) = align_texts(texts[piece], a, b)
                n = piece.stop - piece.start
                links = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (left, right, times)], names=["a", "b", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(piece.start, n) for k in range(len(keep))),
                     *(pa.array(x, pa.int64()) for x in plain[:4]), pa.array(plain[4], pa.string()), links],
                    names=[*keep, *RESULTS])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + [f"{c} {t}" for c, t in RESULTS.items()])
    return docs.select(*keep, F.col("text").alias(spare(keep, "__text"))).mapInArrow(run, schema)


def strengths(aligned: DataFrame) -> DataFrame:
    """(a, b, total, best) of every linked id pair: its links in the corpus,
    and whether no pair of this B id has more.  Counted in every task before
    the shuffle; a B id has at most as many pairs as A has ids."""
    totals = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("total"))
    top = F.max("total").over(Window.partitionBy("b"))
    return totals.withColumn("best", F.col("total") == top)


def with_strengths(aligned: DataFrame) -> DataFrame:
    """``aligned`` without ``links``, with n_best (links whose pair is its B
    id's most frequent) and count_sum (links of the pairs of all links).  The
    pairs' table is read back from storage, so Spark knows its size and
    broadcasts it only while that is small."""
    rows = stored(aligned.withColumn("_row", F.monotonically_increasing_id()), "align-rows")
    pairs = stored(strengths(rows), "align-pairs")
    per = (rows.select("_row", F.inline("links")).join(pairs, ["a", "b"]).groupBy("_row")
           .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
                F.sum(F.col("n") * F.col("total")).cast("long").alias("count_sum")))
    return (rows.drop("links").join(per, "_row", "left").drop("_row")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}))
