"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Under a unigram model a word's best segmentation is found left to right: the
best score of a prefix depends on that prefix alone.  The distinct pre-tokens
of a batch, in sorted order, are the depth-first walk of their trie; scores
and token counts are kept on a stack by depth, so each shared prefix is scored
once, and a node where a pre-token ends stores its count.  A document's count
is the sum over its pre-tokens.

The pieces come from a public vocabulary file (a parameter) whose merge ranks
give the unigram weights: piece of rank r has log-probability -log(r + 2), up
to a constant.  A pre-token is a run of non-blank characters behind the mark
for a space.  A character that no piece covers costs its UTF-8 bytes as
tokens, each weighing as the rarest piece.  Equal scores go to fewer tokens.

Defined results: null and empty texts have no tokens; repeated rows count
alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare, unlike

SPACE_MARK = "▁"
#: Pre-tokens whose counts a worker remembers before it starts afresh.
CACHE_WORDS = 500_000


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    """Log-probability of each ordinary piece."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [m.id_to_piece(i) for i in range(m.get_piece_size())
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(keep)}


class TrieCounter:
    """Token counts of pre-tokens under one vocabulary."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.rare = min(pieces.values(), default=-1.0)
        self.cache: dict[str, int] = {}

    def count_distinct(self, words: Iterable[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens; shared prefixes are scored once."""
        pieces, longest, rare = self.pieces, self.longest, self.rare
        get = pieces.get
        out = {}
        # stack by depth: best score and (negated) token count of the prefix
        score, used = [0.0], [0]
        before = ""
        for word in sorted(words):
            path = SPACE_MARK + word
            depth = 0
            limit = min(len(path), len(before))
            while depth < limit and path[depth] == before[depth]:
                depth += 1
            del score[depth + 1:], used[depth + 1:]
            for end in range(depth + 1, len(path) + 1):
                ch = path[end - 1]
                if ch in pieces:
                    best, n = -math.inf, 0
                else:  # bytes
                    k = len(ch.encode("utf-8", "replace"))
                    best, n = score[end - 1] + k * rare, used[end - 1] + k
                for begin in range(max(0, end - longest), end):
                    p = get(path[begin:end])
                    if p is not None:
                        s = score[begin] + p
                        if s > best or (s == best and used[begin] + 1 < n):
                            best, n = s, used[begin] + 1
                score.append(best)
                used.append(n)
            out[word] = used[len(path)]
            before = path
        return out

    def totals(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [t.split() if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.cache}
        self.cache.update(self.count_distinct(new))
        get = self.cache.__getitem__
        return [(len(ws), sum(map(get, ws))) for ws in split]


_COUNTERS: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    """One counter per worker process, kept between its tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TrieCounter(load_pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with n_pretokens and n_tokens;
    columns named like these give way to them."""
    path = path or vocabulary_path()
    keep = unlike(docs.columns if keep is None else keep, "n_pretokens", "n_tokens")
    prepare(docs.sparkSession)
    inner = docs.select(*keep, F.col("text").alias(spare(keep, "__text")))
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        import pyarrow as pa
        c = counter(path)
        for b in batches:
            n = np.array(c.totals(b.column(len(keep)).to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)]] + [pa.array(n[:, 0]), pa.array(n[:, 1])],
                names=[f.name for f in schema])

    return inner.mapInArrow(run, schema)
