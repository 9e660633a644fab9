"""Packing documents into fixed-length token sequences.

Documents are tokenised once; only those longer than a sequence are cut, into
full pieces and a rest.  Pieces (numbers only, no text) are dealt by hash into
groups of bounded size.  In a group, best fit in falling length order builds
the bins; then a local search takes the emptiest bin in turn and moves its
documents, or exchanges one for one and two for one, with other underfull
bins.  Each step raises the sum of squared fills, so the search ends; bins
that run empty disappear.  What the groups leave underfull is packed again in
a later round over fewer groups, until one group holds it all or a round
leaves no fewer underfull bins.

Defined results: a null or empty text is the end token alone; repeated rows
are packed separately; an empty table gives an empty result; other columns
are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, let_go, prepare, stored

SEQUENCE = 4096
END_ID = 1
GROUP_PIECES = 8192
#: Chunks whose ids a worker remembers before it starts afresh.
CACHE_CHUNKS = 700_000


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The vocabulary drops white space and never merges across it, so a text's
    ids are those of its white-space-separated chunks in order.  A chunk of
    plain letters and closing marks is two pre-tokens, each a chunk of its own;
    lower-case letters go to the BPE model as they are.  Other chunks take the
    whole tokenizer.  Every distinct chunk is tokenised once while it is
    remembered."""

    PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?|]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the
        # others for code points from 256 on, in order
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.byte_chars = {b: b if b in keep else next(rest) for b in range(256)}

    def _full(self, s: str) -> bytes:
        return np.asarray(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, s: str) -> bytes:
        form = s.encode("utf-8").decode("latin-1").translate(self.byte_chars)
        return np.asarray([t.id for t in self.tok.model.tokenize(form)], "<u4").tobytes()

    def _chunk(self, w: bytes) -> bytes:
        got = self.cache.get(w)
        if got is None:
            s = w.decode("utf-8", "replace")
            m = self.PLAIN.fullmatch(s)
            if not m:
                got = self._full(s)
            elif not m[2] and s == s.lower():
                got = self._word(s)
            else:
                got = self._chunk(m[1].lower().encode("utf-8"))
                if m[2]:
                    got += self._chunk(m[2].encode("utf-8"))
            self.cache[w] = got
        return got

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        cache = self.cache
        for t in texts:
            if len(cache) > CACHE_CHUNKS:
                cache.clear()
            chunks = (t or "").encode("utf-8", "replace").split()
            for w in chunks:
                if w not in cache:
                    self._chunk(w)
            yield b"".join(map(cache.__getitem__, chunks))


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process, kept between its tasks."""
    return kept(f"words {path}", lambda: WordTokenizer(path))


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., piece, start, length, ids_crc32) of every document."""
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    inp = docs.select("doc_id", *keep, "text")
    schema = T.StructType([inp.schema[c] for c in ("doc_id", *keep)] + [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    end = np.asarray([END_ID], "<u4").tobytes()
    names = ["doc_id", *keep]

    def cut(batches):
        import pyarrow as pa
        tok = tokenizer(path)
        arrow = None
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tok.encode(b.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrow = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(n).take(arrow) for n in names] + [
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[f.name for f in schema])

    return inp.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Best fit in falling length order; indices into ``lengths`` by bin."""
    bins: list[list[int]] = []
    by_slack: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit s: a bin with slack s is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            s = n + (fit & -fit).bit_length() - 1
            b = by_slack[s].pop()
            if not by_slack[s]:
                mask &= ~(1 << s)
            bins[b].append(i)
            s -= n
        else:
            b = len(bins)
            bins.append([i])
            s = size - n
        if s:
            by_slack[s].append(b)
            mask |= 1 << s
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], size: int = SEQUENCE) -> list[list[int]]:
    """Empties underfull bins by moves and swaps that raise the sum of
    squared fills.  The emptiest bin gives; it is set aside for good when no
    step helps it.  Every step moves tokens out of the giving bin into one
    that is at least as full, so fills only drift apart and the search ends."""
    bins = [list(b) for b in bins]
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    home = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    need = -(-int(lengths.sum()) // size)
    left = len(bins)
    frozen = fill >= size
    while left > need and not frozen.all():
        open_fill = np.where(frozen, size + 1, fill)
        a = int(open_fill.argmin())
        step = _step(lengths, bins[a], a, fill, home, frozen, size)
        if step is None:
            frozen[a] = True
            continue
        out, back, b = step
        moved = int(lengths[out].sum()) - int(lengths[back].sum())
        for i in out:
            bins[a].remove(i)
        for i in back:
            bins[b].remove(i)
        bins[a] += back
        bins[b] += out
        home[out], home[back] = b, a
        fill[a] -= moved
        fill[b] += moved
        if not bins[a]:
            frozen[a] = True
            left -= 1
        if fill[b] >= size:
            frozen[b] = True
    return [b for b in bins if b]


def _step(lengths, giving, a, fill, home, frozen, size):
    """(documents out, documents back, receiving bin) of the step that moves
    most tokens out of bin ``a``, or None."""
    slack = np.where(frozen, -1, size - fill)
    slack[a] = -1
    # the receiver must stay ahead: it is at least as full as the giver
    ok = (slack > 0) & (fill >= fill[a])
    if not ok.any():
        return None
    best, gain = None, 0
    for i in giving:  # move one
        n = int(lengths[i])
        fits = np.flatnonzero(ok & (slack >= n))
        if len(fits) and n > gain:
            b = int(fits[slack[fits].argmin()])
            best, gain = ([i], [], b), n
    if best:
        return best
    cand = np.flatnonzero(ok[home])  # documents of receiving bins
    if not len(cand):
        return None
    room = slack[home[cand]]
    have = lengths[cand]
    # one for one, two for one: of each length two documents stand for all
    short = np.array(sorted(giving, key=lambda i: -lengths[i]))
    same = lengths[short]
    short = short[np.concatenate((same[:2] > 0, same[2:] != same[:-2]))]
    i, j = np.triu_indices(len(short), 1)
    outs = np.concatenate((lengths[short], lengths[short[i]] + lengths[short[j]]))
    sums, first = np.unique(outs, return_index=True)
    at = np.searchsorted(sums, have + room, side="right") - 1  # the most that fits
    d = np.where(at >= 0, sums[at] - have, 0)
    k = int(d.argmax())
    if d[k] <= 0:
        return None
    x = int(first[at[k]]) - len(short)
    out = [int(short[x])] if x < 0 else [int(short[i[x]]), int(short[j[x]])]
    return out, [int(cand[k])], int(home[cand[k]])


def pack_group(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece of one group."""
    bins = local_search(lengths, best_fit(lengths, size), size)
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        where[b] = k
        offset[b] = np.concatenate(([0], np.cumsum(lengths[b])[:-1]))
    return where, offset


def _packer(base: int, size: int):
    def pack_one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()  # all documents are tokenised
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset = pack_group(lengths, size)
        fill = np.bincount(where, weights=lengths).astype(np.int64)
        return pdf.drop(columns="_group").assign(
            sequence_id=base + (int(key[0]) << 24) + where, offset=offset, _fill=fill[where])

    return pack_one


def pack(cut: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` (columns ``length`` and any others) with ``sequence_id`` and
    ``offset``.  ``cut`` is stored first, so tokenising runs once."""
    prepare(cut.sparkSession)
    cols = cut.columns
    rest = stored(cut.withColumn("_h", F.xxhash64(*cut.columns)), "pack-pieces")
    schema = T.StructType([*cut.schema.fields, T.StructField("_h", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                           T.StructField("_fill", T.LongType())])
    done, base, left, under = [], 0, None, None
    while True:
        n = rest.count()
        groups = max(1, -(-n // group_pieces))
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_h", F.monotonically_increasing_id()), F.lit(groups)))
        out = stored(dealt.groupBy("_group").applyInPandas(_packer(base, size), schema), "pack-round")
        base += groups << 24
        if left is not None and out.select("sequence_id").distinct().count() > under:
            done.append(left)  # the round made more bins of them
            break
        # the emptier a bin, the likelier it dissolves when groups meet
        low = out.where(F.col("_fill") < int(size * REPACK))
        fewer = low.select("sequence_id").distinct().count()
        if groups == 1 or (under is not None and fewer >= under):
            done.append(out)
            break
        done.append(out.where(F.col("_fill") >= int(size * REPACK)))
        if not fewer:
            break
        left, under, rest = low, fewer, low.select(*cols, "_h")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.select(*cols, "sequence_id", "offset")


#: Bins filled less than this share are packed again across groups.
REPACK = 0.98


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    return pack(pieces(docs, path, size, keep), size)
