import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealerlens.llm import packing, trie_tokens

ODD = ["İstanbul ΣΑΣ ś a b\x1cc\x85d", "it's don'T we'll", "ﬁ 힣 가 日本 123 ٣", "<|endoftext|> x<|startoftext|>y", "", " \n", "a​b 　 c",
       "Éa, ×÷ ÿ! foo|bar... (x)", "word. word.. WORD!! |", "😀 text"]


@pytest.mark.parametrize("text", ODD)
def test_cached_ids_are_the_tokenizers(text):
    t = packing.tokenizer(packing.vocabulary_path())
    for _ in range(2):  # learnt, then remembered
        got = np.frombuffer(next(t.encode([text])), "<u4").tolist()
        assert got == t.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_cached_ids_of_any_text(text):
    t = packing.tokenizer(packing.vocabulary_path())
    assert np.frombuffer(next(t.encode([text])), "<u4").tolist() == t.tok.encode(text, add_special_tokens=False).ids


def test_a_worker_remembers_a_bounded_number_of_chunks(monkeypatch):
    """Within a batch too, and of whatever kind the chunks are."""
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 50)
    t = packing.WordTokenizer(packing.vocabulary_path())
    texts = [f"Word{chr(97 + k // 26)}{chr(97 + k % 26)}, {k}" for k in range(400)]
    for text, ids in zip(texts, t.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.tok.encode(text, add_special_tokens=False).ids
        assert sum(len(v) for v in vars(t).values() if isinstance(v, dict)) <= 256 + 50 + 8


def _frees_tokenizer(task):
    before = packing.tokenizer(packing.vocabulary_path())
    assert packing.tokenizer(packing.vocabulary_path()) is before
    task()
    return packing.tokenizer(packing.vocabulary_path()) is not before


def test_tasks_after_tokenising_free_the_tokenizer(grams_task):
    """A worker process outlives the stage; what it remembered must not add to
    the memory of the packing's own groups or of the next operator."""
    pieces = pd.DataFrame({"length": [3, 4], "_group": 0})
    assert _frees_tokenizer(lambda: packing._packer(0, 10)((0,), pieces))
    assert _frees_tokenizer(lambda: list(grams_task(["some words"])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_keeps_pieces_and_never_adds_bins(lengths):
    lengths = np.array(lengths)
    first = packing.best_fit(lengths, 100)
    bins = packing.local_search(lengths, first, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in bins)
    assert -(-lengths.sum() // 100) <= len(bins) <= len(first)


def test_swaps_empty_a_bin():
    """Three bins that moves alone can't empty: an exchange has to."""
    lengths = np.array([60, 35, 60, 30, 10, 5])
    bins = packing.local_search(lengths, [[0, 3], [2, 1], [4, 5]], 100)
    assert len(bins) == 2


def test_packed_documents(spark, odd_docs, no_docs):
    out = packing.pack_documents(odd_docs, size=64).collect()
    tok = packing.tokenizer(packing.vocabulary_path()).tok
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = defaultdict(int)
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = defaultdict(int)
    fill = defaultdict(list)
    for r in out:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        fill[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fill) <= -(-sum(r.length for r in out) // 64) + 1
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_in_many_groups(spark):
    """Groups of 200 pieces over several rounds need at most 3 % more bins
    than one group of all pieces."""
    rng = np.random.default_rng(2)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 4096, 3000))]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), group_pieces=200).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert len(out) == 3000 and max(fill.values()) <= 4096
    whole = packing.pack_group(np.array([n for _, n in rows]))[0].max() + 1
    assert len(fill) <= 1.03 * whole


def brute_count(pieces, rare, path):
    """Shortest of the best segmentations, by trying every cut."""
    best = [(0.0, 0)]
    for end in range(1, len(path) + 1):
        options = [(best[b][0] + pieces[path[b:end]], best[b][1] - 1) for b in range(end) if path[b:end] in pieces]
        if path[end - 1] not in pieces:
            n = len(path[end - 1].encode())
            options.append((best[end - 1][0] + n * rare, best[end - 1][1] - n))
        best.append(max(options))
    return -best[-1][1]


PIECES = {"▁": -1.0, "a": -2.0, "b": -2.5, "▁a": -2.0, "ab": -3.0, "ba": -2.0, "aba": -4.5, "bab": -3.9}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text(alphabet="abc😀", min_size=1, max_size=9), max_size=12))
def test_trie_counts_equal_brute_force(words):
    c = trie_tokens.TrieCounter(PIECES)
    assert c.count_distinct(words) == {w: brute_count(PIECES, c.rare, "▁" + w) for w in words}


def test_public_vocabulary_counts():
    c = trie_tokens.counter(trie_tokens.vocabulary_path())
    words = ["the", "theater", "thematic", "日本語", "x", "ñandú", "internationalisation", "☃҈"]
    assert c.count_distinct(words) == {w: brute_count(c.pieces, c.rare, "▁" + w) for w in words}
    assert c.count_distinct(["the"]) == {"the": 1}


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs):
    out = trie_tokens.token_counts(odd_docs).collect()
    n = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in out}
    assert len(out) == odd_docs.count()
    assert n[2] == n[3] == n[4] == (0, 0) and n[1] == n[7] and n[5][0] == 20000
    assert trie_tokens.token_counts(no_docs).count() == 0
    clash = odd_docs.withColumnsRenamed({"size": "N_TOKENS", "rank": "n_pretokens", "score": "__text"})
    again = trie_tokens.token_counts(clash)
    assert [c.lower() for c in again.columns].count("n_tokens") == 1 and again.columns[-2:] == ["n_pretokens", "n_tokens"]
    assert sorted((str(r.doc_id), r["__text"], r.n_tokens) for r in again.collect()) == sorted(
        (str(r.doc_id), "s", r.n_tokens) for r in out)


def test_two_for_one_looks_at_all_lengths():
    """Of a bin with 67 documents only the two shortest together make room."""
    lengths = np.array([10] * 65 + [3, 2, 995, 4])
    home = np.array([0] * 67 + [1, 1])
    fill = np.bincount(home, weights=lengths).astype(int)
    step = packing._step(lengths, list(range(67)), 0, fill, home, np.zeros(2, bool), 1000)
    assert step == ([65, 66], [68], 1)


def test_rounds_go_on_while_bins_fill(spark, monkeypatch):
    """Rounds that fill one bin a group go on until one group holds the rest."""
    bases = []

    def packer(base, size):
        bases.append(base)

        def pack_one(key, pdf):
            n = len(pdf)
            return pdf.drop(columns="_group").assign(
                sequence_id=[base + (int(key[0]) << 24) + max(k - 1, 0) for k in range(n)],
                offset=[int(k == 1) for k in range(n)], _fill=[size if k < 2 else 1 for k in range(n)])

        return pack_one

    monkeypatch.setattr(packing, "_packer", packer)
    rows = spark.createDataFrame([(k, 1) for k in range(120)], "doc_id long, length long")
    out = packing.pack(rows, group_pieces=20).collect()
    assert len(bases) > 3 and len(set(bases)) == len(bases)
    assert sorted(r.doc_id for r in out) == list(range(120))
    assert len({(r.sequence_id, r.offset) for r in out}) == 120
    # what one group couldn't hold has been dealt out: 20 pieces at most are left alone
    count = {}
    for r in out:
        count[r.sequence_id] = count.get(r.sequence_id, 0) + 1
    assert sum(n == 1 for n in count.values()) <= 20
