"""Words of texts as 64-bit hashes, for vectorised work inside tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from xxhash import xxh64_intdigest

#: Words as letters and digits, without marks.
TERM = re.compile(r"[^\W_]+")
#: Words of the n-gram join's contract; A-Z only are folded.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def scramble(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def term_batch(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms in order, number of terms of each text)."""
    found = [TERM.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    if not len(found):
        return np.empty(0, np.uint64), counts
    return np.concatenate([hashes(w) for w in found]), counts


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's run of ``values`` (0 for empty texts)."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
