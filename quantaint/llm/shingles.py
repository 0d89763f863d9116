"""Word shingles of whole texts as sets of 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

from quantaint.llm.batches import hold

WIDTH = 5
_REMEMBERED = 200_000
_known: dict[bytes, int] = {}


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D: where ``bytes.split`` cuts."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Stir 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit fingerprints of words; a worker remembers those it has seen."""
    hold(_known)
    try:
        return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    except KeyError:
        pass
    if len(_known) > _REMEMBERED:
        _known.clear()
    for word in set(found):
        if word not in _known:
            _known[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct fingerprints of all ``width`` word shingles, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    found = words(text.lower() if text else None)
    if not found:
        return np.zeros(0, np.uint64)
    hashed = word_hashes(found)
    size = min(width, len(found))
    n = len(found) - size + 1
    joined = np.full(n, size, np.uint64)
    for i in range(size):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n])
    return np.unique(joined)
