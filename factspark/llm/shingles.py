"""Words of a text, and the hashes of their n-grams."""

from __future__ import annotations

import numpy as np
import xxhash


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, each made of its words' hashes; fewer words than `size` are one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    take = min(size, len(h))
    n = len(h) - take + 1
    out = np.full(n, np.uint64(take))
    for i in range(take):
        out = mixed(out) + h[i : i + n]
    return np.unique(mixed(out))
