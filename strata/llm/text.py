"""Words and word shingles as 64-bit hashes (numpy, per document)."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

SHINGLE_WORDS = 5
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is that rule.
    """
    return text.lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sequence(h: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of ``n`` words, in order; fewer words: the whole run."""
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out += mix(h[i : len(h) - k + 1 + i] * _ODD[i % 5] + np.uint64(i // 5))
    return mix(out + np.uint64(k))


def shingle_set(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; empty for null texts or texts without words."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingle_sequence(word_hashes(words(text)), n))
