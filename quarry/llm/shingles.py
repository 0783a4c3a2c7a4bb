"""Vectorised words, word hashes and shingle sets of whole texts (numpy inside tasks)."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_WEIGHTS = np.random.default_rng(20240229).integers(0, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> _S
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, words per text).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a weighted sum of its bytes with a
    fixed odd random weight per place, mixed with its length.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = ~_GAP[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    text_end = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(begin, text_end), prepend=0)
    if not len(begin):
        return np.empty(0, np.uint64), counts
    size = end - begin
    # bytes of words only, each with its place in its word
    chars = raw[inside].astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(first, size)
    if size.max() > len(_WEIGHTS):  # very long words: places repeat, rotated by the lap
        lap = (place // len(_WEIGHTS)).astype(np.uint64)
        weight = _WEIGHTS[place % len(_WEIGHTS)] + lap * np.uint64(0x9E3779B97F4A7C14)
    else:
        weight = _WEIGHTS[place]
    chars += np.uint64(1)
    chars *= weight
    h = np.add.reduceat(chars, first)
    h += size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h), counts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of each text.

    A text of fewer words, but not none, is one shingle; a text without words has none.
    """
    h, counts = word_hashes(texts)
    out, at = [], 0
    gram = _grams(h, k)
    for n in counts.tolist():
        if n == 0:
            out.append(np.empty(0, np.uint64))
        elif n < k:
            short = _grams(np.concatenate([h[at:at + n]]), n)
            out.append(mix(short + np.uint64(n)))
        else:
            out.append(np.unique(gram[at:at + n - k + 1]))
        at += n
    return out


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive word hashes from each start."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    g = h[:n] * _WEIGHTS[1]
    for i in range(1, k):
        g = mix(g) + h[i:i + n] * _WEIGHTS[i + 1]
    return mix(g)
