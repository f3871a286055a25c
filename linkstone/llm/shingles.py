"""Word shingles of many texts at once, as sorted sets of hashes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of a shingle's hash; the rest of a word hold the text's number in its slice.
HASH_BITS = 52
MAX_TEXTS = 1 << (64 - HASH_BITS)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 22)
        ones = np.ones(size, np.uint64)
        _powers[:] = [np.concatenate([ones[:1], np.cumprod(ones[1:] * np.uint64(b), dtype=np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers


class _Hashes(dict):
    """Hash of each word met, ``most`` of them at most."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (lower case A-Z, split at ASCII white space) and the words before each text."""
    words = [t.lower().split() for t in texts]
    before = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    return np.fromiter(map(_known.__getitem__, chain.from_iterable(words)), np.uint64, int(before[-1])), before


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text's number << HASH_BITS | hash, sorted and distinct; size of each text's set)."""
    words, before = word_hashes(texts)
    count = np.diff(before)
    n = max(0, len(words) - width + 1)
    mixed = words[:n].copy()
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _M1 + words[k : n + k]
    text = np.repeat(np.arange(len(texts)), count)
    whole = text[:n] == text[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
    parts, owner = [mix(mixed[whole])], [text[:n][whole]]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):  # the whole sequence is the one shingle
        value = np.full(len(short), 1, np.uint64) * _M3 + count[short].astype(np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            value[has] = mix(value[has] * _M2 + words[before[:-1][short[has]] + k])
        parts.append(value)
        owner.append(short)
    bits = np.uint64(HASH_BITS)
    key = np.sort(np.concatenate(owner).astype(np.uint64) << bits | np.concatenate(parts) >> np.uint64(64 - HASH_BITS))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key, np.bincount((key >> bits).astype(np.int64), minlength=len(texts))
