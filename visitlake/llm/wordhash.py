"""Hashes of words and word shingles of many texts at once, by array arithmetic.

A word's hash is the value of its bytes as a polynomial modulo 2^64, taken from
prefix sums over the whole buffer, and then mixed; so tokenising costs a few array
operations per byte and no Python per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of one buffer; a longer text has a buffer of its own.
BUFFER = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_class() -> np.ndarray:
    """True for the bytes of words: ASCII letters and digits and every byte of a non-ASCII character."""
    is_word = np.zeros(256, bool)
    is_word[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        is_word[ord(a) : ord(b) + 1] = True
    return is_word


def blank_class() -> np.ndarray:
    """True for all bytes but the space and 0x09 to 0x0D."""
    is_word = np.ones(256, bool)
    is_word[0x09:0x0E] = False
    is_word[0x20] = False
    return is_word


def word_hashes(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of every word of the texts; start and end are within ``b" ".join``."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    n = len(raw)
    size = 1 << max(BUFFER.bit_length(), n.bit_length())
    power, inverse = _powers(size)
    inside = is_word[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    value = (sums[end] - sums[start]) * inverse[start]
    value = mix(value ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    lengths = np.array([len(t) + 1 for t in texts])
    which = np.searchsorted(np.cumsum(lengths), start, side="right")
    return value, start, end, which


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive words from each position; of a shorter text the one run of all its words."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + words[i : i + n])
    return out


def blocks(texts: list[bytes], most: int = BUFFER):
    """Slices (from, to) of the list that hold about ``most`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def words_by_text(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, lower-cased; a word is a run of letters, digits and non-ASCII characters."""
    out: list[np.ndarray] = []
    raw = [t.lower().encode("utf-8") for t in texts]
    for a, b in blocks(raw):
        value, _, _, which = word_hashes(raw[a:b], word_class())
        cuts = np.searchsorted(which, np.arange(1, b - a))
        out.extend(np.split(value, cuts))
    return out
