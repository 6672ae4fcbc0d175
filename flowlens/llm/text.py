"""Vectorised text helpers shared by the operators of this subpackage.

A batch of texts is one byte buffer plus document offsets. Words and byte
windows are named by 64-bit polynomial hashes: with ``S[i]`` the running sum
of ``T[byte] * M**i`` (mod 2**64, ``T`` a fixed random table), the hash of
``buf[a:b]`` is ``(S[b] - S[a]) * M**-a``, so any window costs two lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SEED = 20240607

#: random value of each byte; the second table folds A-Z onto a-z
_TABLE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = _TABLE.copy()
_FOLD[65:91] = _TABLE[97:123]


def _space_words() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def _alnum_words() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[0x00:0x30] = False
    t[0x3A:0x61] = False
    t[0x7B:0x80] = False
    t[65:91] = True  # upper case counts as its lower case
    return t


#: bytes of a word ``[^\x20\x09-\x0D]+``
SPACE_WORDS = _space_words()
#: bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_WORDS = _alnum_words()

_POW: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """``M**0 .. M**(n-1)`` (or of the inverse), grown on demand per process."""
    key = "inv" if inverse else "fwd"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        base, done = (_INV if inverse else _MULT), 1
        while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
            out[done:2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POW[key] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: called before texts are worked on here, and before they are encoded: what other
#: operators remember in this worker process gives way
RELEASE: list = []
RELEASE_FOR_TOKENS: list = []


def forget() -> None:
    _POW.clear()
    pa.default_memory_pool().release_unused()


RELEASE_FOR_TOKENS.append(forget)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    for give_way in RELEASE:
        give_way()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges (i, j) of documents holding about ``limit`` bytes each; a longer
    document is a block of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Prefix:
    """Running hash sums over one buffer; ``window(a, b)`` names byte ranges."""

    def __init__(self, buf: np.ndarray, fold: bool = False):
        t = (_FOLD if fold else _TABLE)[buf]
        t *= _powers(len(buf) + 1, False)[:len(buf)]
        self.sums = np.empty(len(buf) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(t, out=self.sums[1:])

    def window(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * _powers(len(self.sums), True)[a])


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE_WORDS):
    """(starts, ends, first word of each document): words never span documents."""
    n = len(buf)
    if not n:
        z = np.empty(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = kind[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SHINGLE = np.random.default_rng(_SEED + 1).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes (runs over document borders
    included; the caller leaves those out)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:m] * _SHINGLE[0]
    for j in range(1, k):
        out += hashes[j:j + m] * _SHINGLE[j]
    return mix(out)
