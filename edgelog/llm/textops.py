"""Vectorised words and rolling hashes over many texts at once (NumPy, inside tasks).

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: ASCII digits and letters and
every non-ASCII character.  Every byte of a non-ASCII character is >= 0x80, so UTF-8 bytes decide alike.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(RADIX, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(seed: int = 1) -> np.ndarray:
    """A fixed pseudo-random 64-bit value per byte."""
    return mix((np.arange(256, dtype=U) + U(1)) * U(0xD1342543DE82EF95) + U(seed))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


class Powers:
    """Powers of the radix and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size, r, U)])) for r in (RADIX, _INVERSE))
        return self.up, self.down


def prefix_sums(data: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    """s with s[j] - s[i] = sum of value(byte) * radix**position over i..j-1 (modulo 2**64)."""
    up, _ = powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of the bytes start..end-1, the same wherever they stand."""
    _, down = powers.need(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


LONG_WORD = 256


def words_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """As ``spans_hash``, but spans over LONG_WORD bytes go through BLAKE2: for sequences like Thue and Morse's, from some
    thousand bytes on, a polynomial modulo 2**64 gives a word and its complement one hash."""
    out = spans_hash(sums, start, end, powers)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]: end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word of the texts that ``offsets`` delimit."""
    inside = word_table()[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (len - n + 1 of them)."""
    count = max(len(hashes) - n + 1, 0)
    out = np.full(count, 0x2545F4914F6CDD1D * n & (1 << 64) - 1, U)
    factor = 0x9FB21C651E98DF25
    for j in range(n):
        out += mix(hashes[j: j + count] + U(j + 1)) * U(factor)
        factor = factor * 0xDA942042E4DD58B5 & (1 << 64) - 1 | 1
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, in three passes whatever ``w`` is."""
    n = len(x)
    if n < w or w == 1:
        return x[:0] if n < w else x
    size = -(-n // w) * w
    full = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1: n])


def int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
