"""Vectorised words and word-window hashes of UTF-8 texts.

Words are maximal runs of the bytes of an alphabet, after lower-casing A-Z. Every byte
above 0x7F belongs to a code point above 0x7F, so classes of ASCII code points can be
tested byte by byte. Hashes have 64 bits: a sum of random byte values times powers of an
odd constant, finished by a bit mixer. Two of n different words or windows have the same
hash with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95 | 1
#: Bytes hashed at once; bounds the working memory for texts of any length.
PIECE = 1 << 19

_bytes = np.arange(256, dtype=np.uint8)
LOWER = _bytes.copy()
LOWER[65:91] += 32
#: Everything but \x20 and \x09-\x0D.
NOT_BLANK = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: Small letters and all that isn't ASCII.
LETTERS = ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: Digits, small letters and all that isn't ASCII.
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
#: Other values for a second hash that knows nothing of the first.
OTHER_VALUE = mix(np.arange(1001, 1257, dtype=U64) * U64(STEP))


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0..PIECE."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[U64(1)], np.full(PIECE, U64(x), dtype=U64)]), dtype=U64) for x in (BASE, inverse))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, one after the other, and where each text begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary()
    texts = texts.cast(pa.large_string()).cast(kind) if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type) else texts.cast(kind)
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    if texts.null_count:
        texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, at - at[0] if n else np.zeros(1, np.int64)


class Words:
    """The words of several texts: lower-cased bytes, start and end of each word, first word of each text."""

    def __init__(self, texts: pa.Array, alphabet: np.ndarray):
        raw, at = flat(texts)
        self.bytes = LOWER[raw]
        inside = alphabet[self.bytes]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = at[:-1][at[:-1] < len(raw)]
        begins[edges] = inside[edges]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:]
        edges = at[1:][at[1:] > 0] - 1
        finishes[edges] = inside[edges]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.start, at)  # words of text i: first[i] to first[i + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return span_hashes(self.bytes, self.start, self.end)

    def word(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.end[k]].tobytes()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order of their starts and of their ends."""
    up, down = powers()
    out = np.empty(len(start), dtype=U64)
    k = 0
    while k < len(start):
        low = start[k]
        n = max(int(np.searchsorted(end, low + PIECE, side="right")), k + 1)
        high = end[n - 1]
        if high - low > PIECE:  # one span longer than a piece
            h, power, factor = 0, 1, pow(BASE, PIECE, 1 << 64)
            for at in range(low, high, PIECE):
                part = data[at : min(high, at + PIECE)]
                h += int((values[part] * up[: len(part)]).sum(dtype=U64)) * power
                power = power * factor % (1 << 64)
            out[k] = U64(h % (1 << 64))
        else:
            total = np.zeros(high - low + 1, dtype=U64)
            np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
            a, b = start[k:n] - low, end[k:n] - low
            out[k:n] = (total[b] - total[a]) * down[a]
        k = n
    return mix(out)


def window_hashes(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of ``length`` words inside one text."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.zeros(n, dtype=U64)
    for j in range(length):
        h = h * U64(STEP) + words[j : j + n]
    last = np.repeat(first[1:], np.diff(first))[:n]  # one past the last word of the text that a word is in
    whole = np.flatnonzero(np.arange(n) + length <= last)
    return whole, mix(h[whole] + U64(length))
