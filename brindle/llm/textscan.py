"""Vectorised scanning of UTF-8 bytes, shared by the text operators.

Texts come as Arrow string arrays. All work is done on blocks of whole documents of about
``BLOCK`` bytes (one document is never split), so memory follows the block or the longest
document, not the partition. Null texts count as empty.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit: a polynomial over a
table of random 64-bit values, one per byte, then a bijective mix. Any substring's hash comes
from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 500_000
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# True for bytes that are no ASCII letter or digit and not above 0x7F
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls become empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_binary())
    if a.null_count:
        a = a.fill_null("" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    a = a.cast(pa.large_binary())
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive whole documents."""
    raw, at = string_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the unnormalised hash of raw[i:j]."""
    power, _ = _power_tables(len(raw) + 1)
    s = np.empty(len(raw) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=s[1:])
    return s


def span_hashes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes have equal hashes wherever they stand."""
    _, inverse = _power_tables(len(s))
    return mix((s[ends] - s[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a block of documents: spans, their document, and first[d]:first[d + 1] by document."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray


def word_spans(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    inside = ~space[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(raw) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    cut = at[:-1][at[:-1] < len(raw)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = after[1:].copy()
    if len(raw):
        last = at[1:][at[1:] > 0] - 1
        after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    starts, ends = word_spans(raw, at, space)
    s = prefix_sums(raw)
    doc = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(len(at)))
    return Words(starts, ends, doc, first, span_hashes(s, starts, ends), s)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, document by document, and where each document's begin.

    A document with 1 to k - 1 words has one shingle, its whole sequence; one without words none.
    """
    n = np.diff(first)
    many = np.maximum(n - k + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(many)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    doc = np.repeat(np.arange(len(n)), many)
    pos = np.arange(begin[-1]) - begin[doc] + first[:-1][doc]
    length = np.minimum(n[doc], k)
    out = np.zeros(len(pos), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    short = np.flatnonzero(length < k)
    for j in range(k):
        h = padded[pos + j]
        if len(short):
            h[short[length[short] <= j]] = 0
        out = out * _STEP + h
    return mix(out + length.astype(np.uint64)), begin
