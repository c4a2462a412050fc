"""Words and hashes of Arrow string columns with numpy, without a Python object per word.

Used inside Arrow tasks (`mapInArrow`). Word classes of the contracts depend on
ASCII bytes only, so UTF-8 bytes can be classified one by one: every byte of a
non-ASCII character belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BASE = np.uint64(0x9E3779B97F4A7C15)
_K = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters, digits and all non-ASCII bytes.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
ALNUM_LOWERED = ALNUM  # applied after LOWER

_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _K[0]
    x ^= x >> np.uint64(27)
    x *= _K[1]
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


class Words:
    """Words of a slice of texts: bytes `low` (lower-cased), word `start`/`end` in it, `of[i]:of[i+1]` the words of text i."""

    def __init__(self, texts: pa.Array, table: np.ndarray, breaks=None):
        """`table`: which bytes are in words; `breaks(raw)`: bytes at which a new word begins although the last one goes on."""
        texts = texts.fill_null("") if texts.null_count else texts
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        if len(texts) == 0 or data is None:
            raw, at = np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
        else:
            at = np.frombuffer(offsets, dtype=kind, count=len(texts) + 1, offset=texts.offset * kind().itemsize).astype(np.int64)
            raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]]
            at = at - at[0]
        self.raw, self.at, self.low = raw, at, LOWER[raw]
        m = len(raw)
        inside = np.zeros(m + 2, dtype=bool)
        inside[1:-1] = table[self.low]
        fresh = ~inside[:-2]
        if breaks is not None:
            fresh |= breaks(raw)
        fresh[at[(at > 0) & (at < m)]] = True  # words do not cross from one text into the next
        begins = inside[1:-1] & fresh
        ends = inside[1:-1] & np.append(~inside[2:-1] | fresh[1:], True)[:m]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.of = np.searchsorted(self.start, at)
        self._inside = inside[1:-1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if len(self.start) == 0:
            return np.empty(0, np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        b = self.low[self._inside].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(b)) - np.repeat(first, size)
        b *= _power(int(size.max()))[place]
        return mix(np.add.reduceat(b, first) + size.astype(np.uint64) * _K[2])

    def word(self, i: int) -> bytes:
        return self.low[self.start[i]:self.end[i]].tobytes()


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each run of n values (over the whole array; the caller drops runs that cross texts)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= _K[2]
        out += h[k:len(h) - n + 1 + k]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (one row at least), so memory follows the longest text only."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
