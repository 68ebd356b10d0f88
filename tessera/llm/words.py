"""Vectorised words, word hashes and window hashes over Arrow text buffers.

A *word* is a maximal run of bytes that a 256-entry table does not mark as separator. Both word patterns of the
contracts separate on ASCII bytes only, so UTF-8 bytes can be classified one by one and multi-byte characters
stay whole.
"""

from __future__ import annotations

import ctypes
import secrets
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about this many bytes, so that the per-byte arrays stay small; one longer text is a chunk.
CHUNK_BYTES = 2 << 20
#: Values are residues modulo this prime.
PRIME = (1 << 61) - 1
#: Bytes of a word that make one digit, and digits up to which words are taken together.
LANE, LANES = 7, 32


@dataclass(frozen=True)
class Key:
    """Bases of the polynomials for words and windows, one for each of two independent values of a window.

    For any two distinct words or windows, the share of bases that give both the same value is at most their number of digits / 2^61.
    """

    word: tuple[int, int]
    window: tuple[int, int]


def new_key() -> Key:
    """Drawn anew for each job on the driver and sent along with its tasks: no text can be made to fit it, and repeated tasks use the same."""
    a, b, c, d = ((1 << 32) + secrets.randbelow(PRIME - (1 << 33)) for _ in range(4))
    return Key((a, b), (c, d))


#: For counts and features, where values must be the same in every job.
FIXED = Key((0x1E3779B97F4A7C15, 0x0A0761D6478BD642), (0x16E8FEB86659FD93, 0x0B492B66BE98F273))


def separator_table(separators) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(separators)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACE = separator_table([0x20, *range(0x09, 0x0E)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = separator_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def reduce(x: np.ndarray) -> np.ndarray:
    """Residues modulo PRIME of any 64-bit values."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def times(x: np.ndarray, by: int) -> np.ndarray:
    """Products of residues with one residue, modulo PRIME, by halves of 32 bits; less than 2^64 but not reduced."""
    low, high = np.uint64(by & 0xFFFFFFFF), np.uint64(by >> 32)
    x0, x1 = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    middle = x1 * low + x0 * high
    lowest = x0 * low
    out = ((x1 * high) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64(0x1FFFFFFF)) << np.uint64(32))
    return out + (lowest & np.uint64(PRIME)) + (lowest >> np.uint64(61))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(LANE + 1)], np.uint64)


@dataclass
class Words:
    """Words of several texts. ``doc`` holds, per text, the index of its first word (one entry more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    @cached_property
    def _wide(self) -> np.ndarray:
        """Eight bytes from every position on, as one number."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))

    def lane(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ``size`` (LANE at most) bytes from each ``start`` on as one number."""
        return self._wide[start] & _MASKS[size]

    def values(self, base: int = FIXED.word[0]) -> np.ndarray:
        """A residue for each word: that of words of up to LANE bytes tells their bytes and length, that of longer ones is a polynomial in ``base``."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        out = self.lane(self.start, np.minimum(size, LANE)) | np.minimum(size, LANE + 1).astype(np.uint64) << np.uint64(56)
        some = np.flatnonzero(size > LANE)
        digits = -(-size[some] // LANE)
        for i in some[digits > LANES].tolist():
            word, value = self.bytes_of(i), 0
            for at in range(0, len(word), LANE):
                value = (value * base + int.from_bytes(word[at : at + LANE], "little")) % PRIME
            out[i] = (value * base + len(word)) % PRIME
        some, digits = some[digits <= LANES], digits[digits <= LANES]
        if len(some):
            order = np.argsort(-digits, kind="stable")
            some, digits = some[order], digits[order]
            value = np.zeros(len(some), np.uint64)
            for j in range(int(digits[0])):
                n = int(np.searchsorted(-digits, -j))  # the words that have a digit j come first
                at = self.start[some[:n]] + j * LANE
                value[:n] = reduce(times(value[:n], base) + self.lane(at, np.minimum(self.end[some[:n]] - at, LANE)))
            out[some] = reduce(times(value, base) + size[some].astype(np.uint64))
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def equal(self, mine: np.ndarray, other: Words, others: np.ndarray) -> np.ndarray:
        """Whether the words ``mine`` are the words ``others`` of ``other``, byte for byte."""
        size = self.end[mine] - self.start[mine]
        same = size == other.end[others] - other.start[others]
        for i in np.flatnonzero(same & (size > LANE * LANES)).tolist():
            same[i] = self.bytes_of(mine[i]) == other.bytes_of(others[i])
        for at in range(0, LANE * LANES, LANE):
            left = np.flatnonzero(same & (size > at) & (size <= LANE * LANES))
            if not len(left):
                break
            n = np.minimum(size[left] - at, LANE)
            same[left] = self.lane(self.start[mine[left]] + at, n) == other.lane(other.start[others[left]] + at, n)
        return same


def release() -> None:
    """Hands freed memory back to the system: Python workers live on, and share an executor's memory with its other processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of texts of about ``limit`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    word = ~separators[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, word
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a text's words never run into the next text
    start = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1], after[:-1] = False, word
    end = np.flatnonzero(word & (~after[1:] | edge[1:])) + 1
    doc = np.searchsorted(start, offsets)
    return Words(data, start, end, doc)


def rolling(h: np.ndarray, k: int, base: int = FIXED.window[0]) -> np.ndarray:
    """Rabin-Karp residue of every ``k`` consecutive residues (``len(h) - k + 1`` of them).

    The polynomial of k terms is put together from those of powers of two: p(a+b) = p(a) * base^b + p(b).
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, h, 1
    left = k
    while left:
        if left & 1:
            if out is None:
                out, done = part, width
            else:
                shifted = part[done:]
                m = min(len(out), len(shifted))
                out = reduce(times(out[:m], pow(base, width, PRIME)) + shifted[:m])
                done += width
        left >>= 1
        if left:
            part = reduce(times(part[:-width], pow(base, width, PRIME)) + part[width:])
            width *= 2
    return out[:n]


def windows(w: Words, k: int, key: Key = FIXED) -> np.ndarray:
    """A 64-bit hash, one to one with the residue, of every ``k`` consecutive words, over the ends of texts too."""
    return mix(rolling(w.values(key.word[0]), k, key.window[0]))


def wide_windows(w: Words, k: int, key: Key) -> tuple[np.ndarray, np.ndarray]:
    """The same hash, and 32 bits of a second, independent residue."""
    return windows(w, k, key), rolling(w.values(key.word[1]), k, key.window[1]).astype(np.uint32)


def group(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs together, and where each pair begins in it."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same, differ = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & differ).any():  # one 64-bit hash of two windows
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same, differ = a[1:] == a[:-1], b[1:] != b[:-1]
    return order, np.flatnonzero(np.r_[True, ~same | differ]) if len(order) else np.zeros(0, np.int64)


def window_index(counts: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every window of ``k`` words inside one text, and how many each text has."""
    n = np.maximum(counts - (k - 1), 0)
    total = np.cumsum(n)
    index = np.arange(int(total[-1]) if len(n) else 0) + np.repeat(first - (total - n), n)
    return index, n
