"""Byte-level BPE encoding and decoding with a public rank file.

A text is split by a pattern, and each match is encoded by itself: while any two neighbouring tokens make a token of the
vocabulary, the leftmost pair of the smallest rank is merged. Distinct pieces are put into numpy matrices, one for each
bucket of byte lengths, padded on the right. In a round every row merges one pair: an argmin over its pair
ranks finds it, the columns to its right move one to the left, and only the two pairs beside the new token are looked up, in an open-addressing hash
table. Rows without a pair left are taken out, so matrices shrink in both directions.

A piece of more than ``LONG`` bytes (a run of one letter, say) would take a round for each of its merges; it goes through a
heap of pairs instead, with the same result.

Edge cases
----------
* null or empty text: no ids, empty bytes;
* special tokens are never made, their strings are ordinary text;
* repeated rows, null ids, extra columns: every row is encoded by itself; empty table: empty result;
* ids that are not in the vocabulary raise an error when decoded.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .words import release

#: Pieces longer than this (in bytes) go through the heap.
LONG = 192
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, LONG)
_NONE = np.int32(0x7FFFFFFF)
#: Distinct pieces that a task keeps encoded; beyond, it starts anew.
CACHE_PIECES = 200_000
#: Characters of text handled at a time.
CHUNK_CHARS = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    tokens = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


class PairTable:
    """(left id, right id) -> id of their concatenation, in a hash table with linear probing."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        keys, values = [], []
        for t, i in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left, value = np.array(keys, np.uint64), np.array(values, np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = left[free]  # of several for one slot, one stays
            done = self.keys[slot] == left
            self.values[slot[done]] = value[done]
            left, value, slot = left[~done], value[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)
        self.single = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError(f"the vocabulary lacks the bytes {np.flatnonzero(self.single < 0).tolist()}: no text that holds one could be encoded")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs, _NONE where they make no token (or either is padding, -1)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], _NONE)
        left_over = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(left_over):
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (found != _EMPTY)]
        return out


def merge_matrix(ids: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Merges every row of a padded (-1) matrix of byte ids to its tokens."""
    out: list = [None] * len(ids)
    row = np.arange(len(ids))
    n, width = ids.shape
    rank = table.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int32)
    while len(ids):
        best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
        new = rank[np.arange(len(ids)), best] if rank.shape[1] else np.full(len(ids), _NONE, np.int32)
        done = new == _NONE
        if done.any():
            for r, tokens in zip(row[done].tolist(), ids[done]):
                out[r] = tokens[tokens >= 0]
            live = ~done
            ids, rank, best, new, row = ids[live], rank[live], best[live], new[live], row[live]
            if not len(ids):
                break
        every = np.arange(len(ids))
        column = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
        ids[every, best] = new
        if ids.shape[1] == 1:
            rank = np.zeros((len(ids), 0), np.int32)
            continue
        column = column[:-1]
        rank = np.take_along_axis(rank, column + (column >= best[:, None]), axis=1)
        before, after = np.flatnonzero(best > 0), np.flatnonzero(best < ids.shape[1] - 1)
        rank[before, best[before] - 1] = table.lookup(ids[before, best[before] - 1], new[before])
        rank[after, best[after]] = table.lookup(new[after], ids[after, best[after] + 1])
    return out


def merge_long(piece: bytes, table: PairTable) -> np.ndarray:
    """The same merges for one long piece: a heap of (rank, position) over a linked list."""
    ids = table.single[np.frombuffer(piece, np.uint8)]
    first = table.lookup(ids[:-1], ids[1:])
    known: dict[tuple[int, int], int] = {}

    def rank_of(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(table.lookup(np.array([a], np.int32), np.array([b], np.int32))[0])
        return known[a, b]

    ids = ids.tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue  # one of the two has been merged since
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            s = rank_of(r, ids[after[i]])
            if s != _NONE:
                heapq.heappush(heap, (s, i, r, ids[after[i]]))
        if before[i] >= 0:
            s = rank_of(ids[before[i]], r)
            if s != _NONE:
                heapq.heappush(heap, (s, before[i], ids[before[i]], r))
    return np.array([x for x in ids if x >= 0], np.int32)


class Codec:
    """A vocabulary with its split pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.table = tokens, pattern, PairTable(tokens)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        length = np.array([len(p) for p in pieces])
        bucket = np.searchsorted(_WIDTHS, length)
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            if b == len(_WIDTHS):
                for i in mine.tolist():
                    out[i] = merge_long(pieces[i], self.table)
                continue
            width = _WIDTHS[b]
            for at in range(0, len(mine), 1 << 15):
                part = mine[at : at + (1 << 15)].tolist()
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < length[part][:, None], self.table.single[raw], np.int32(-1))
                for i, tokens in zip(part, merge_matrix(ids, self.table)):
                    out[i] = tokens
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class PieceCache:
    """Encodes texts piece by piece; the ids of distinct pieces are kept, up to a bound, then it starts anew.

    ``split`` gives the pieces of a text, ``encode`` the ids of a list of new pieces.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list], bound: int = CACHE_PIECES):
        self.split, self.encode_new, self.bound = split, encode, bound
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > self.bound:
            self._reset()
        number, known = self.number, len(self.number)
        codes = [np.array(list(map(number.__getitem__, self.split(text))), np.int64) for text in texts]
        if len(number) > known:
            tokens = self.encode_new(list(islice(number, known, None)))
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(tokens), np.uint32, int(size.sum()))])
        out = []
        for own in codes:
            size = self.size[own]
            index = np.repeat(self.start[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append(self.flat[index].astype("<u4"))
        return out


def encoder(codec: Codec) -> PieceCache:
    return PieceCache(regex.compile(codec.pattern).findall, lambda pieces: codec.encode_pieces([p.encode() for p in pieces]))


def _encode(codec, decode: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Codec = codec.value
        cache = encoder(c)
        for rows in source:
            texts = [t or "" for t in rows.column("text").to_pylist()]
            size = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < rows.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + CHUNK_CHARS, side="right")) - 1)
                ids = cache.encode(texts[at:to])
                columns = [rows.column("id").slice(at, to - at), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decode:
                    columns.append(pa.array([c.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])
                at = to
        del cache
        release()

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids[, decoded]): ids as little-endian unsigned 32-bit integers, decoded the bytes that they stand for.

    The vocabulary's tables are broadcast; their size is that of the vocabulary, not of the data.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))
    out = X.columns_of(docs, id_col, text_col).mapInArrow(_encode(codec, decode), "id long, n_tokens long, ids binary" + ", decoded binary" * decode)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): the bytes of ids as ``encode`` gives them; null ids give empty bytes."""
    tokens = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in source:
            found = [b"".join(map(tokens.value.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], names=["id", "decoded"])

    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, "id long, decoded binary")
    return out.withColumnRenamed("id", id_col)
