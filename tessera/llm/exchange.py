"""Counting 64-bit hashes of all documents without a row for each.

A mapper groups the hashes of a batch of documents by their top bits and sends one packed row per bucket; the
task that owns a bucket sees every batch's part of it, counts with one sort, and replies to the batches with what
each needs to know; a batch then puts its replies together per document. A hash that a third of all documents
hold costs one entry per batch, not one per document, so no bucket grows hot.

Batches are told apart by task and position, so the input must be read the same way again when a task is repeated: ``settled``
writes what comes out of a shuffle, the rest are files. Expressions that give other values when repeated are the caller's to write first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import buffers, release

#: Bytes of text in one batch.
BATCH_BYTES = 8 << 20
#: Documents in one batch at most (document numbers are 16 bits).
BATCH_DOCS = 60_000
#: Bytes of input for one bucket.
BUCKET_BYTES = 16 << 20
MIN_BITS = 10

ROW = "key int, batch long, kind int, a binary, b binary, c binary, d binary"
ROW_SCHEMA = pa.schema([("key", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcd")])
META, PART, REPLY = 0, 1, 2


def bucket_bits(df: DataFrame) -> int:
    """Bits of the bucket number, from the optimizer's estimate of the input's size; any value gives the same result."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(24, max(MIN_BITS, math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch id, rows, bytes, offsets) for columns id, text, in batches of bounded size; one longer text is its own."""
    context, count = TaskContext.get(), 0
    base = (context.partitionId() if context else 0) << 32
    for rows in source:
        data, offsets = buffers(rows.column("text"))
        at, n = 0, rows.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1
            to = min(n, max(to, at + 1), at + BATCH_DOCS)
            yield base + count, rows.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            count, at = count + 1, to
            release()


def own_key(batch: int) -> int:
    """A negative key for what a batch sends to itself, spread over the tasks."""
    return -1 - (batch * 0x9E3779B97F4A7C15 >> 20) % (1 << 30)


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), ROW_SCHEMA)], schema=ROW_SCHEMA)


def by_bucket(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups by bucket and keeps the given order within; the buckets and where each begins (with the end)."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    return order, sorted_[begin], np.r_[begin, len(sorted_)]


def pack(hashes: np.ndarray, low: int, width: int) -> np.ndarray:
    """Bytes ``low`` to ``low + width`` of each hash, as an (n, width) byte matrix."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, low : low + width]


def unpack(data: bytes, low: int, width: int, bucket: int, bits: int) -> np.ndarray:
    """The hashes that ``pack`` was given, but for bytes below ``low`` (zero)."""
    part = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, low : low + width] = part
    out = out.view(np.uint64).ravel()
    if bits == 64:  # nothing was left out
        return out
    keep = np.uint64((1 << (64 - bits)) - 1)
    return (out & keep) | np.uint64(bucket << (64 - bits))


def settled(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` or, where a shuffle gives its rows in an order that may change, a written copy."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs, _ = scratch.write(docs, "settled")
    return docs


def exchange(docs: DataFrame, mapper: Callable, reducer: Callable, assembler: Callable, schema: str) -> DataFrame:
    """``mapper(batches)`` gives ROWs, ``reducer(rows of one bucket)`` gives REPLY rows, ``assembler(rows of one batch)`` gives ``schema``.

    META rows travel with the buckets under keys of their own (negative) and reach the assembler untouched.
    """

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows if key[0] < 0 else reducer(int(key[0]), rows)

    sent = docs.mapInArrow(mapper, ROW)
    replies = sent.groupBy("key").applyInPandas(count, ROW)

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        out = assembler(rows)
        release()
        return out

    return replies.groupBy("batch").applyInPandas(assemble, schema)


def columns_of(df: DataFrame, id_col: str, text_col: str, kind: str = "long") -> DataFrame:
    """Only the id and the text, under names of our own: no other column of the input can clash."""
    return df.select(F.col(f"`{id_col}`").cast(kind).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
