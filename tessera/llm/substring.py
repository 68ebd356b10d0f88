"""Substring dedup: repeated word windows become maximal removal intervals.

Rabin-Karp hashes of every window of ``window`` words are counted over all documents (see ``exchange``): each
hash gets the smallest document id in which it starts, and a document with a larger id loses every word that such
a window covers. Overlapping windows merge into maximal intervals.

Edge cases
----------
* null or empty text: no words, nothing removed, empty kept text;
* fewer words than a window: nothing removed;
* a window that repeats inside one document only: kept;
* equal ids (repeated rows): they are one document, so neither removes the other; both lose what a smaller id holds;
* null id: the row takes no part, it keeps all its words and removes nothing from others;
* empty table: empty result; extra columns are ignored, whatever their names.

Windows are compared by 93 bits of two Rabin-Karp residues, whose bases are drawn anew for each job; within one document, where hits
are looked up, by the 61 bits of the first. The first is equal for two distinct windows with a chance of some 2^-57 whatever the texts, both
with some 2^-89: n distinct windows give n^2 / 2^90 false matches in the mean, 2 * 10^-8 for 4.6 * 10^9 windows and 0.1 for 10^13. Words
themselves are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .scratch import Scratch

#: Words in one window.
WINDOW = 13
_HITS = "id long, hashes binary"
_SPANS = "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, key: W.Key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window and the text it lies in."""
    found, more, text = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
    for at, to in W.chunks(offsets):
        w = W.split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], W.SPACE, False)
        index, n = W.window_index(w.counts(), w.doc[:-1], window)
        if len(index):
            a, b = W.wide_windows(w, window, key)
            found.append(a[index])
            more.append(b[index])
            text.append(np.repeat(np.arange(at, to, dtype=np.int32), n))
    return np.concatenate(found), np.concatenate(more), np.concatenate(text)


def _per_id(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(ids)]
    return ids[begin], [hashes[a:b].tobytes() for a, b in zip(begin, end)]


def _mapper(bits: int, window: int, key: W.Key):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, data, offsets in X.batches(source):
            ids = rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            hashes, more, text = _windows(data, offsets, window, key)
            if not len(hashes):
                continue
            # One entry per window: in the document of the smallest id. Those of larger ids are hit for sure.
            order, begin = W.group(hashes, more)
            hashes, owner = hashes[order], ids[text[order]]
            least = np.minimum.reduceat(owner, begin)
            size = np.diff(np.r_[begin, len(hashes)])
            hit = owner > np.repeat(least, size)
            pairs = pd.DataFrame({"i": owner[hit], "h": hashes[hit]}).drop_duplicates()
            out = [(X.own_key(batch), batch, X.META, pairs["i"].to_numpy().tobytes(), pairs["h"].to_numpy().tobytes(), None, None)] if len(pairs) else []
            # Within a bucket entries stand by id, so that ids are small differences.
            hashes, more = hashes[begin], more[order[begin]]
            order = np.argsort(least, kind="stable")
            hashes, more, least = hashes[order], more[order], least[order]
            order, buckets, begin = X.by_bucket(hashes, bits)
            packed, more, least = X.pack(hashes[order], 0, 7), more[order], least[order]
            for k, a, b in zip(buckets.tolist(), begin[:-1].tolist(), begin[1:].tolist()):
                gaps = np.diff(least[a:b])
                gaps = gaps.astype(np.uint16) if not len(gaps) or (0 <= gaps.min() and gaps.max() < 1 << 16) else gaps
                out.append((k, batch, X.PART, packed[a:b].tobytes(), gaps.tobytes(), least[a : a + 1].tobytes(), more[a:b].tobytes()))
            yield X.as_rows(out)

    return run


def _ids(gaps: bytes, first: bytes, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[0] = np.frombuffer(first, np.int64)[0]
    out[1:] = np.frombuffer(gaps, np.uint16 if len(gaps) == 2 * (n - 1) else np.int64)
    return np.cumsum(out)


def _reducer(bits: int):
    def run(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [X.unpack(a, 0, 7, bucket, bits) for a in rows["a"]]
        hashes = np.concatenate(parts)
        ids = np.concatenate([_ids(g, f, len(p)) for g, f, p in zip(rows["b"], rows["c"], parts)])
        order, begin = W.group(hashes, np.concatenate([np.frombuffer(d, np.uint32) for d in rows["d"]]))
        least = np.empty(len(ids), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.r_[begin, len(ids)]))
        hit = ids > least
        out, at = [], 0
        for batch, part in zip(rows["batch"], parts):
            mine = np.flatnonzero(hit[at : at + len(part)]) + at
            at += len(part)
            if len(mine):
                out.append((-1, batch, X.REPLY, ids[mine].tobytes(), hashes[mine].tobytes(), None, None))
        return pd.DataFrame(out, columns=["key", "batch", "kind", "a", "b", "c", "d"])

    return run


def _assemble(rows: pd.DataFrame) -> pd.DataFrame:
    ids = np.concatenate([np.frombuffer(a, np.int64) for a in rows["a"]])
    hashes = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["b"]])
    ids, hashes = _per_id(ids, hashes)
    return pd.DataFrame({"id": ids, "hashes": hashes})


def _cut(window: int, key: W.Key):
    """Marks the words of hit windows, merges them to intervals and writes what is left."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            hits = rows.column("hits")
            for at, to in W.chunks(offsets):
                base = data[offsets[at] : offsets[to]]
                w = W.split(base, offsets[at : to + 1] - offsets[at], W.SPACE, False)
                raw, values = base.tobytes(), w.values(key.word[0])
                n_words, n_removed, kept, spans = w.counts(), [], [], []
                for k in range(to - at):
                    a, b = int(w.doc[k]), int(w.doc[k + 1])
                    lists = hits[at + k].as_py()
                    start = np.zeros(0, np.int64)
                    if lists:
                        bad = np.frombuffer(b"".join(lists), np.uint64)
                        start = np.flatnonzero(np.isin(W.mix(W.rolling(values[a:b], window, key.window[0])), bad))
                    if not len(start):
                        n_removed.append(0)
                        spans.append([])
                        kept.append(b" ".join(raw[w.start[a] : w.end[b - 1]].split()).decode() if b > a else "")
                        continue
                    edge = np.zeros(b - a + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
                    n_removed.append(int(gone.sum()))
                    words = raw[w.start[a] : w.end[b - 1]].split()
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id")[at:to], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["id", "n_words", "n_removed", "kept_text", "removed"],
                )
        W.release()

    return run


def _hits(docs: DataFrame, window: int, key: W.Key) -> DataFrame:
    """(id, hits): the hashes of the windows of each document that a smaller id holds. ``docs`` has columns id, text."""
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = X.settled(docs.filter("id is not null"), scratch)
    bits = X.bucket_bits(docs)
    hits, _ = scratch.write(X.exchange(docs, _mapper(bits, window, key), _reducer(bits), _assemble, _HITS), "hits")
    return hits.groupBy("id").agg(F.collect_list("hashes").alias("hits"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text, removed): the words left, joined by one space, and the removed word intervals [start, end)."""
    docs, key = X.columns_of(docs, id_col, text_col), W.new_key()
    out = docs.join(_hits(docs, window, key), "id", "left").select("id", "text", "hits").mapInArrow(_cut(window, key), _SPANS)
    return out.withColumnRenamed("id", id_col)


def cut_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns; a text that loses words becomes its other words, joined by one space, the rest stay as they are."""
    own, hits, key = "__tessera_id", "__tessera_hits", W.new_key()
    found = _hits(X.columns_of(docs, id_col, text_col), window, key).select(F.col("id").alias(own), F.col("hits").alias(hits))
    cut, schema = _cut(window, key), docs.schema

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            only = pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.int64()), rows.column(text_col), rows.column(hits)], names=["id", "text", "hits"])
            done = pa.Table.from_batches(cut(iter([only]))).combine_chunks()
            changed = pa.array(done.column("n_removed").to_numpy() > 0)
            text = pc.if_else(changed, done.column("kept_text"), rows.column(text_col).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([text.combine_chunks() if name == text_col else rows.column(name) for name in schema.names], names=schema.names)

    joined = docs.join(found, F.col(f"`{id_col}`").cast("long") == F.col(own), "left").drop(own)
    return joined.mapInArrow(run, schema)
