"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item, or the whole item where it has fewer. A document contains a window only if
it contains all its shingles, so its necessary prefix, with shingles in order of rarity, is one: the rarest.

1. Shingles of the windows are counted over all documents; a window with a shingle that no document has is out.
2. Positions of documents where a prefix shingle stands are joined with the windows on that shingle.
3. A shingle at position p of a document that stands j words into the window fixes where the window would begin: bounds on position and
   length (it must lie inside the document) drop what cannot fit.
4. The words are compared, and the hits merged to intervals.

Texts are read twice and never shuffled; a bitmap of at most 2^MAX_BITS bits tells tasks which shingles may matter. It only saves
work: the joins decide. Nothing else of the benchmark is gathered, whatever its size.

Edge cases
----------
* null or empty text, or a text without words: n_words 0, nothing hit, not contaminated;
* items without words or with a null id take no part; repeated items count once by id;
* a document may contain a window many times: all of it is hit;
* repeated rows and null document ids: each row is judged by its own text;
* empty tables: no items leave every document clean; no documents, no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .scratch import Scratch

WINDOW = 13
SHINGLE = 5
#: A document is contaminated when SHARE * (words hit) reaches its number of words.
SHARE = 20
#: The bitmap has 2^MAX_BITS bits at most (16 MiB), 16 for each shingle below that.
MAX_BITS = 27
#: Distinct shingles that a task counts before it hands them on.
COUNTER = 1 << 20


#: Separators of words become blanks.
_BLANKS = bytes(0x20 if x else b for b, x in enumerate(W.ALNUM))


def _plain(raw: bytes) -> str:
    return b" ".join(raw.translate(_BLANKS).split()).decode()


def _tokens(w: W.Words, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive words, different for each k."""
    return W.mix(W.windows(w, k) ^ np.uint64(k))


def _words(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> W.Words:
    return W.split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], W.ALNUM, True)


def _item_windows(window: int, shingle: int):
    """(item, n, k, words, tokens): each window's words joined by one space, and its shingles of k words in their order."""
    schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("words", pa.string()), ("tokens", pa.list_(pa.int64()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            for at, to in W.chunks(offsets):
                w = _words(data, offsets, at, to)
                tokens, out = {}, []
                for item, a, b in zip(rows.column("id")[at:to].to_pylist(), w.doc[:-1].tolist(), w.doc[1:].tolist()):
                    n = min(window, b - a)
                    k = min(shingle, n)
                    if n and k not in tokens:
                        tokens[k] = _tokens(w, k).view(np.int64)
                    words = [w.bytes_of(i).decode() for i in range(a, b)]
                    out += [(item, n, k, " ".join(words[i : i + n]), tokens[k][a + i : a + i + n - k + 1]) for i in range(b - a - n + 1) if n]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def _bitmap(tokens: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits for the leading bits of ``n`` tokens, and how many leading bits are looked at."""
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(16 * max(1, n)))))
    bit = F.shiftrightunsigned("token", 64 - bits) + 1
    parts = tokens.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("part"))
    out = np.zeros((1 << bits >> 15 or 1, 4096), np.uint8)
    for r in parts.collect():
        out[r["bucket"] - 1] = np.frombuffer(r["part"], np.uint8)
    return out.ravel(), bits


def _marked(tokens: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    bit = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)


def _count(shared, lengths: list[int]):
    """(token, n): occurrences of marked shingles."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = shared.value
        found, held = [], 0

        def batch() -> pa.RecordBatch:
            token, n = (np.concatenate(x) for x in zip(*found))
            token, inverse = np.unique(token, return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(token)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(total)], names=["token", "n"])

        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            for at, to in W.chunks(offsets):
                w = _words(data, offsets, at, to)
                for k in lengths:
                    position, _ = W.window_index(w.counts(), w.doc[:-1], k)
                    if len(position):
                        tokens = _tokens(w, k)[position]
                        found.append(np.unique(tokens[_marked(tokens, bitmap, bits)], return_counts=True))
                        held += len(found[-1][0])
                if held > COUNTER:
                    yield batch()
                    found, held = [], 0
        if held:
            yield batch()

    return run


def _places(shared, lengths: list[int], window: int):
    """A row (row, id, n_words) for each document, and (row, n_words, token, at, first, words) for each place ``at`` of a marked shingle: the
    words around it, of which the first is word ``first`` of the document."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("token", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = shared.value
        row = TaskContext.get().partitionId() << 40
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            for at, to in W.chunks(offsets):
                w = _words(data, offsets, at, to)
                size, number = w.counts(), np.arange(row, row + to - at)
                row += to - at
                nothing = pa.nulls(to - at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(number), rows.column("id")[at:to], pa.array(size), nothing, *(pa.nulls(to - at, schema.field(c).type) for c in ("at", "first", "words"))], schema=schema)
                for k in lengths:
                    position, n = W.window_index(size, w.doc[:-1], k)
                    if not len(position):
                        continue
                    tokens = _tokens(w, k)[position]
                    marked = _marked(tokens, bitmap, bits)
                    text = np.repeat(np.arange(to - at), n)[marked]
                    for i in range(0, len(marked), 20_000):
                        some = slice(i, i + 20_000)
                        owner, place = text[some], position[marked[some]]
                        begin, end = np.maximum(place - window + 1, w.doc[owner]), np.minimum(place + window, w.doc[owner + 1])
                        words = [_plain(w.data[x:y].tobytes()) for x, y in zip(w.start[begin].tolist(), w.end[end - 1].tolist())]
                        first = w.doc[owner]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number[owner]), pa.nulls(len(owner), pa.int64()), pa.array(size[owner]), pa.array(tokens[marked[some]].view(np.int64)), pa.array((place - first).astype(np.int32)), pa.array((begin - first).astype(np.int32)), pa.array(words, pa.string())],
                            schema=schema,
                        )
        W.release()

    return run


def _words_of_window(found: DataFrame) -> DataFrame:
    """(row, n_words, begin, end, items): joined places whose words are the window's."""
    begin = F.col("at") - F.col("j")
    fits = (begin >= F.col("first")) & (begin + F.col("n") <= F.col("n_words"))
    words = F.array_join(F.slice(F.split("words", " "), begin - F.col("first") + 1, F.col("n")), " ")
    return found.filter(fits).filter(words == F.col("window")).select("row", "n_words", begin.alias("begin"), (begin + F.col("n")).alias("end"), "items")


def _merged(hits: DataFrame) -> DataFrame:
    """(row, n_hit, hits): overlapping and touching intervals of each row put together."""
    order = Window.partitionBy("row").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.groupBy("row", "begin").agg(F.max("end").alias("end")).withColumn("new", F.when(F.col("begin") <= before, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(order)).groupBy("row", "island").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(id_col, n_words, n_hit, item_ids, hits, contaminated): item_ids sorted as strings, hits as word intervals [start, end)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    docs = X.columns_of(docs, id_col, text_col)
    items = X.columns_of(benchmark, item_col, item_text_col, "string").dropna()
    windows = items.mapInArrow(_item_windows(window, shingle), "item string, n int, k int, words string, tokens array<long>")
    windows = windows.groupBy("words").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("tokens").alias("tokens"), F.sort_array(F.collect_set("item")).alias("items"))
    windows, windows_at = scratch.write(windows.select(F.col("words").alias("window"), "n", "k", "tokens", "items"), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # SHINGLE of them at most

    def share(tokens: DataFrame):
        return spark.sparkContext.broadcast(_bitmap(tokens, tokens.count()))

    shingles, shingles_at = scratch.write(windows.select(F.explode("tokens").alias("token")).distinct(), "shingles")
    counts = docs.select("text").mapInArrow(_count(share(shingles), lengths), "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))
    placed = windows.select("window", F.posexplode("tokens").alias("j", "token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "j")).alias("x")
    prefix = placed.groupBy("window").agg(rarest).filter("x.count > 0").select("window", "x.token", "x.j").join(windows.select("window", "n", "items"), "window")
    prefix, prefix_at = scratch.write(prefix, "prefix")
    chosen, chosen_at = scratch.write(prefix.select("token").distinct(), "chosen")
    found, found_at = scratch.write(docs.mapInArrow(_places(share(chosen), lengths, window), "row long, id long, n_words long, token long, at int, first int, words string"), "places")
    hits, hits_at = scratch.write(_words_of_window(found.filter("token is not null").join(prefix, "token")), "hits")
    item_ids = hits.groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    per_row = _merged(hits).join(item_ids, "row")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = found.filter("token is null").select("row", "id", "n_words").join(per_row, "row", "left")
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("hits", none).alias("hits"))
    out, _ = scratch.write(out, "result")
    scratch.drop(windows_at, shingles_at, prefix_at, chosen_at, found_at, hits_at)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; each row is judged by its own text, also where ids repeat or are null."""
    number = "__tessera_row"
    rows, _ = Scratch(docs.sparkSession, "decontamination").write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = find_benchmark(rows, benchmark, number, text_col, **options)
    return rows.join(found.filter("contaminated").select(number), number, "left_anti").drop(number)
