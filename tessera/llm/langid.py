"""Language identification by words first, with backoff to ever shorter character n-grams.

Training counts every word of every labelled document by language, and every n-gram of these words (with marks at their ends); the
logarithm of a key's frequency in each language is its row. A word that training never met is scored by its n-grams: the longest length
of which at least one n-gram was met, down to single characters, gives the mean of their rows. A text's score for a language
is the sum over its words; the largest wins and its posterior probability is the score.

All words and n-grams count, however rare: their tables stay in Spark. The HOT_WORDS and HOT_GRAMS most frequent ones are also broadcast,
so that only rare ones are joined with the tables; results do not depend on these two numbers. Rows are whole numbers (units of
1 / UNIT), so that sums are the same in any order.

Edge cases
----------
* null text, or a text without a letter: ``und`` with score 0; so is every text when nothing can be learned;
* a word of which not even a character was met adds nothing;
* rows whose label or id is null teach nothing; repeated rows are counted and predicted each;
* equal scores: the language that sorts first; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .labelled import crc
from .scratch import Scratch

#: Most frequent words and n-grams that tasks hold themselves.
HOT_WORDS = 40_000
HOT_GRAMS = 60_000
LONGEST = 5
UNIT = 1 << 24
#: Entries of a task's counters before they are handed on.
COUNTER = 300_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_WORD_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters (and other characters beyond ASCII), as UTF-8."""
    return text.lower().encode().translate(_WORD_BYTES).split()


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(counters: dict[str, Counter], name: str) -> pa.RecordBatch:
    pairs = [(k, lang, n) for lang, c in counters.items() for k, n in c.items()]
    keys, langs, n = zip(*pairs) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(n, pa.int64())], names=[name, "lang", "n"])


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters: dict[str, Counter] = {}
    for rows in source:
        for text, lang in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist()):
            counters.setdefault(lang, Counter()).update(words_of(text or ""))
            if sum(map(len, counters.values())) > COUNTER:
                yield _counted(_as_text(counters), "word")
                counters = {}
    yield _counted(_as_text(counters), "word")


def _as_text(counters: dict[str, Counter]) -> dict[str, dict[str, int]]:
    return {lang: {w.decode(): n for w, n in c.items()} for lang, c in counters.items()}


def _count_grams(langs: list[str]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {lang: Counter() for lang in langs}
        for rows in source:
            for word, *counts in zip(*(rows.column(c).to_pylist() for c in ["word", *(f"n{i}" for i in range(len(langs)))])):
                for lang, n in zip(langs, counts):
                    if n:
                        own = counters[lang]
                        for length in range(1, LONGEST + 1):
                            for gram in grams_of(word, length):
                                own[gram] += n
            if sum(map(len, counters.values())) > COUNTER:
                yield _counted(counters, "gram")
                counters = {lang: Counter() for lang in langs}
        yield _counted(counters, "gram")

    return run


@dataclass
class Table:
    """Keys with their rows: all of them in ``rows`` (key, v0, v1, ...), the most frequent ones at hand."""

    rows: DataFrame
    hot: dict
    hot_rows: np.ndarray


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: Table
    prior: np.ndarray


def _values(langs: list[str]) -> list[str]:
    return [f"v{i}" for i in range(len(langs))]


def _by_language(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    return counts.groupBy(key).agg(*(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)))


def _table(counts: DataFrame, key: str, langs: list[str], hot: int, as_key) -> Table:
    """Rows are the logarithms of frequencies by language, half a count added to each."""
    names = [f"n{i}" for i in range(len(langs))]
    size, *totals = counts.agg(F.count("*"), *(F.sum(n) for n in names)).first()
    row = [F.round(F.log((F.col(n) + 0.5) / F.lit((total or 0) + 0.5 * max(1, size))) * UNIT).cast("long").alias(v) for n, total, v in zip(names, totals, _values(langs))]
    most = counts.orderBy(F.desc(sum(map(F.col, names), F.lit(0))), key).limit(hot).select(key, *row).toPandas()
    nothing = np.zeros((1, len(langs)), np.int64)
    return Table(counts.select(key, *row), {as_key(k): i for i, k in enumerate(most[key])}, np.concatenate([most.drop(columns=key).to_numpy(np.int64), nothing]))


def fit(docs: DataFrame) -> Model | None:
    """Learns from all rows of (text, lang) whose lang is not null; None without any word."""
    scratch = Scratch(docs.sparkSession, "langid")
    docs = docs.filter("lang is not null")
    n_docs = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(n_docs)
    if not langs:
        return None
    words, _ = scratch.write(_by_language(docs.select("text", "lang").mapInArrow(_count_words, "word string, lang string, n long"), "word", langs), "words")
    met = words.agg(*(F.sum(f"n{i}") for i in range(len(langs)))).first()
    if not any(met):
        return None
    # A language without a word cannot be told from others.
    words = words.select("word", *(F.col(f"n{i}").alias(f"n{k}") for k, i in enumerate(i for i, n in enumerate(met) if n)))
    langs = [lang for lang, n in zip(langs, met) if n]
    grams, _ = scratch.write(_by_language(words.mapInArrow(_count_grams(langs), "gram string, lang string, n long"), "gram", langs), "grams")
    prior = np.log(np.array([n_docs[x] for x in langs], float) / sum(n_docs.values()))
    return Model(langs, _table(words, "word", langs, HOT_WORDS, str.encode), _table(grams, "gram", langs, HOT_GRAMS, str), prior)


class _Hot(dict):
    """Word to row of a matrix; words that are not there get the last row, of zeros, and are noted."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.others, self.nothing = [], len(known)

    def __missing__(self, word: bytes) -> int:
        self.others.append(word)
        return self.nothing


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType], sums: list[np.ndarray], langs: int) -> pa.RecordBatch:
    matrix = np.array(sums, np.int64).reshape(-1, langs)
    arrays = {c: pa.array(columns[c], kind) for c, kind in kinds.items()} | {f"v{i}": pa.array(matrix[:, i]) for i in range(langs)}
    return pa.RecordBatch.from_pydict(arrays)


def _look_up(shared, langs: int):
    """A row (row, id, null, whether it has a letter, sum over hot words) for every text, and (row, null, word, times, zeros) for its other words."""
    kinds = {"row": pa.int64(), "id": pa.int64(), "word": pa.string(), "k": pa.int64()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value
        hot, nothing = _Hot(known), np.zeros(langs, np.int64)
        for batch in source:
            out, sums = {c: [] for c in kinds}, []
            for row, i, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
                letters = text is not None and _LETTER.search(text) is not None
                found = [(row, i, None, int(letters))]
                sums.append(rows[list(map(hot.__getitem__, words_of(text)))].sum(axis=0) if letters else nothing)
                if hot.others:
                    found += [(row, None, w.decode(), n) for w, n in Counter(hot.others).items()]
                    sums += [nothing] * (len(found) - 1)
                    hot.others = []
                for values, column in zip(out.values(), zip(*found)):
                    values.extend(column)
            yield _batch(out, kinds, sums, langs)

    return run


def _cut(shared, langs: int):
    """For words that training never met: (word, size, null, known, sum) over the hot n-grams of a length, and (word, size, gram, times, zeros)
    for other n-grams, from the longest length on until one has a hot n-gram."""
    kinds = {"word": pa.string(), "size": pa.int32(), "gram": pa.string(), "k": pa.int64()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value
        nothing = np.zeros(langs, np.int64)
        for batch in source:
            out, sums = {c: [] for c in kinds}, []
            for word in batch.column("word").to_pylist():
                for size in range(LONGEST, 0, -1):
                    grams = grams_of(word, size)
                    own = [known[g] for g in grams if g in known]
                    found = [(word, size, g, n) for g, n in Counter(g for g in grams if g not in known).items()]
                    sums += [nothing] * len(found)
                    if own:
                        found.append((word, size, None, len(own)))
                        sums.append(rows[own].sum(axis=0))
                    for values, column in zip(out.values(), zip(*found)):
                        values.extend(column)
                    if own:
                        break
            yield _batch(out, kinds, sums, langs)

    return run


def _unmet(words: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(word, v0, v1, ...) by backoff; words of which no character is known are left out."""
    values = _values(model.langs)
    shared = words.sparkSession.sparkContext.broadcast((model.grams.hot, model.grams.hot_rows))
    longs = "".join(f", {v} long" for v in values)
    cut, _ = scratch.write(words.mapInArrow(_cut(shared, len(values)), f"word string, size int, gram string, k long{longs}"), "cut")
    rare = cut.filter("gram is not null").select("word", "size", "gram", "k").join(model.grams.rows, "gram")
    parts = cut.filter("gram is null").drop("gram").unionByName(rare.select("word", "size", "k", *((F.col("k") * F.col(v)).alias(v) for v in values)))
    by_size = parts.groupBy("word", "size").agg(F.sum("k").alias("k"), *(F.sum(v).alias(v) for v in values))
    best = by_size.groupBy("word").agg(F.max_by(F.struct("k", *values), "size").alias("best"))
    return best.select("word", *(F.round(F.col(f"best.{v}") / F.col("best.k")).cast("long").alias(v) for v in values))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row."""
    docs = X.columns_of(docs, id_col, text_col)
    if model is None:
        return docs.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    scratch = Scratch(docs.sparkSession, "langid")
    values = _values(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast((model.words.hot, model.words.hot_rows))
    longs = "".join(f", {v} long" for v in values)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_look_up(shared, len(values)), f"row long, id long, word string, k long{longs}")
    found, _ = scratch.write(rows, "found")
    rare = found.filter("word is not null").select("row", "word", "k")
    unmet = _unmet(rare.select("word").distinct().join(model.words.rows.select("word"), "word", "left_anti"), model, scratch)
    scored = rare.join(model.words.rows.unionByName(unmet), "word")
    parts = found.filter("word is null").drop("word").unionByName(scored.select("row", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("k"), *((F.col("k") * F.col(v)).alias(v) for v in values)))
    sums = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("k").alias("k"), *(F.sum(v).alias(v) for v in values))
    total = F.array(*(F.col(v) / UNIT + F.lit(float(p)) for v, p in zip(values, model.prior)))
    best = sums.select("id", "k", total.alias("total")).withColumn("most", F.array_max("total"))
    score = 1 / F.aggregate("total", F.lit(0.0), lambda s, t: s + F.exp(t - F.col("most")))
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", F.col("most")).cast("int"))
    return best.select(F.col("id").alias(id_col), F.when(F.col("k") > 0, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("k") > 0, score).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_out: int = 2) -> DataFrame:
    """Learns from the labelled rows whose crc32(id) mod ``parts`` is not ``held_out`` and predicts all."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return predict(docs, fit(rows.filter(crc() % parts != held_out)), id_col, text_col)
