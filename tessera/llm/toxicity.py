"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are learned from document labels.

A sentence has probability sigmoid(bias + sum of the weights of its features); its features are its words and their
first 4 and 5 bytes (of shorter words, all), so inflected forms of a known stem count. A document's probability is
1 - prod(1 - p(sentence)): one offending sentence is enough, and the gradient of the document's likelihood falls on the
sentences that explain it. Scoring gives the document's probability and locates the sentences.

Features are chosen, and weights fitted, on at most ``MAX_ROWS`` labelled rows of ``MAX_BYTES`` in all (documented bounds). Which of
the ``GRID`` of settings is used (with or without prefixes, how much evidence a feature needs, the penalty of weights) is decided by
folds of these teachable rows alone: the setting of the least log-loss on the folds left out, the first among equals.

Edge cases
----------
* null or empty text, or no word: no sentence; the score is 0;
* a whole text is scored, whatever its length;
* repeated rows are scored each; extra columns are ignored; rows with a null id are scored and teach nothing;
* no label of either kind to learn from: every score is the share of positive labels, 0 without labels;
* empty documents: empty result; ``keep_clean`` keeps every row of a score below the threshold, also null texts, null ids and repeated
  rows, with all its columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .labelled import training_rows
from .scratch import Scratch

#: Labelled rows used for fitting, and bytes of their texts, at most.
MAX_ROWS = 30_000
MAX_BYTES = 256 << 20
#: Features of a model, at most: those that tell the labels apart best.
MAX_FEATURES = 20_000
PREFIXES = (4, 5)
FOLDS = 3
#: Settings to choose from: whether prefixes are features besides words; the least evidence for a feature, n ln(share / usual share) for n
#: documents of label 1 that have it (chance gives some 12 to the best of a few hundred thousand words); the strength of the penalty.
GRID = [(prefixes, evidence, strength) for prefixes in (False, True) for evidence in (48.0, 24.0, 12.0) for strength in (1600.0, 400.0, 100.0, 25.0)]
#: Least log odds of a feature.
LEAST_ODDS = 0.7
#: Largest weight to begin with.
START = 2.0
#: A sentence is reported when its own probability reaches this.
OFFENDING = 0.5
_BREAK = W.separator_table(b".!?\n")


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    base: float  # for a model without features
    setting: tuple | None = None

    def __post_init__(self):
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.features >> np.uint64(44)).astype(np.int64)] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, W.Words]:
    """Features of all words: hashes and the words they belong to (first all words, then prefixes), and the words."""
    w = W.split(data, offsets, W.ALNUM, True)
    hashes, word = [W.mix(w.values())], [np.arange(len(w.start))]
    for n in PREFIXES:
        size = np.minimum(w.end - w.start, n)
        hashes.append(W.mix(w.lane(w.start, size) | np.uint64((n << 3) + 7 << 56)))
        word.append(np.arange(len(w.start)))
    return np.concatenate(hashes), np.concatenate(word), w


def _sentences(w: W.Words, offsets: np.ndarray) -> np.ndarray:
    """A sentence number for each word; a text's words share none with another text."""
    ends = np.cumsum(_BREAK[w.data])
    texts = np.repeat(np.arange(len(offsets) - 1), w.counts())
    return ends[w.start] + texts if len(w.start) else np.zeros(0, np.int64)


def fold_of(column: str = "id"):
    """The fold of a teachable row, by a hash of its id."""
    return F.pmod(F.xxhash64(column), F.lit(FOLDS)).cast("int")


def _counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, prefix, fold, positive, negative): in how many documents of either label."""
    for rows in source:
        data, offsets = W.buffers(rows.column("text"))
        label = rows.column("label").to_numpy(zero_copy_only=False).astype(bool)
        fold = rows.column("fold").to_numpy(zero_copy_only=False)
        for at, to in W.chunks(offsets):
            hashes, word, w = _features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            text = np.repeat(np.arange(to - at), w.counts())[word]
            pairs = pd.DataFrame({"h": hashes, "t": text, "prefix": np.arange(len(hashes)) >= len(w.start)}).drop_duplicates(["h", "t"])
            text = pairs["t"].to_numpy()
            positive = label[at:to][text].astype(np.int64)
            found = pd.DataFrame({"feature": pairs["h"].to_numpy().view(np.int64), "prefix": pairs["prefix"], "fold": fold[at:to][text], "positive": positive, "negative": 1 - positive})
            yield pa.RecordBatch.from_pandas(found.groupby(["feature", "prefix", "fold"], as_index=False).sum(), preserve_index=False)
    W.release()


def _active(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are features of the model, and their numbers."""
    maybe = np.flatnonzero(model.filter[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(model.features, hashes[maybe])
    at[at == len(model.features)] = 0
    hit = model.features[at] == hashes[maybe]
    return maybe[hit], at[hit]


def _bags(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Distinct (sentence, feature) pairs and the text of each sentence that has words."""
    hashes, word, w = _features(data, offsets)
    sentence = _sentences(w, offsets)
    number, first = np.unique(sentence, return_index=True)
    text = np.repeat(np.arange(len(offsets) - 1), w.counts())[first] if len(first) else np.zeros(0, np.int64)
    index, feature = _active(model, hashes)
    where = np.searchsorted(number, sentence[word[index]])
    pairs = np.unique(where * np.int64(len(model.features) + 1) + feature) if len(index) else np.zeros(0, np.int64)
    return pairs // (len(model.features) + 1), pairs % (len(model.features) + 1), text, w, first


def _training_bags(model: Model):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            out = []
            for at, to in W.chunks(offsets):
                sentence, feature, text, _, _ = _bags(model, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                owner = text[sentence]
                total = np.bincount(text, minlength=to - at)
                for k in range(to - at):
                    mine = slice(*np.searchsorted(owner, [k, k + 1]))
                    out.append((sentence[mine].astype(np.int32).tobytes(), feature[mine].astype(np.int32).tobytes(), int(total[k])))
            if out:
                s, f, n = zip(*out)
                yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), rows.column("fold"), pa.array(n, pa.int32()), pa.array(s, pa.binary()), pa.array(f, pa.binary())], names=["label", "fold", "n", "sentence", "feature"])

    return run


@dataclass
class Bags:
    """Documents as bags of sentences, sentences as sets of features: a label and a number of sentences for each document, and one entry (document, sentence,
    feature) for each feature, in this order."""

    label: np.ndarray
    n: np.ndarray
    document: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Bags:
        size = [len(f) // 4 for f in rows["feature"]]
        sentence, feature = (np.frombuffer(b"".join(rows[c]), np.int32) for c in ("sentence", "feature"))
        return cls(rows["label"].to_numpy().astype(float), rows["n"].to_numpy().astype(np.int64), np.repeat(np.arange(len(rows), dtype=np.int32), size), sentence, feature)

    def part(self, documents: np.ndarray, features: np.ndarray) -> Bags:
        """Only these documents (a mask) and features (numbered anew)."""
        number = np.full(int(max(self.feature.max(initial=-1), features.max(initial=-1))) + 2, -1, np.int32)
        number[features] = np.arange(len(features))
        keep = documents[self.document] & (number[self.feature] >= 0)
        return Bags(self.label[documents], self.n[documents], (np.cumsum(documents, dtype=np.int32) - 1)[self.document[keep]], self.sentence[keep], number[self.feature[keep]])

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences with a feature: the one of each entry, and the document of each; and the documents' numbers of other sentences."""
        begin = np.flatnonzero(np.r_[True, (np.diff(self.document) != 0) | (np.diff(self.sentence) != 0)]) if len(self.document) else np.zeros(0, np.int64)
        owner = self.document[begin]
        return np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(self.document)])), owner, self.n - np.bincount(owner, minlength=len(self.n))


def noisy_or(bags: Bags, start: np.ndarray, strength: float = 400.0, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the document labels, less ``strength`` / (2 n) |w|^2 for n documents (Adam, full batch)."""
    n = len(bags.label)
    bag, owner, plain = bags.sentences()  # plain: sentences without a feature have the bias alone
    w = np.r_[start, np.log(1e-4)]
    penalty = min(0.5, strength / max(1, n))  # words that few documents support count for less where there are few documents
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(bag, weights=w[bags.feature], minlength=len(owner))
        p, q = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        clean = np.bincount(owner, weights=np.logaddexp(0, z), minlength=n) + plain * np.logaddexp(0, w[-1])  # -log P(label 0)
        # d(-log likelihood)/d(clean): 1 for label 0, -1/(e^clean - 1) for label 1; d(clean)/dz = p.
        slope = np.where(bags.label > 0, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0)
        each = slope[owner] * p
        grad = np.r_[np.bincount(bags.feature, weights=each[bag], minlength=len(start)) + penalty * w[:-1], each.sum() + (slope * plain).sum() * q]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def log_loss(bags: Bags, weights: np.ndarray, bias: float) -> float:
    bag, owner, plain = bags.sentences()
    z = bias + np.bincount(bag, weights=weights[bags.feature], minlength=len(owner))
    clean = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(bags.n)) + plain * np.logaddexp(0, bias)
    return float(np.where(bags.label > 0, -np.log(np.maximum(-np.expm1(-clean), 1e-12)), clean).sum())


def choose(features: pd.DataFrame, positive: np.ndarray, negative: np.ndarray, totals: tuple[int, int], prefixes: bool, evidence: float, most: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features that a setting takes, given in how many documents of each label they are, and their log odds."""
    odds = np.log((positive + 0.5) / (totals[0] + 1)) - np.log((negative + 0.5) / (totals[1] + 1))
    share = positive / np.maximum(positive + negative, 1) / (totals[0] / sum(totals))
    weight = np.log(np.maximum(share, 1e-12)) * positive
    found = np.flatnonzero((weight >= evidence) & (odds > LEAST_ODDS) & (prefixes | ~features["prefix"].to_numpy()))
    found = np.sort(found[np.lexsort((features["feature"].to_numpy()[found], -weight[found]))][:most])
    return found, odds[found]


def _judge(shared):
    """(setting, loss): the log-loss on one fold of a model of the others, for each row (setting, fold)."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, bags, folds, settings = shared.value
        for rows in source:
            out = []
            for setting, fold in zip(rows["setting"], rows["fold"]):
                prefixes, evidence, strength = settings[setting]
                held = folds == fold
                totals = (int((bags.label[~held] > 0).sum()), int((bags.label[~held] == 0).sum()))
                if not min(totals) or not held.any():
                    continue
                counts = (features[name].sum(axis=1).to_numpy() - features[name][fold].to_numpy() for name in ("positive", "negative"))
                found, odds = choose(features["of"], *counts, totals, prefixes, evidence)
                weights, bias = noisy_or(bags.part(~held, found), np.clip(odds, 0, START), strength)
                out.append((setting, log_loss(bags.part(held, found), weights, bias)))
            yield pd.DataFrame(out, columns=["setting", "loss"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES, grid: list[tuple[bool, float, float]] | None = None) -> Model:
    """Fits on labelled rows outside the held-out part, with the setting of ``grid`` that folds of these rows favour. ``docs`` has columns id, text."""
    spark, grid = docs.sparkSession, grid or GRID
    scratch = Scratch(spark, "toxicity")
    rows = training_rows(docs, labels, label_col, parts, held_out, max_rows, scratch, max_bytes=max_bytes).withColumn("fold", fold_of())
    per_label = {(r["fold"], r["label"] > 0): r["n"] for r in rows.groupBy("fold", (F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    totals = [[per_label.get((k, which), 0) for k in range(FOLDS)] for which in (True, False)]
    positive, negative = map(sum, totals)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, positive / max(1, positive + negative))
    if not positive or not negative:
        return none
    counted = rows.select("text", "label", "fold").mapInArrow(_counts, "feature long, prefix boolean, fold int, positive long, negative long")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("positive", "negative") for k in range(FOLDS)]
    counted = counted.groupBy("feature", "prefix").agg(*by_fold)
    # Only features that some setting takes, in all rows or in those outside a fold.
    least, taken = min(evidence for _, evidence, _ in grid), []
    for left in (None, *range(FOLDS)):
        p, n = (sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != left), F.lit(0)) for c in ("positive", "negative"))
        all_p, all_n = (sum(t) - (0 if left is None else t[left]) for t in totals)
        if all_p and all_n:
            odds = F.log((p + 0.5) / (all_p + 1.0)) - F.log((n + 0.5) / (all_n + 1.0))
            evidence = F.log(F.greatest(p / F.greatest(p + n, F.lit(1)) / (all_p / (all_p + all_n)), F.lit(1e-12))) * p
            taken.append(F.when(odds > LEAST_ODDS, evidence).otherwise(0.0))
    counted = counted.withColumn("evidence", F.greatest(F.lit(0.0), *taken)).filter(F.col("evidence") >= least * (1 - 1e-9))
    counted = counted.orderBy(F.desc("evidence"), "feature").limit(2 * max_features).toPandas()
    if not len(counted):
        return none
    counted = counted.assign(feature=counted["feature"].to_numpy().view(np.uint64)).sort_values("feature", ignore_index=True)
    model = Model(counted["feature"].to_numpy(), np.zeros(len(counted)), 0.0, none.base)
    found = rows.select("label", "fold", "text").mapInArrow(_training_bags(model), "label int, fold int, n int, sentence binary, feature binary").toPandas()
    bags, folds = Bags.of(found), found["fold"].to_numpy()
    del found
    per_fold = {c: counted[[f"{c}{k}" for k in range(FOLDS)]].set_axis(range(FOLDS), axis=1) for c in ("positive", "negative")}
    best = 0
    if len(grid) > 1:
        shared = spark.sparkContext.broadcast((per_fold | {"of": counted[["feature", "prefix"]]}, bags, folds, grid))
        tasks = spark.range(len(grid) * FOLDS).select((F.col("id") % len(grid)).cast("int").alias("setting"), F.floor(F.col("id") / len(grid)).cast("int").alias("fold"))
        losses = tasks.repartition(len(grid) * FOLDS, "setting", "fold").mapInPandas(_judge(shared), "setting int, loss double").groupBy("setting").agg(F.sum("loss").alias("loss"), F.count("*").alias("n")).collect()
        best = min(losses, key=lambda r: (-r["n"], r["loss"], r["setting"]))["setting"] if losses else 0
    prefixes, evidence, strength = grid[best]
    taken, odds = choose(counted, *(per_fold[c].sum(axis=1).to_numpy() for c in ("positive", "negative")), (positive, negative), prefixes, evidence, max_features)
    if not len(taken):
        return none
    weights, bias = noisy_or(bags.part(np.ones(len(bags.n), bool), taken), np.clip(odds, 0, START), strength)
    used = np.abs(weights) > 0.05
    return Model(model.features[taken][used], weights[used], bias, none.base, grid[best])


def _score(model: Model):
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            scores, located = [], []
            for at, to in W.chunks(offsets):
                base = offsets[at : to + 1] - offsets[at]
                part = data[offsets[at] : offsets[to]]
                if not len(model.features):
                    empty = W.split(part, base, W.ALNUM, True).counts() == 0
                    scores.extend(np.where(empty, 0.0, model.base).tolist())
                    located.extend([] for _ in range(to - at))
                    continue
                sentence, feature, text, w, first = _bags(model, part, base)
                z = model.bias + np.bincount(sentence, weights=model.weights[feature], minlength=len(text))
                clean = np.bincount(text, weights=np.logaddexp(0, z), minlength=to - at)
                scores.extend((-np.expm1(-clean)).tolist())
                found: list[list] = [[] for _ in range(to - at)]
                begin = np.searchsorted(text, np.arange(to - at))
                last = np.r_[first[1:], len(w.start)] - 1
                for s in np.flatnonzero(z >= np.log(OFFENDING / (1 - OFFENDING))).tolist():
                    k = int(text[s])
                    found[k].append({"sentence": s - int(begin[k]), "score": float(1 / (1 + np.exp(-z[s]))), "text": part[w.start[first[s]] : w.end[last[s]]].tobytes().decode()})
                located.extend(found)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(scores, pa.float64()), pa.array(located, kind)], names=["id", "score", "offending"])
        W.release()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, offending): the document's probability and its sentences of probability >= OFFENDING. ``docs`` has columns id, text."""
    return docs.select("id", "text").mapInArrow(_score(model), "id long, score double, offending array<struct<sentence:int,score:double,text:string>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """(id_col, score, predicted, offending) for every row; learns from ``labels`` first."""
    docs = X.columns_of(docs, id_col, text_col)
    out = score(docs, fit(docs, labels, **options))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``."""
    model = fit(X.columns_of(docs, id_col, text_col), labels, **options)
    scores = _score(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            only = pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows), rows.column(text_col)], names=["id", "text"])
            for scored in scores(iter([only])):  # one for one
                yield rows.filter(pa.array(scored.column("score").to_numpy() < threshold))

    return docs.mapInArrow(run, docs.schema)
