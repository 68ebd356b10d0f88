"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a row of numbers (``FEATURES``). Each feature is cut into bins; boosting goes over the features in turn, again
and again, and each time fits a shallow tree to the gradient of the log-likelihood in this one feature's bins and adds a small part of
it to the feature's lookup table. Then the pairs of features whose joint tree gains most get tables of their own in the same way.
The score is sigmoid(intercept + one table entry for each feature and pair): bin numbers, lookups and additions of
whole columns.

Fitted on at most ``MAX_ROWS`` labelled rows (a documented bound); features are taken from whole texts.

Edge cases
----------
* null or empty text: a row of zeros, scored like any other; the score lies in (0, 1);
* repeated rows and null ids are scored each; extra columns are ignored;
* labels of one kind only, or none: every score is their smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .labelled import training_rows
from .scratch import Scratch

MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
CYCLES = 120
PAIR_CYCLES = 60
RATE = 0.15
#: Least second-order weight of a leaf.
LEAF = 3.0
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "word_spread", "upper", "lower", "digit", "space", "line", "beyond_ascii", "sentence_marks", "commas", "other_marks",
    "symbols", "bars", "byte_entropy", "distinct_words", "top_word", "same_as_before", "distinct_triples", "words_a_line", "long_words",
]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58))), _class(b" \t\r\x0b\x0c"), _class(b"\n"), _class(bytes(range(128, 256))),
    _class(b".!?"), _class(b",;:"), _class(b"'\"()[]-"), _class(b"#$%&*@^~_=+<>{}\\/"), _class(b"|"),
]).T


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = []
    for at, to in W.chunks(offsets):
        base, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        w = W.split(base, own, W.SPACE, True)
        length = (w.end - w.start).astype(float)
        values, triples = w.values(), W.windows(w, 3)
        for k in range(to - at):
            raw = base[own[k] : own[k + 1]]
            a, b = int(w.doc[k]), int(w.doc[k + 1])
            if b == a:
                out.append(np.zeros(len(FEATURES)))
                continue
            histogram = np.bincount(raw, minlength=256)
            share = histogram[histogram > 0] / len(raw)
            h, size = values[a:b], length[a:b]
            counts = np.unique(h, return_counts=True)[1]
            n, lines = b - a, histogram[10] + 1
            distinct = len(np.unique(triples[a : b - 2])) / (n - 2) if n > 2 else 1.0
            out.append(np.r_[
                np.log1p(len(raw)), np.log1p(n), size.mean(), size.std(), histogram @ _CLASSES / len(raw),
                -(share * np.log2(share)).sum(), len(counts) / n, counts.max() / n, (h[1:] == h[:-1]).mean() if n > 1 else 0.0, distinct, np.log1p(n / lines), (size > 15).mean(),
            ])
    return np.array(out).reshape(-1, len(FEATURES))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        rough = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for j in {i for pair in self.pairs for i in pair}}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-z))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: its gain and the first bin of the right side (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    fine = (hl >= LEAF) & (hr >= LEAF)
    if not fine.any():
        return 0.0, 0
    gain = np.where(fine, gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf) - g.sum() ** 2 / (h.sum() + 1)
    cut = int(gain.argmax())
    return float(gain[cut]), cut + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree over the bins of one feature, as the value of each bin."""
    gain, cut = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.r_[_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut of one feature, then a cut of the other on either side: the gain and the value of each cell."""
    best = (0.0, np.full(g.shape, 0.0))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            value, gain = np.empty(a.shape), 0.0
            for part in (slice(None, cut), slice(cut, None)):
                ga, ha = a[part].sum(axis=0), b[part].sum(axis=0)
                won, at = _split(ga, ha)
                gain += won + ga.sum() ** 2 / (ha.sum() + 1)
                for side in (slice(None, at), slice(at, None)) if at else (slice(None),):
                    value[part, side] = -ga[side].sum() / (ha[side].sum() + 1)
            gain -= g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0]:
                best = (gain, value.T if turn else value)
    return best


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the tables of features, then of the chosen pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model

    def cut(column: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))

    d = x.shape[1]
    model.edges = [cut(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(CYCLES):
        for j in range(d):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            z += step[bins[j]]
    model.coarse = [cut(x[:, j], PAIR_BINS) for j in range(d)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = shape(i, j)
        return np.bincount(rough[i] * b + rough[j], v, a * b).reshape(a, b)

    g, h = slopes()
    gains = [(_pair_tree(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(d) for j in range(i)]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(PAIR_CYCLES):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(cells(i, j, g), cells(i, j, h))[1]
            model.pair_tables[k] += step
            z += step[rough[i], rough[j]]
    return model


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in source:
        x = features(*W.buffers(rows.column("text")))
        yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS) -> Model:
    """Fits on labelled rows outside the held-out part. ``docs`` has columns id, text."""
    rows = training_rows(docs, labels, label_col, parts, held_out, max_rows, Scratch(docs.sparkSession, "quality"))
    found: pd.DataFrame = rows.mapInArrow(_rows, "label int, x binary").toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the same model whatever the order of the rows
    return boost(x[order], found["label"].to_numpy()[order].astype(float))


def _score(model: Model):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(model.score(features(*W.buffers(rows.column("text")))), pa.float64())], names=["id", "score"])
        W.release()

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """(id_col, score, predicted) for every row; learns from ``labels`` first."""
    docs = X.columns_of(docs, id_col, text_col)
    out = docs.mapInArrow(_score(fit(docs, labels, **options)), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
