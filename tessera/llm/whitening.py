"""Whitening of embeddings by a tall-skinny QR factorisation (TSQR).

Components c of a vector are taken as whole numbers x = floor(64 c) + 1,000,000, so their sums S over all n vectors are exact whatever the order.
Rows are centred by them (x - floor(S/n) is exact too; only the rest of the division is rounded), every task reduces its rows to one
triangular factor R by QR of blocks stacked under the R so far, and the factors are merged by QR in a tree of FAN to one. The singular
value decomposition of the last R gives the right singular vectors, which are the unit eigenvectors of the covariance, and its eigenvalues
e = s^2 / n. No covariance of the input is ever formed, so small eigenvalues keep their digits. A whitened row is the centred row
projected on a component, over sqrt(e).

What reaches the driver is the sums and one R, d and d^2 numbers for vectors of d components, whatever the number of rows. No vector is
shuffled: the table is read once for the sums, once for R, once to measure the result and once for the rows.

Edge cases
----------
* vectors that are null or hold a null or non-finite component take no part, nor do those with a component of 2^46 or more, for which x is
  not a number that a double holds; they give no rows;
* of several lengths the most frequent one counts (the smaller one among equally frequent), the others take no part; empty vectors give no component;
* null and repeated ids: each row counts and is returned for itself; extra columns are ignored, whatever their names;
* a component without variance (fewer rows than dimensions, equal rows, a single row) has eigenvalue, share and whitened values 0 and is left out of ``identity_error``;
* an empty table, or one whose rows take no part: an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

COMPONENTS = 32
#: Factors that one task merges.
FAN = 16
#: Rows of one block.
BLOCK = 4096
SCALE, SHIFT, WIDEST = 64, 1_000_000, 2.0**52


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: the number of vectors fitted, the mean as floor(S/n) and the rest of that division, eigenvectors as columns, eigenvalues."""

    n: int
    floor: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.floor)

    def centre(self, x: np.ndarray) -> np.ndarray:
        return _centre(x, self.floor, self.rest, self.n)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; 0 for a component without variance."""
        root = np.sqrt(self.values)
        return self.centre(x) @ np.divide(self.vectors, root, out=np.zeros_like(self.vectors), where=root > 0)

    def deviation(self, x: np.ndarray) -> list[int] | np.ndarray:
        """The exact sum over dimensions of (n x - S)^2, which is (n (x - floor) - rest)^2."""
        y = x - self.floor
        if len(y) and self.n * (int(np.abs(y).max()) + 1) < 2**31 // (self.dimensions + 1):
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1)
        wide = y.astype(object) * self.n - np.array(self.rest, object)
        return (wide * wide).sum(axis=1) if len(y) else np.zeros(0, np.int64)


def _centre(x: np.ndarray, floor: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    return (x - floor) - np.array([r / n for r in rest])


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole numbers of all vectors, where each vector begins, and each vector's length, -1 for those that take no part."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    base = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    values = SCALE * base.fill_null(np.nan).to_numpy(zero_copy_only=False)
    fine = np.abs(values) < WIDEST  # false for what is not finite
    wrong = np.concatenate([[0], np.cumsum(~fine)])
    begin = offsets - offsets[0]
    length = np.diff(begin)
    length[(wrong[begin[1:]] > wrong[begin[:-1]]) | column.is_null().to_numpy(zero_copy_only=False)] = -1
    return np.where(fine, np.floor(values), 0).astype(np.int64) + SHIFT, begin[:-1], length


def _rows(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length ``d`` as a matrix, and their places."""
    values, begin, length = numbers(column)
    some = np.flatnonzero(length == d)
    return values[begin[some][:, None] + np.arange(d)], some


def _sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, dimension, total) of a task's vectors; dimension -1 counts them."""
    total: dict[int, np.ndarray] = {}
    for rows in source:
        values, begin, length = numbers(rows.column("v"))
        for d in np.unique(length[length > 0]).tolist():
            some = np.flatnonzero(length == d)
            for at in range(0, len(some), BLOCK):
                x = values[begin[some[at : at + BLOCK]][:, None] + np.arange(d)]
                # The upper and lower halves of 2^26 cannot overflow within a block.
                high, low = (x >> 26).sum(axis=0).astype(object), (x & (2**26 - 1)).sum(axis=0).astype(object)
                total[d] = total.get(d, 0) + np.r_[np.array([len(x)], object), high * 2**26 + low]
    out = [(d, k - 1, s) for d, t in total.items() for k, s in enumerate(t.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.decimal128(38, 0))], names=["length", "dimension", "total"])


_NODE = "node long, data binary"


def _task(start: Callable, add: Callable):
    """One row (node, data) for a task with rows: ``add`` folds matrices of its vectors."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for rows in source:
            for at in range(0, rows.num_rows, BLOCK):
                x = start(rows.column("v").slice(at, BLOCK))
                if len(x):
                    state = add(state, x)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "data": [state.tobytes()]})

    return run


def _merge(nodes: DataFrame, width: int, join: Callable[[list[np.ndarray]], np.ndarray], scratch: Scratch) -> np.ndarray:
    """Merges matrices of ``width`` columns in a tree of FAN to one."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x).reshape(-1, width) for x in rows.sort_values("child")["data"]]
        return pd.DataFrame({"node": rows["node"].iloc[:1], "data": [join(parts).tobytes()]})

    nodes, at = scratch.write(nodes, "nodes")
    left = nodes.agg(F.max("node")).first()[0]
    while left:
        nodes = nodes.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("node").applyInPandas(merge, _NODE)
        left //= FAN
    found = np.frombuffer(nodes.first()["data"]).reshape(-1, width)
    scratch.drop(at)
    return found


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(np.linalg.qr(np.vstack(parts), mode="r"))


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors that take part; None where there is none."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    v = vectors.select(F.col(f"`{vector_col}`").alias("v"))
    sums, at = scratch.write(v.mapInArrow(_sums, "length int, dimension int, total decimal(38,0)").groupBy("length", "dimension").agg(F.sum("total").alias("total")), "sums")
    best = sums.filter("dimension = -1").orderBy(F.desc("total"), "length").first()
    if best is None:
        return None
    d, n = best["length"], int(best["total"])
    total = [int(r["total"]) for r in sums.filter(f"length = {d} and dimension >= 0").orderBy("dimension").collect()]
    scratch.drop(at)
    floor, rest = np.array([t // n for t in total], np.int64), [t % n for t in total]

    def centred(column: pa.Array) -> np.ndarray:
        return _centre(_rows(column, d)[0], floor, rest, n)

    leaves = v.mapInArrow(_task(centred, lambda r, x: _triangle([x] if r is None else [r, x])), _NODE)
    r = _merge(leaves, d, _triangle, scratch)
    _, s, vt = np.linalg.svd(r)
    s = np.r_[s, np.zeros(d - len(s))]
    s[s <= s[0] * d * np.finfo(float).eps] = 0
    vt *= np.sign(vt[np.arange(d), np.abs(vt).argmax(axis=1)])[:, None]
    k = min(components, d)
    return Whitening(n, floor, rest, np.ascontiguousarray(vt[:k].T), s[:k] ** 2 / n, float((s**2).sum() / n))


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components that have variance."""
    some = np.flatnonzero(model.values > 0)
    k, d = len(some), model.dimensions
    if not k:
        return 0.0

    def moments(column: pa.Array) -> np.ndarray:
        return model.apply(_rows(column, d)[0])[:, some]

    def add(state: np.ndarray | None, y: np.ndarray) -> np.ndarray:
        new = np.vstack([y.T @ y, y.sum(axis=0)])
        return new if state is None else state + new

    nodes = vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(_task(moments, add), _NODE)
    found = _merge(nodes, k, lambda parts: np.sum(parts, axis=0), Scratch(vectors.sparkSession, "identity")) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, deviation, whitened) of every vector that takes part: the exact sum of (n x - S)^2 over dimensions, and one double for each component."""
    d = model.dimensions

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                x, some = _rows(part.column("v"), d)
                y = model.apply(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(some)), pa.array(list(map(int, model.deviation(x))), pa.decimal128(38, 0)), lists], names=["id", "deviation", "whitened"])

    found = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return found.mapInArrow(run, "id long, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): fits all vectors and whitens them, a row for each vector and component."""
    spark = vectors.sparkSession
    model = fit(vectors, components, vector_col)
    kind = f"`{id_col}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], kind)
    error = identity_error(vectors, model, vector_col)
    share = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values))
    rows = whiten(vectors, model, id_col, vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
