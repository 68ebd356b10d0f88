"""An exact index for cosine top-k: an inverted file of cells, pruned by the triangle inequality.

Unit vectors lie in the cell of the nearest centroid; a cell is a folder of the table. For a query q, a cell of centroid c and radius r holds nothing nearer than
|q - c| - r, so once k rows are known, cells beyond the k-th distance cannot hold a better one and their files are not read. The centroids are fitted on a
bounded sample; they decide how much is read, never what is found. New vectors are appended to the cells: their radii are written first, and a radius that is
larger than need be does no harm, so a stop in between leaves a right index.

Rows without a direction (null, zero, of other lengths, without a finite norm) have a cell of their own that is always read.
The driver holds centroids and radii: CELLS rows at most, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import TOP_K, norm, top_k

CELLS, SAMPLE, ROUNDS, SEED = 4096, 20_000, 8, 7
#: Cells that are read first.
FIRST = 2
#: For rounding of distances.
SLACK = 1e-7
_CELL, _FAR, _APART = "_cell", "_far", -1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector_col: str, d: int) -> Column:
    size = norm(F.col(vector_col))
    return F.coalesce((F.size(vector_col) == d) & (size > 0) & (size < float("inf")), F.lit(False))


def fit_centroids(vectors: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Unit centroids of a sample of SAMPLE rows in the order of a hash of their id, by a few rounds of k-means; none if no row has a direction."""
    lengths = vectors.filter(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return np.zeros((0, 0))
    some = vectors.filter(_usable(vector_col, lengths["d"])).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(F.col(vector_col).cast("array<double>").alias("v")).toPandas()["v"]
    if not len(some):
        return np.zeros((0, 0))
    x = _unit(np.stack(some.to_numpy()))
    cells = min(cells or max(1, int(np.sqrt(lengths["count"]))), CELLS, len(x))
    c = x[np.random.default_rng(SEED).choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where((size > 1e-12)[:, None], sums / np.maximum(size, 1e-12)[:, None], c)
    return c


class VectorIndex:
    """The index under a folder."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector_col = spark, path.rstrip("/"), id_col, vector_col

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        out = cls(vectors.sparkSession, path, id_col, vector_col)
        centroids = fit_centroids(vectors, cells, id_col, vector_col)
        out.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{out.path}/centroids")
        out.append(vectors)
        return out

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows])

    def append(self, vectors: DataFrame) -> None:
        """Rows enter the cells of their nearest centroids. Their radii are written first."""
        placed = self._placed(vectors)
        placed.groupBy(_CELL).agg(F.max(_FAR).alias("radius")).coalesce(1).write.mode("append").parquet(f"{self.path}/radii")
        # A large cell is written by several tasks, small ones share one.
        placed.drop(_FAR).hint("rebalance", F.col(_CELL)).write.mode("append").partitionBy(_CELL).parquet(f"{self.path}/cells")

    def _placed(self, vectors: DataFrame) -> DataFrame:
        c = self.centroids()
        if not len(c):
            return vectors.withColumns({_CELL: F.lit(_APART), _FAR: F.lit(0.0)})

        @F.pandas_udf(f"{_CELL} int, {_FAR} double")
        def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in parts:
                cell, far = np.full(len(part), _APART, np.int32), np.zeros(len(part))
                some = np.flatnonzero(part.notna().to_numpy())
                for at in range(0, len(some), 4096):
                    rows = some[at : at + 4096]
                    x = _unit(np.stack(part.iloc[rows].to_numpy()))
                    near = (x @ c.T).argmax(axis=1)
                    cell[rows], far[rows] = near, np.linalg.norm(x - c[near], axis=1)
                yield pd.DataFrame({_CELL: cell, _FAR: far})

        usable = F.when(_usable(self.vector_col, c.shape[1]), F.col(self.vector_col).cast("array<double>"))
        return vectors.withColumn("_at", nearest(usable)).select(*vectors.columns, f"_at.{_CELL}", f"_at.{_FAR}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def cells_within(self, query: list[float], distance: float) -> list[int]:
        """The cells that may hold a row at most so far from the query's direction."""
        c, q = self.centroids(), np.array(query, float)
        radii = {r[_CELL]: r["radius"] for r in self.spark.read.parquet(f"{self.path}/radii").groupBy(_CELL).agg(F.max("radius").alias("radius")).collect()}
        if not len(c) or not 0 < np.linalg.norm(q) < np.inf or len(q) != c.shape[1]:
            return sorted(radii)
        away = np.linalg.norm(c - q / np.linalg.norm(q), axis=1)
        if distance == 0:  # the nearest of those that have rows
            return [_APART, *sorted((k for k in radii if k != _APART), key=lambda k: away[k])[:FIRST]]
        return [k for k in sorted(radii) if k == _APART or away[k] - radii[k] <= distance + SLACK]

    def search(self, query: list[float], k: int = TOP_K, where: Column | None = None) -> DataFrame:
        """The rows of ``vector.top_k`` over the whole table, reading only the cells that may hold them."""
        ask = lambda cells: top_k(self.rows().filter(F.col(_CELL).isin(cells)), query, k, where, self.id_col, self.vector_col).drop(_CELL)
        first = ask(self.cells_within(query, 0)).select("similarity").collect()
        reached = min((r[0] for r in first if r[0] is not None), default=None)
        known = len(first) == k and all(r[0] is not None for r in first)
        # A similarity s of unit vectors is a distance of sqrt(2 - 2 s); without k rows none can be left out.
        return ask(self.cells_within(query, float(np.sqrt(max(0.0, 2 - 2 * reached))) if known else float("inf")))
