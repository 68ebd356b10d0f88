"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

A vector o is taken as its direction u = o/|o|, rotated by a random orthogonal matrix P and kept as the signs of P u, one bit
for each dimension, with two correction scalars: |o| and c = <x, P u>, where x = signs / sqrt(D) is the unit vector that the bits
stand for. For a query q the estimate of <q, o> is |o| <P q, x> / c, and with high probability it is off by no more
than |o| |q| EPSILON sqrt(1 - c^2) / (c sqrt(D - 1)).

<P q, x> comes from packed bits: P q is rounded at random to QUERY_BITS levels, whose bit planes are ANDed with the code and counted. A
block's best candidates by estimate are scored exactly first; the k-th of these scores is what the others have to reach, and all
whose upper bound does are reranked by their exact inner product in double precision. The others are among the k
nearest only with the small probability that the bound leaves.

Queries and vectors are dealt in blocks; every block of queries meets every block of vectors in one task and
gives at most k rows for a query, which meet per query. All vectors are indexed and searched.

Edge cases
----------
* null or zero vectors, and those with a null or non-finite component, take no part; nor do vectors of another length than the
  most frequent one (the smaller length among equally frequent);
* null ids take no part; rows that repeat an id are candidates of their own, but never for a query of the same id;
* ties in the score go to the smaller id; fewer than k candidates: all of them; no query: empty result; extra columns are ignored;
* components so large that squares overflow: the estimate says nothing then, and such a vector is scored exactly.

A vector is coded once. Blocks are sorted, and the rounding of a query is drawn from its id, so a repeated task gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.5
QUERY_BITS = 6
#: Times k candidates are scored exactly to begin with.
FIRST = 4
#: Queries and vectors of one block, and bytes of its vectors in double precision, at most. Where there are more pairs of blocks than TASKS for each
#: core, up to GATHERED blocks of queries become one, so that vectors are sent less often; which vectors meet in a block stays the same.
QUERY_BLOCK = 1024
GATHERED, TASKS = 16, 4
VECTOR_BLOCK = 16_384
BLOCK_BYTES = 64 << 20
SEED = 17


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    n, d = bits.shape
    words = -(-d // 64)
    padded = np.zeros((n, words * 64), bool)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


@dataclass
class Codes:
    """One-bit codes of the rows of a matrix and their correction scalars."""

    code: np.ndarray  # packed bits, a row for each vector
    norm: np.ndarray
    c: np.ndarray
    dimension: int

    def __post_init__(self):
        self.words = np.ascontiguousarray(self.code.T)
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        with np.errstate(all="ignore"):
            self.scale = self.norm / (np.sqrt(self.dimension) * self.c)
            self.spread = np.sqrt(np.maximum(1 - self.c**2, 0)) / (self.c * np.sqrt(max(self.dimension - 1, 1)))

    @classmethod
    def of(cls, vectors: np.ndarray, p: np.ndarray) -> Codes:
        most = np.abs(vectors).max(axis=1, keepdims=True)  # squares of scaled components stay in range
        scaled = np.linalg.norm(vectors / most, axis=1)
        turned = (vectors / most / scaled[:, None]) @ p.T
        with np.errstate(over="ignore"):
            return cls(_pack(turned > 0), most[:, 0] * scaled, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1]), vectors.shape[1])

    def bounds(self, query: np.ndarray, p: np.ndarray, random: np.random.Generator, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with ``query`` and how far off they may be, in ``epsilon`` standard deviations."""
        d = len(query)
        turned = p @ query
        low, levels = turned.min(), (1 << QUERY_BITS) - 1
        step = max((turned.max() - low) / levels, 1e-300)
        level = np.clip(np.floor((turned - low) / step + random.random(d)), 0, levels).astype(np.int64)
        planes = _pack((level >> np.arange(QUERY_BITS)[:, None] & 1).astype(bool))
        dot = np.zeros(len(self.code), np.int32)
        for b in range(QUERY_BITS):
            for word, bits in zip(self.words, planes[b]):
                dot += np.bitwise_count(word & bits).astype(np.int32) << b
        # signs = 2 bits - 1: <signs, low + step level> = 2 (low ones + step dot) - (d low + step sum(level))
        signed = 2 * (low * self.ones + step * dot) - (d * low + step * level.sum())
        rounding = step / (2 * self.c)  # of the query's levels
        return self.scale * signed, self.norm * epsilon * (np.linalg.norm(query) * self.spread + rounding)


def _close_to_best(vectors: np.ndarray, norm: np.ndarray, query: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """The numbers of those that may be among the k best by inner product: a matrix product rounds otherwise than the final score does."""
    if len(number) <= k:
        return number
    with np.errstate(all="ignore"):
        score = vectors @ query
        slack = 1e-15 * len(query) * norm.max() * np.linalg.norm(query)
        return number[~(score < np.partition(score, len(score) - k)[len(score) - k] - slack)]


def search_block(qid: np.ndarray, queries: np.ndarray, vid: np.ndarray, vectors: np.ndarray, codes: Codes, p: np.ndarray, k: int, seed: int = SEED, epsilon: float = EPSILON) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of each query's nearest in this block, nearest first."""
    for i, q in zip(qid.tolist(), queries):
        estimate, error = codes.bounds(q, p, np.random.default_rng([seed, i % (1 << 64)]), epsilon)
        other = np.flatnonzero(vid != i)
        if len(other) > FIRST * k:
            # The best by estimate set a score to reach; whoever's upper bound falls short of it stays out.
            estimate = np.nan_to_num(estimate, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            first = other[np.argpartition(-estimate[other], FIRST * k)[: FIRST * k]]
            reach = np.partition((vectors[first] * q).sum(axis=1), FIRST * k - k)[FIRST * k - k]
            other = other[~(estimate[other] + error[other] < reach)]  # what cannot be told stays
        some = _close_to_best(vectors[other], codes.norm[other], q, other, k)
        score = (vectors[some] * q).sum(axis=1)  # row by row in one order, so that equal vectors tie
        best = np.lexsort((vid[some], -score))[:k]
        yield i, vid[some][best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of ``vectors`` for every row of ``queries``. A wider ``epsilon`` finds more of them and reranks more
    vectors; with an infinite one all are reranked and the result is exact."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        kind = df.select(v).schema[0].dataType.elementType.typeName()
        v = v if kind in ("float", "double") else v.cast("array<double>")
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.filter(fine & F.exists("v", lambda x: x != 0))

    rows, asked = clean(vectors), clean(queries)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    d = lengths["d"]

    most = max(1, BLOCK_BYTES // (8 * d))

    def blocks(df: DataFrame, size: int, name: str, enough: int | None = None) -> tuple[DataFrame, int]:
        """Rows gathered to blocks of about ``size``, dealt by a hash of their number, so that one id may be on any number of rows; to larger ones
        where ``enough`` of them remain."""
        df, _ = scratch.write(df.filter(F.size("v") == d).withColumn("row", F.monotonically_increasing_id()), name)
        count = df.count()
        n = max(1, -(-count // size))
        if enough is not None:
            n = min(n, max(enough, -(-count // max(size, min(GATHERED * size, most)))))
        df = df.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(f"{name}_block")).agg(F.sort_array(F.collect_list(F.struct("id", "row", "v"))).alias("s"))
        return df.select(f"{name}_block", F.col("s.id").alias(f"{name}_ids"), F.flatten("s.v").alias(f"{name}_rows")), n

    def matrix(part: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return part.column(name)[i].values.to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)

    def code(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = rotation(d)
        for part in source:
            for i in range(part.num_rows):
                found = Codes.of(matrix(part, "v_rows", i), p)
                given = {name: part.column(name)[i : i + 1] for name in part.schema.names}
                yield pa.RecordBatch.from_pydict({**given, "code": [found.code.tobytes()], "norm": [found.norm.tobytes()], "c": [found.c.tobytes()]})

    rows, v_blocks = blocks(rows, min(vector_block, most), "v")
    asked, q_blocks = blocks(asked, query_block, "q", -(-TASKS * spark.sparkContext.defaultParallelism // v_blocks))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows, _ = scratch.write(rows.mapInArrow(code, f"{kinds}, code binary, norm binary, c binary"), "coded")
    # Every block of queries meets every block of vectors in a task of their own: the query set against all rows, in blocks.
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("v_block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = rotation(d)
        for part in source:
            for i in range(part.num_rows):
                qid, vid = (part.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("q_ids", "v_ids"))
                code, norm, c = (np.frombuffer(part.column(x)[i].as_py(), kind) for x, kind in (("code", np.uint64), ("norm", np.float64), ("c", np.float64)))
                codes = Codes(code.reshape(len(vid), -1), norm, c, d)
                found = list(search_block(qid, matrix(part, "q_rows", i), vid, matrix(part, "v_rows", i), codes, p, k, epsilon=epsilon))
                times = [len(x[1]) for x in found]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat([x[0] for x in found], times).astype(np.int64), "vec": np.concatenate([x[1] for x in found]), "score": np.concatenate([x[2] for x in found])})

    # Blocks look small by the files that they were written to, and a copy for each block of the other side does not: without the hint, all queries
    # times the blocks of vectors may pass through the driver.
    met = rows.join(asked.hint("merge"), ["q_block", "v_block"]).select("q_ids", "q_rows", "v_ids", "v_rows", "code", "norm", "c").mapInArrow(search, "query_id long, vec long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec").alias(id_col), "score")
