"""Exact vector retrieval: cosine similarity in double precision, filters, floors and batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .vector_blocks import nearest_in_block

TOP_K = 8
FLOOR = 0.5
#: Queries and rows of one block of a batch, at most on average.
QUERY_BLOCK = ROW_BLOCK = 16_384


def collection(spark: SparkSession, name: str, schema: str = "id string, text string, embedding array<float>, metadata map<string,string>") -> DataFrame:
    """The named table of vectors; created empty, marked as one of cosine space, where the catalog has none."""
    spark.sql(f"create table if not exists {name} ({schema}) using parquet tblproperties ('space' = 'cosine')")
    return spark.table(name)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 with a zero vector, null with a null one, where lengths differ and where a norm is not finite (NaN, infinite or huge components)."""
    return _over(dot(a, b), norm(a) * norm(b))


def _over(product: Column, size: Column) -> Column:
    return F.when(product.isNotNull() & (size < float("inf")), F.coalesce(F.try_divide(product, size), F.lit(0.0)))


def similarity_of(distance: Column) -> Column:
    return 1 - distance


def top_k(vectors: DataFrame, query: list[float], k: int = TOP_K, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector with their ``similarity``; ``where`` filters before ranking. Ties go to the smaller id, nulls come last."""
    found = vectors if where is None else vectors.filter(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return found.withColumn("similarity", cosine(F.col(vector_col), q)).orderBy(F.desc("similarity"), id_col).limit(k)


def apply_floor(ranked: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Rows of at least this similarity; to be applied after ranking, so that fewer than k may be left."""
    return ranked.filter(F.col("similarity") >= floor)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query", columns: list[str] | None = None, match: tuple[str, str] | None = None, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, query_columns: list[str] | None = None) -> DataFrame:
    """Every query's k nearest rows: (query_id, rank, similarity and ``columns`` of ``vectors``, by default all but the vector, and ``query_columns`` of the query's row, by default none).

    Queries and rows are dealt into blocks, and every block of queries meets every block of rows in a group of its own: a matrix product tells which pairs may be
    among the best, and only these are scored, in the order of ``dot``. A group gives k rows a query at most. Pairs without a similarity come last, ties go to the smaller id.
    A query whose id equals a row's id does not meet itself; rows and queries without an id take no part. ``match`` names a column of the queries and one of the rows: a
    query with a value there meets only rows with the same one, a query with null meets all. The work is the number of pairs; what a task holds is bounded by the blocks.
    """
    columns = [c for c in vectors.columns if c != vector_col] if columns is None else columns
    told = query_columns or []
    query_key, row_key = F.col(query_id), F.col(id_col)
    if queries.schema[query_id].dataType != vectors.schema[id_col].dataType:
        query_key, row_key = query_key.cast("string"), row_key.cast("string")
    wanted, given = (F.col(match[0]), F.col(match[1])) if match else (F.lit(None).cast("string"), F.lit(None).cast("string"))
    asked = queries.filter(F.col(query_id).isNotNull()).select(F.col(query_id), F.col(query_vector).alias("_q"), norm(F.col(query_vector)).alias("_qn"), query_key.alias("_qkey"), wanted.alias("_qmatch"), *(F.col(c).alias(f"_w{n}") for n, c in enumerate(told)))
    kept = [F.col(c).alias(f"_c{n}") for n, c in enumerate(columns)]
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), norm(F.col(vector_col)).alias("_n"), row_key.alias("_key"), given.alias("_match"), *kept)
    n_queries, n_rows = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (vectors, row_block)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("_qb", part(query_id, n_queries)).withColumn("_rb", each(n_rows))
    rows = rows.withColumn("_rb", part("_id", n_rows)).withColumn("_qb", each(n_queries))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        i, j, similarity = nearest_in_block(q, r, k) if q.num_rows and r.num_rows else ([], [], np.zeros(0))
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        out = {"_query": q.column(query_id).take(i), "_id": r.column("_id").take(j), "_similarity": pa.array(similarity, pa.float64(), mask=np.isnan(similarity))}
        return pa.table(out | {f"_c{n}": r.column(f"_c{n}").take(j) for n in range(len(columns))} | {f"_w{n}": q.column(f"_w{n}").take(i) for n in range(len(told))})

    field = lambda name, df, c: StructField(name, df.schema[c].dataType)
    schema = StructType([field("_query", queries, query_id), field("_id", vectors, id_col), StructField("_similarity", DoubleType()), *(field(f"_c{n}", vectors, c) for n, c in enumerate(columns)), *(field(f"_w{n}", queries, c) for n, c in enumerate(told))])
    met = asked.groupBy("_qb", "_rb").cogroup(rows.groupBy("_qb", "_rb")).applyInArrow(meet, schema)
    order = Window.partitionBy("_query").orderBy(F.desc("_similarity"), "_id")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    given_back = [F.col(f"_{kind}{n}").alias(c) for kind, names in (("c", columns), ("w", told)) for n, c in enumerate(names)]
    return best.select(F.col("_query").alias(query_id), *given_back, F.col("_similarity").alias("similarity"), "rank")


def answer_gate(retrieved: Column, answer: Column, canned: str = "I could not find this in the documents.") -> Column:
    """The answer and the chunks that may be shown with it. ``retrieved``: chunks over the floor; ``answer``: struct(text, insufficient).

    Without a chunk the canned answer stands, without asking; an insufficient answer keeps its text and shows no chunk.
    """
    none = F.coalesce(F.size(retrieved), F.lit(0)) == 0
    withheld = none | F.coalesce(answer["insufficient"], F.lit(True))
    text = F.when(none | answer.isNull(), F.lit(canned)).otherwise(answer["text"])
    return F.struct(text.alias("text"), withheld.alias("insufficient"), F.when(withheld, F.slice(retrieved, 1, 0)).otherwise(retrieved).alias("chunks"))
