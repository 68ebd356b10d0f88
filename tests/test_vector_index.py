"""The index gives what the scan gives and reads fewer files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.vector import top_k
from tessera.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Clusters around forty directions, and rows without one."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 8))
    rows = [(i, (centres[i % 40] * 3 + rng.standard_normal(8) * 0.4).tolist(), i % 3) for i in range(3000)]
    odd = [(9001, None, 0), (9002, [0.0] * 8, 0), (9003, [float("nan")] + [1.0] * 7, 0), (9004, [1.0, 2.0], 0), (9005, [], 0), (9006, [1e200] * 8, 0)]
    at = str(tmp_path_factory.mktemp("v") / "t.parquet")
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").write.parquet(at)
    return spark.read.parquet(at)


def same(index, table, query, k, where=None):
    got, want = index.search(query, k, where), top_k(table, query, k, where)
    assert got.columns == want.columns
    key = lambda r: (r["similarity"] is None, -(r["similarity"] or 0), r["vec_id"])
    assert [(r["vec_id"], r["similarity"]) for r in sorted(got.collect(), key=key)] == [(r["vec_id"], r["similarity"]) for r in sorted(want.collect(), key=key)]
    return got


def files(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    return len(df.select(F.input_file_name().alias("f")).distinct().collect())


def test_equal_to_the_scan(spark, table, tmp_path):
    index = VectorIndex.build(table, str(tmp_path / "i"), 32)
    queries = [r["embedding"] for r in table.filter("vec_id in (5, 1234)").collect()]
    for k, where in ((1, None), (8, None), (8, F.col("label") == 2), (5, F.col("vec_id") > 8999)):
        for q in queries:
            same(index, table, q, k, where)
    same(index, table, [0.0] * 8, 4)
    same(index, table, [1.0, 2.0], 2)
    same(index, table, (np.array(queries[0]) * -1).tolist(), 3)
    read = index.rows().filter(F.col("_cell").isin(index.cells_within(queries[0], float(np.sqrt(2 - 2 * 0.97)))))
    assert files(read) < index.rows().select(F.input_file_name()).distinct().count() / 3
    assert "PartitionFilters: [_cell" in index.search(queries[0], 8)._jdf.queryExecution().executedPlan().toString()


def test_new_vectors_enter_cells(spark, table, tmp_path):
    some, rest = table.filter("vec_id % 2 = 0"), table.filter("vec_id % 2 = 1")
    index = VectorIndex.build(some, str(tmp_path / "i"), 16)
    before = index.centroids()
    index.append(rest)
    far = spark.createDataFrame([(70000, [-50.0, 1.0, *[0.0] * 6], 1)], table.schema)
    VectorIndex(spark, str(tmp_path / "i")).append(far)
    assert (index.centroids() == before).all()
    both = table.unionByName(far)
    for q in ([-50.0, 1.0, *[0.0] * 6], table.filter("vec_id = 7").first()["embedding"]):
        same(index, both, q, 6)


def test_nothing_to_index(spark, table, tmp_path):
    index = VectorIndex.build(table.filter("vec_id = 9002"), str(tmp_path / "i"))
    same(index, table.filter("vec_id = 9002"), [1.0] * 8, 3)
