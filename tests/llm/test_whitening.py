"""Whitening against numpy on the whole table, exact integers, and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, whitening


def brute(vectors):
    """Mean, eigenvalues and eigenvectors by the covariance, and the exact deviations."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * a - t) / n for a, t in zip(r, s)] for r in x])
    e, p = np.linalg.eigh(y.T @ y / n)
    return n, y, e[::-1], p[:, ::-1], [sum((n * a - t) ** 2 for a, t in zip(r, s)) for r in x]


def collected(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    return rows


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    n, y, e, p, deviations = brute(vectors.values())
    got = collected(queries.op12_embedding_whitening(spark, sf_dir))
    assert got.keys() == vectors.keys() and all(sorted(v) == list(range(1, 33)) for v in got.values())
    for k in range(32):
        want = y @ p[:, k] / np.sqrt(e[k])
        mine = np.array([got[i][k + 1][0]["whitened"] for i in vectors])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert got[0][k + 1][0]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
    assert [got[i][1][0]["deviation"] for i in vectors] == deviations
    first = got[0][1][0]
    assert first["n"] == n and 0 <= first["identity_error"] < 1e-9


def test_tree_of_many_parts_agrees(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one, many = whitening.fit(table.coalesce(1)), whitening.fit(table.repartition(13, "vec_id"))
    assert one.n == many.n and one.rest == many.rest and (one.floor == many.floor).all()
    assert np.allclose(one.values, many.values, rtol=1e-10) and np.allclose(one.vectors, many.vectors, atol=1e-8)


def test_small_eigenvalues_keep_their_digits(spark):
    """A direction some 10^7 times narrower than the widest: half the digits of a covariance would be gone."""
    rng = np.random.default_rng(5)
    wide, narrow = np.round(rng.standard_normal(3000) * 1e6), rng.integers(-1, 2, 3000)
    rows = [(i, [float(a), float(a + b / 64.0)]) for i, (a, b) in enumerate(zip(wide, narrow))]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # Along (1, -1)/sqrt 2 lies nearly all of the narrow part, that is not explained by the wide one.
    b = narrow - narrow.mean()
    a = 64 * (wide - wide.mean())
    rest = b - a * (a @ b) / (a @ a)
    assert model.values[1] == pytest.approx((rest @ rest) / 3000 / 2, rel=1e-5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (2, [0.0, -3.25, 7.0]), (None, [5.0, 0.1, 0.2]), (-4, [0.3, 0.3, -0.01])]
    other = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, inf, 1.0]), (9, [1.0, 2.0]), (10, []), (11, [1e30, 1.0, 1.0])]
    table = spark.createDataFrame(fine + other, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "id": F.lit(0), "n": F.lit("x"), "component": F.lit(2)})
    n, y, e, p, deviations = brute([v for _, v in fine])
    out = whitening.whitened_components(table).collect()
    assert len(out) == 3 * len(fine) and {r["n"] for r in out} == {5}
    assert sorted(map(int, {r["deviation"] for r in out})) == sorted(set(deviations))
    for k in range(3):
        mine = sorted(abs(r["whitened"]) for r in out if r["component"] == k + 1)
        assert np.allclose(mine, sorted(np.abs(y @ p[:, k] / np.sqrt(e[k]))), atol=1e-9)
    assert {r["vec_id"] for r in out} == {1, 2, None, -4}
    assert whitening.whitened_components(table.limit(0)).count() == 0
    assert whitening.whitened_components(table.filter("vec_id in (5, 6, 10)")).count() == 0


def test_no_variance(spark):
    rows = [(i, [1.0, float(i % 2), 2.0]) for i in range(6)]
    out = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"]: r["explained"] for r in out} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert all(abs(abs(r["whitened"]) - (r["component"] == 1)) < 1e-12 for r in out) and out[0]["identity_error"] < 1e-12
    single = whitening.whitened_components(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in single] == [(0.0, 0.0, 0)] * 3


def test_deviations_beyond_64_bits_are_exact():
    model = whitening.Whitening(10**9, np.array([5, 7]), [3, 10**8], np.eye(2), np.ones(2), 2.0)
    x = np.array([[2**40, 1], [4, 9]])
    want = [sum((10**9 * int(a) - (10**9 * f + r)) ** 2 for a, f, r in zip(row, (5, 7), (3, 10**8))) for row in x]
    assert list(model.deviation(x)) == want
