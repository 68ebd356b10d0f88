"""Vectors, grounding and metrics: borders, and the shapes of plans that must hold at scale."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import grounding as G
from tessera.operators import metrics as M
from tessera.operators import vector as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0), (3, [1.0, 1.0], 1), (4, [2.0, 0.0], 1), (5, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")


def test_ties_go_to_the_smaller_id_and_the_floor_comes_last(spark):
    found = V.top_k(vectors(spark), [1.0, 0.0], 3)
    assert [r["vec_id"] for r in found.collect()] == [1, 4, 3]
    assert [r["vec_id"] for r in V.apply_floor(found, 0.9).collect()] == [1, 4]


def test_zero_vectors_have_similarity_0(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["similarity"]) for r in V.top_k(rows, [2.0, 0.0], 4).collect()] == [(1, 1.0), (2, 0.0), (3, -1.0), (4, None)]
    assert {r["similarity"] for r in V.top_k(rows, [0.0, 0.0], 4).filter("vec_id < 4").collect()} == {0.0}
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, query array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in V.batch_top_k(rows, asked, 2).collect()}
    assert got == {(9, 1): (1, 1.0), (9, 2): (2, 0.0), (8, 1): (1, 0.0), (8, 2): (2, 0.0)}


def test_normalize_keeps_zero(spark):
    rows = {r["vec_id"]: r["u"] for r in vectors(spark).select("vec_id", V.normalize(F.col("embedding")).alias("u")).collect()}
    assert rows[5] == [0.0, 0.0] and rows[2] == [0.0, 1.0]


def test_top_k_is_pushed_down(spark, sf_dir):
    plan = plan_of(V.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), [0.1] * 64, 8, F.col("label") == 3))
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan


def test_batches_limit_in_the_window_and_need_no_cross_join(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = plan_of(V.batch_top_k(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))))
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_grounding_borders(spark):
    kinds = "id int, c array<struct<chunk_id:string>>, r array<string>, i boolean"
    rows = spark.createDataFrame([(1, [("a",), ("z",)], ["a"], False), (2, [("z",)], ["a"], False), (3, [], ["a"], False), (4, [("a",)], ["a"], True), (5, [("a",)], [], None)], kinds)
    got = {r["id"]: ([c["chunk_id"] for c in r["g"]["citations"]], r["g"]["insufficient"]) for r in rows.select("id", G.check(F.col("c"), F.col("r"), F.col("i")).alias("g")).collect()}
    assert got == {1: (["a"], False), 2: ([], True), 3: ([], False), 4: ([], True), 5: ([], True)}


def test_is_hit(spark):
    rows = spark.createDataFrame([("d", "A > Leave", "x", "d", "leave"), ("d", "A", "about LEAVE", "d", "Leave"), ("d", "A", "x", "d", ""), ("d", "A", "x", "e", ""), ("d", "A", "x", "d", "pay")], "a string, p string, t string, d string, s string")
    assert [r[0] for r in rows.select(M.is_hit(*(F.col(c) for c in "aptds"))).collect()] == [True, True, True, False, False]


def test_metrics_count_misses(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, first_rank int")
    m = M.retrieval_metrics(ranks, 5).first().asDict()
    assert m["hit_rate_at_1"] == 1 / 3 and m["hit_rate_at_5"] == 2 / 3 and abs(m["mrr"] - 1.25 / 3) < 1e-12 and "hit_rate_at_8" not in m


def test_correctness_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "category string, correct boolean")
    assert [tuple(r) for r in M.correctness(empty).collect()] == [(None, 0, 0, 0.0, True)]


def test_collection_is_created_once(spark, tmp_path):
    spark.sql(f"create database probe_vectors location '{tmp_path}'")
    try:
        assert V.collection(spark, "probe_vectors.chunks").count() == 0
        spark.sql("insert into probe_vectors.chunks values ('a', 't', array(1.0f), map('k', 'v'))")
        assert [r["id"] for r in V.collection(spark, "probe_vectors.chunks").collect()] == ["a"]
        assert spark.sql("show tblproperties probe_vectors.chunks ('space')").first()["value"] == "cosine"
    finally:
        spark.sql("drop database probe_vectors cascade")


def by_pairs(v, q, k, match=None):
    """The same by all pairs and a window."""
    met = v.join(q, F.col("query_id") != F.col("vec_id")).filter(match or "true").withColumn("s", V.cosine(F.col("embedding"), F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    return sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["s"])) for r in met.withColumn("rank", rank).filter(F.col("rank") <= k).collect())


def test_batches_by_matrix_products_are_exact(spark, monkeypatch):
    """Copies, scaled copies, zeros, tiny and huge ones, other lengths, nulls and components that are not finite."""
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    odd = [None, [0.0] * 5, [1e-200] * 5, [1e-150, 0.0, 0.0, 1e-151, 0.0], [1e160] * 5, [1e150, -1e150, 1.0, 0.0, 2.0], [1.0, 2.0], [nan] * 5, [inf, 0.0, 1.0, 1.0, 1.0], [1.0, None, 0.0, 1.0, 1.0], [], [-1e-310] * 5]
    rows = base + odd * 2 + [[3.0 * x for x in b] for b in base] + base * 4
    label = [rng.choice(["a", "b", None]) for _ in rows]
    kinds = "vec_id long, embedding array<double>, label string"
    v = spark.createDataFrame([(n, r, x) for n, (r, x) in enumerate(zip(rows, label))], kinds).cache()
    q = v.filter("vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.when(F.col("label") == "a", "a").alias("wanted"))
    got = lambda **given: sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["similarity"])) for r in V.batch_top_k(v, q, **given).collect())
    for k in (1, 7, 1 << 30):
        assert got(k=k, row_block=100, query_block=25) == by_pairs(v, q, k)
    assert got(k=7, match=("wanted", "label"), row_block=100) == by_pairs(v, q, 7, "wanted is null or wanted = label")
    v.unpersist()


@pytest.mark.parametrize("name", ["batch_retrieval", "answer_gate", "retrieval_metrics", "context_blocks"])
def test_queries_meet_rows_in_blocks(spark, sf_dir, name):
    from tessera.plans.retrieval_queries import QUERIES

    assert "FlatMapCoGroupsInArrow" in plan_of(QUERIES[name](spark, sf_dir))


def block(rows, queries, dim=16):
    """Tables as ``batch_top_k`` gives them to a group; the queries are the first of the rows."""
    pa, np = pytest.importorskip("pyarrow"), pytest.importorskip("numpy")
    norm = pa.array(np.sqrt(np.add.accumulate(rows * rows, axis=1)[:, -1]))
    lists, ids, match = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dim).cast(pa.list_(pa.float64())), pa.array(np.arange(len(rows))[::-1].copy()), pa.nulls(len(rows), pa.string())
    asked = pa.table({"_q": lists, "_qn": norm, "_qkey": ids, "_qmatch": match}).slice(0, queries)
    return asked, pa.table({"_v": lists, "_n": norm, "_key": ids, "_id": ids, "_match": match})


def test_copies_are_scored_a_few_times_a_query(monkeypatch):
    """A common vector does not cost the square of its copies, and levels are looked for once, not in every tile."""
    import numpy as np

    from tessera.operators import vector_blocks as B

    some = np.random.default_rng(5)
    rows = some.normal(size=(9000, 16))
    rows[::3] = rows[0]
    rows[1::9] = 0
    asked, given = block(rows, 300)
    scored, levels, scores, partition = [], [], B._scores, np.partition
    monkeypatch.setattr(B, "_scores", lambda a, b, size: scored.append(len(a)) or scores(a, b, size))
    monkeypatch.setattr(B.np, "partition", lambda a, *n, **k: levels.append(a.size) or partition(a, *n, **k))
    i, j, similarity = B.nearest_in_block(asked, given, 8)
    assert sum(scored) < 300 * 60 and sum(levels) <= 300 * B.ROWS
    exact = np.array([[0.0 if not x.any() or not y.any() else float(x @ y / np.sqrt((x @ x) * (y @ y))) for y in rows] for x in rows[:12]])
    for n in range(12):
        exact[n, n] = -9
        best = np.lexsort((-np.arange(9000), -exact[n].round(12)))[:8]
        assert list(j[i == n]) == list(best) and np.allclose(similarity[i == n], exact[n][best])


def test_levels_closer_than_single_precision_are_told_apart(spark):
    """Differences far below the products' rounding decide, as by all pairs."""
    rng = random.Random(8)
    base = [rng.gauss(0, 1) for _ in range(24)]
    rows = [[x * (1 + rng.gauss(0, 10.0 ** -rng.randint(5, 14))) for x in base] for _ in range(400)] + [base] * 30
    v = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "vec_id long, embedding array<double>").cache()
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["similarity"])) for r in V.batch_top_k(v, q, k=9, row_block=150).collect())
    assert got == by_pairs(v, q, 9)
    v.unpersist()


@pytest.mark.parametrize("name", ["answer_gate", "retrieval_metrics", "context_blocks"])
def test_queries_score_few_pairs_of_a_common_vector(spark, tmp_path, monkeypatch, name):
    """Two thirds of the rows, and all queries, are one vector: 60 x 2,000 pairs of copies, of which each query needs eight."""
    from tessera.plans.retrieval_queries import QUERIES

    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    common = vector()
    rows = [(n, common if n % 50 == 0 or n % 3 else vector(), n % 5) for n in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    count = str(tmp_path / "count")

    def counted(q, r, k):
        from tessera.operators import vector_blocks as B

        scores = B._scores

        def noted(a, b, size):
            with open(count, "a") as file:
                file.write(f"{len(a)}\n")
            return scores(a, b, size)

        B._scores = noted
        try:
            return B.nearest_in_block(q, r, k)
        finally:
            B._scores = scores

    monkeypatch.setattr(V, "nearest_in_block", counted)
    assert len(QUERIES[name](spark, str(tmp_path)).collect()) == (1 if name == "retrieval_metrics" else 60)
    monkeypatch.undo()
    with open(count) as file:
        assert 60 * 8 <= sum(map(int, file)) < 60 * 60


def test_context_blocks_rank_a_repeated_query_once(spark, tmp_path):
    """Rows with one id are one query, as in its SQL, and no table is joined for a label that is not asked for."""
    from tessera.functions import text as T
    from tessera.plans.retrieval_queries import QUERIES

    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), *((n, [1.0, float(n)], 2) for n in range(1, 4))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["context_blocks"](spark, str(tmp_path))
    assert "Join" not in plan_of(found)
    # Both copies of the query meet all three rows: six ranks, each once.
    one = F.struct(F.col("n").alias("rank"), F.col("v").cast("string").alias("chunk_id"), F.lit("label").alias("title"), F.lit("2").alias("section_path"), F.concat(F.lit("text "), F.col("v")).alias("text"))
    want = spark.createDataFrame([(n, 1 + n // 2) for n in range(6)], "n int, v int").agg(F.sha2(T.context_block(F.array_sort(F.collect_list(one))), 256)).first()[0]
    assert [tuple(r) for r in found.collect()] == [(0, want)]


@pytest.mark.parametrize("rows", [
    [(n // 2, n % 4) for n in range(300)],  # each id twice, with two labels
    [(n // 2, n // 2 % 4) for n in range(300)],
    [(0, 1)], [(0, n) for n in range(4)], [], [(n, None if n % 50 == 0 else n % 4) for n in range(120)],
])
def test_retrieval_metrics_count_ids_with_a_rank(spark, tmp_path, rows):
    """As in its SQL: ids that rows share are one question, judged by each row's label, and one that meets no row is none; no table is joined for the labels."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans.retrieval_queries import ORACLE_SQL, QUERIES

    rng = random.Random(7)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)], label) for n, label in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["retrieval_metrics"](spark, str(tmp_path))
    assert "Join" not in plan_of(found)
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.execute(ORACLE_SQL["retrieval_metrics"]).fetchone()
    assert tuple(found.first()) == pytest.approx(want, abs=1e-9)


def test_first_ranks_of_given_questions(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id long, rank int, hit boolean")
    assert sorted(map(tuple, M.first_ranks(ranked).collect())) == [(1, 2), (2, None)]
    assert sorted(map(tuple, M.first_ranks(ranked, spark.range(1, 4).toDF("query_id")).collect())) == [(1, 2), (2, None), (3, None)]
