"""One-bit codes and dated URL lists: against brute force, the SQL, and edge rows."""

import datetime
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, queries, url_filters


def brute(rows, asked, k):
    out = {}
    for i, q in asked:
        scored = sorted(((float(np.dot(np.array(v, float), np.array(q, float))), j) for j, v in rows if j != i), key=lambda x: (-x[0], x[1]))
        out[i] = [(j, round(s, 9)) for s, j in scored[:k]]
    return out


def nearest(vectors, asked, k, **options):
    out = {}
    for r in sorted(ann.nearest(vectors, asked, k, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    return out


@pytest.mark.parametrize("blocks", [{}, {"query_block": 5, "vector_block": 64}])
def test_recall(spark, sf_dir, blocks):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = nearest(v, v.filter("vec_id % 20 = 0"), 20, **blocks)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) > 0.97
    assert all(list(x) == sorted(x, key=lambda y: (-y[1], y[0])) and len(x) == 20 for x in got.values())


def test_an_infinite_width_is_exact(spark):
    """The second scale, where the usual width misses one neighbour of 500."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert nearest(v, v.filter("vec_id % 20 = 0"), 20, epsilon=float("inf")) == want


def test_edges(spark):
    rows = [(0, [1.0, 2.0, 0.0]), (20, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (40, [-1.0, 0.0, 0.5]), (60, []), (8, [3.0, 0.0, 0.0]), (8, [3.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = nearest(v, v.filter("vec_id % 20 = 0"), 3)
    fine = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 3 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    assert got == brute(fine, [r for r in fine if r[0] % 20 == 0], 3)
    assert ann.nearest(v.limit(0), v, 3).count() == 0 and ann.nearest(v, v.limit(0), 3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64)) * rng.random((4000, 1))
    p = ann.rotation(64)
    assert np.allclose(p @ p.T, np.eye(64))
    codes, outside = ann.Codes.of(x, p), []
    for q in x[:20]:
        estimate, error = codes.bounds(q, p, rng)
        outside.append((np.abs(x @ q - estimate) > error).mean())
    assert np.mean(outside) < 0.03


def test_runs_agree_whatever_the_blocks_and_huge_components_are_scored(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(16) * (1e200 if i % 50 == 7 else 1)).tolist()) for i in range(600)] + [(9, rng.standard_normal(16).tolist()) for _ in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.filter("vec_id % 20 = 0")
    got = [nearest(v, asked, 5, query_block=q, vector_block=b) for q, b in ((1024, 16384), (7, 200), (7, 200))]
    assert got[1] == got[2]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 5)
    for found in got:
        assert found.keys() == want.keys() and np.mean([len({j for j, _ in found[i]} & {j for j, _ in want[i]}) / 5 for i in want]) > 0.97


def test_queries_do_not_pass_through_the_driver(spark, sf_dir):
    """All tables here lie under Spark's threshold for broadcasts."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.nearest(v, v.filter("vec_id % 20 = 0"), 20, vector_block=64)
    assert found.count() > 0 and "Broadcast" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" in plan


def test_many_blocks_of_queries_become_one(spark, monkeypatch):
    """Vectors are sent once for each block of queries: with 24 of them, of 5, two remain, and the result is the same."""
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(600)], "vec_id long, embedding array<double>").repartition(3)
    got, dealt = [], []
    for gathered in (1, 16):
        monkeypatch.setattr(ann, "GATHERED", gathered)
        df = ann.nearest(v, v.filter("vec_id % 5 = 0"), 5, query_block=5, vector_block=10)
        got.append(sorted(tuple(r) for r in df.collect()))
        dealt.append(set(re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", df._jdf.queryExecution().optimizedPlan().toString())))
    assert dealt == [{"24"}, {"2"}]
    assert got[0] == got[1] and len(got[0]) == 600


def test_vectors_of_floats_and_numbers(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    for kind in ("float", "int"):
        v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        assert nearest(v, v.filter("vec_id % 20 = 0"), 3) == brute(rows, [r for r in rows if r[0] % 20 == 0], 3)


def test_urls_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    sql = queries.ORACLE_SQL["op9_url_filters"]
    names = [r[0] for r in con.execute(f"describe {sql}").fetchall()]
    want = sorted(con.execute(sql).fetchall(), key=repr)
    got = queries.op9_url_filters(spark, sf_dir)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    assert 0 < sum(r[names.index("blocked")] for r in want) < len(want)


def test_url_edges(spark):
    day = lambda m, d=1: datetime.date(2024, m, d)
    entries = [
        ("a", "domain", "Bad.example.", "add", day(2)), ("a", "domain", "bad.example", "add", day(3)), ("a", "domain", "bad.example", "remove", day(5)), ("b", "host", "x.bad.example", "add", day(1)),
        ("c", "prefix", "ok.example/p/q/", "add", day(1)), ("d", "domain", "ok.example", "remove", day(1)), ("e", "domain", "tie.example", "remove", day(4)), ("e", "domain", "tie.example", "add", day(4)),
        (None, "host", "ok.example", "add", day(1)), ("f", "host", "ok.example", "add", None), ("f", "host", "ok.example", "burn", day(1)), ("g", "domain", "example", "add", day(8)),
    ]
    captures = [
        (1, "http://bad.example/", day(1, 31), []), (2, "http://bad.example/", day(2), ["a"]), (3, "https://u:p@X.BAD.example.:8080/z?q", day(4), ["a", "b"]), (4, "http://x.bad.example", day(5), ["b"]), (5, "http://notbad.example", day(4), []),
        (6, "http://ok.example/p/q/r#f", day(4), ["c"]), (7, "http://ok.example/p/qq", day(4), []), (8, "http://ok.example//p//q", day(4), ["c"]), (9, "http://tie.example/", day(4), ["e"]), (10, None, day(4), []), (11, "no url", day(4), []), (12, "http://bad.example", None, []),
        (2, "http://bad.example/", day(2), ["a"]), (None, "http://bad.example/", day(2), ["a"]), (13, "http://bad.example/" + "s/" * 3000, day(9), ["g"]),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at date")
    c = spark.createDataFrame([r[:3] for r in captures], "page_id long, url string, fetched date").withColumn("key", F.lit("clash")).withColumn("id", F.lit(1))
    got = sorted(((r["page_id"], r["url"], r["fetched"], r["lists"]) for r in url_filters.evaluate(c, e).collect()), key=repr)
    assert got == sorted(captures, key=repr)
    assert url_filters.evaluate(c, e.limit(0)).filter("blocked").count() == 0 and url_filters.evaluate(c.limit(0), e).count() == 0


def test_url_path_is_native(spark, sf_dir):
    plan = queries.op9_url_filters(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
