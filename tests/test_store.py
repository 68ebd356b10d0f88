"""The store: versions, keys, buckets, and stops after every step."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources.store import Conflict, Store, latest

KIND = "k string, at int, v string, kept string"


class Stop(Exception):
    pass


def stopping(n):
    """Lets ``n`` steps pass and stops after the next."""
    seen = []

    def after(step):
        seen.append(step)
        if len(seen) == n + 1:
            raise Stop(step)

    return after, seen


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_and_deletions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    df = lambda *r: spark.createDataFrame(list(r), KIND)
    assert store.read("t", KIND).count() == 0
    with pytest.raises(KeyError):
        store.read("t")
    store.transaction().upsert("t", "k", df(("a", 1, "x", "p"), ("a", 3, "z", None), ("a", 2, "y", "q"), ("b", 1, "b", "r"), (None, 1, "n", "n")), ["at"]).commit({"n": 1})
    assert rows(store.read("t")) == [("a", 3, "z", None), ("b", 1, "b", "r")]
    store.transaction().upsert("t", "k", df(("b", 2, None, None), ("c", 1, "c", "s")), ["at"], keep=["kept"]).commit({"m": 2})
    assert rows(store.read("t")) == [("a", 3, "z", None), ("b", 2, None, "r"), ("c", 1, "c", "s")]
    store.transaction().upsert("t", "k", df(("a", 9, "gone", None), ("d", 9, "gone", None), ("c", 2, "c2", None)), ["at"], gone=F.col("_n.v") == "gone").commit()
    assert rows(store.read("t")) == [("b", 2, None, "r"), ("c", 2, "c2", None)]
    assert rows(store.read("t", version=1)) == [("a", 3, "z", None), ("b", 1, "b", "r")]
    assert store.properties() == {"n": 1, "m": 2} and store.versions() == [1, 2, 3]
    store.vacuum()
    assert store.versions() == [3] and rows(store.read("t")) == [("b", 2, None, "r"), ("c", 2, "c2", None)]


def test_equal_orders_have_one_winner(spark):
    df = spark.createDataFrame([("a", 1, "x", "p"), ("a", 1, "y", None), ("a", 1, "y", None)], KIND)
    assert {tuple(latest(df.repartition(n), "k", ["at"]).first()) for n in (1, 2, 3)} == {("a", 1, "y", None)}


def test_replacement_of_many_rows_of_a_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    df = lambda *r: spark.createDataFrame(list(r), KIND)
    store.transaction().replace("t", "k", df(("a", 1, "x", ""), ("a", 2, "y", ""), ("b", 1, "b", ""))).commit()
    store.transaction().replace("t", "k", df(("a", 3, "z", "")), spark.createDataFrame([("b",), ("never",)], "k string")).commit()
    assert rows(store.read("t")) == [("a", 3, "z", "")]
    store.transaction().replace("t", "k", df().limit(0), spark.createDataFrame([("a",)], "k string")).commit()
    assert store.read("t").count() == 0
    with pytest.raises(ValueError, match="key"):
        store.transaction().replace("t", "v", df(("a", 3, "z", "")))


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    many = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("at"), F.lit("v" * 50).alias("v"), F.lit("").alias("kept"))
    store.transaction().upsert("t", "k", many, ["at"]).commit()
    before = store.snapshot()["tables"]["t"]["folders"]
    for n in (1, 8):
        store.transaction().upsert("t", "k", spark.createDataFrame([(str(i), 2, "new", "") for i in range(n)], KIND), ["at"]).commit()
        after = store.snapshot()["tables"]["t"]["folders"]
        changed = [b for b in after if after[b] != before[b]]
        size = lambda folder: sum(f.stat().st_size for f in (tmp_path / folder).parent.rglob("*.parquet"))
        written = size(after[changed[0]])
        assert len(changed) <= n and written < 40_000 * n
        before = after
    assert store.read("t").count() == 20_000 and store.read("t").filter("at = 2").count() == 8


def test_a_stop_after_any_step_leaves_the_old_version_or_the_new_one(spark, tmp_path):
    df = lambda v: spark.createDataFrame([("a", 1, v, ""), ("b", 1, v, "")], KIND)
    root = f"file://{tmp_path}"
    Store(spark, root).transaction().replace("t", "k", df("old")).replace("u", "k", df("old")).commit({"run": 1})
    seen_new = False
    for n in range(5):
        after, seen = stopping(n)
        try:
            Store(spark, root, after).transaction().replace("t", "k", df("new")).replace("u", "k", df("new")).commit({"run": 2})
        except Stop:
            pass
        store = Store(spark, root)
        now = {r["v"] for t in "tu" for r in store.read(t).collect()}
        assert now == ({"old"} if store.properties()["run"] == 1 else {"new"}) and store.read("t").count() == 2
        seen_new |= now == {"new"}
        if len(seen) <= n:
            break
    assert seen_new and n == 4


def test_of_two_writers_one_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([("a", 1, "x", "")], KIND)
    first, second = store.transaction(), store.transaction()
    first.upsert("t", "k", df, ["at"]).commit()
    with pytest.raises(Conflict):
        second.upsert("t", "k", df, ["at"]).commit()
    assert store.versions() == [1]


def test_an_ingest_run_that_stops_loses_no_chunk(spark, tmp_path):
    raw, root = tmp_path / "raw", f"file://{tmp_path}/store"
    raw.mkdir()
    page = lambda k, body: f"---\ndoc_id: {k}\ntitle: Page {k}\ncategory: leave\n---\n{body}\n"
    for k in "abc":
        (raw / f"{k}.md").write_text(page(k, f"Words of {k}."))
    S.ingest(spark, str(raw), root, {"run": 1})
    (raw / "a.md").write_text(page("a", "Other words."))
    (raw / "b.md").unlink()
    for n in (1, 3):  # between tables, and before the snapshot is put
        after, _ = stopping(n)
        with pytest.raises(Stop):
            S.ingest(spark, str(raw), Store(spark, root, after), {"run": 2})
        assert Store(spark, root).read("chunks").count() == 3 and Store(spark, root).properties()["run"] == 1
    S.ingest(spark, str(raw), root, {"run": 3})
    store = Store(spark, root)
    assert sorted(r["doc_id"] for r in store.read("chunks").collect()) == ["a", "c"] and store.properties()["total_chunks"] == 2
    assert {r["name"] for r in S.load_manifest(store).collect()} == {"a.md", "c.md"}
