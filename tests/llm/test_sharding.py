"""Resharding: flows against all flows there are, sizes, moved bytes, what is rewritten, and edge rows."""

import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, sharding
from tessera.llm.sharding import SHARD, SLOT, Block


def least(supply, capacity, cost):
    """The least cost by trying every whole-number flow."""

    def rows(amount, n):
        return [c for c in itertools.product(range(amount + 1), repeat=n) if sum(c) == amount]

    n = len(capacity)
    return min(
        sum(f * c for row, costs in zip(flows, cost) for f, c in zip(row, costs))
        for flows in itertools.product(*(rows(s, n) for s in supply)) if all(sum(col) <= cap for col, cap in zip(zip(*flows), capacity))
    )


def test_flows_cost_the_least():
    rng = np.random.default_rng(7)
    for _ in range(60):
        m, n = rng.integers(1, 4, 2)
        supply = rng.integers(0, 5, m).tolist()
        capacity = rng.integers(0, 5, n).tolist()
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = rng.integers(0, 6, (m, n))
        flow = sharding.least_cost_flow(supply, capacity, cost)
        assert (flow >= 0).all() and flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all()
        assert (flow * cost).sum() == least(supply, capacity, cost.tolist())


def test_at_unit_cost_only_the_surplus_moves():
    rng = np.random.default_rng(8)
    for _ in range(20):
        supply = rng.integers(0, 10**12, 40).tolist() + [0] * 60
        capacity = sharding.equal_capacities(sum(supply), 100)
        flow = sharding.least_cost_flow(supply, capacity)
        assert flow.sum() - np.trace(flow) == sum(max(0, s - c) for s, c in zip(supply, capacity))
    with pytest.raises(ValueError):
        sharding.least_cost_flow([3], [1, 1])


def test_few_blocks_are_split():
    blocks = tuple(Block(f"f{i}", i % 3, 10, 1000 + i) for i in range(300))
    sizes = [sum(b.bytes for b in blocks if b.shard == k) for k in range(3)]
    flow = sharding.least_cost_flow([*sizes, 0, 0], sharding.equal_capacities(sum(sizes), 5))
    whole, split = sharding.plan_blocks(blocks, flow)
    assert len(whole) + len(split) == 300 and len(split) <= (flow > 0).sum()
    size = {b.file: b.bytes for b in blocks}
    got = np.zeros(5, np.int64)
    for b in whole:
        got[b.shard] += b.bytes
    for file, parts in split.items():
        assert sum(n for _, n in parts) == size[file]
        for j, n in parts:
            got[j] += n
    assert got.tolist() == sharding.equal_capacities(sum(sizes), 5)


def test_whole_table(spark, sf_dir, texts):
    rows = queries.op11_sharding(spark, sf_dir).collect()
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    assert len(rows) == len(want) and {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    size = np.zeros(16, np.int64)
    for r in rows:
        size[r["shard"]] += r["size"]
    assert size.max() - size.min() < max(s for s, _ in want.values()) / 8
    for k in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_only_split_files_are_rewritten_and_the_least_is_moved(spark, documents, tmp_path):
    old = F.pmod(F.col("doc_id"), F.lit(5)).cast("int")
    before = sharding.write_shards(documents, old, f"file://{tmp_path}", block_bytes=8000)
    local = lambda file: "/" + file.removeprefix("file:").lstrip("/")
    at = {b.file: os.stat(local(b.file)).st_mtime_ns for b in before.blocks}
    capacities = sharding.equal_capacities(sum(b.bytes for b in before.blocks), 8)
    after = sharding.reshard(before, capacities)
    flow = sharding.least_cost_flow(before.sizes(8), capacities)
    kept = {b.file for b in after.blocks} & set(at)
    assert len(before.blocks) - len(kept) <= (flow > 0).sum()
    assert all(os.stat(local(f)).st_mtime_ns == at[f] for f in kept)
    assert not any(os.path.exists(local(f)) for f in set(at) - kept)
    # The bytes that came to another shard are the surplus of the old ones, up to a document for each part.
    now = {r["doc_id"]: r for r in after.documents().collect()}
    size = {i: len(r["text"].encode()) + 1 for i, r in now.items()}
    moved = sum(size[i] for i, r in now.items() if r[SHARD] != i % 5)
    surplus = sum(max(0, s - c) for s, c in zip(before.sizes(8), capacities))
    assert abs(moved - surplus) < max(size.values())
    assert sorted(now) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())
    again = sharding.open_layout(spark, after.root, documents.schema)
    assert (again.version, again.blocks) == (after.version, after.blocks)
    assert sorted(map(str, again.documents().collect())) == sorted(map(str, now.values()))
    # A layout that has the sizes asked for is left as it is.
    assert sharding.reshard(after, after.sizes(8)).blocks == after.blocks
    # Back to three shards: the others give everything away.
    fewer = sharding.reshard(after, sharding.equal_capacities(sum(size.values()), 3))
    assert sorted({b.shard for b in fewer.blocks}) == [0, 1, 2] and fewer.documents().count() == len(now)
    assert sorted(tuple(map(str, r)) for r in fewer.documents().select(*documents.columns).collect()) == sorted(tuple(map(str, r)) for r in documents.collect())


def test_edges(spark, edge, edge_rows):
    out = sharding.resharded(edge, F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)), 4)
    rows = out.collect()
    assert out.columns == [*edge.columns, SHARD, SLOT]
    assert sorted((tuple(r)[:-2] for r in rows), key=repr) == sorted(edge_rows, key=repr)
    for k in range(4):
        slots = sorted(r[SLOT] for r in rows if r[SHARD] == k)
        assert slots == list(range(len(slots)))
    assert sharding.resharded(edge.limit(0), F.lit(0), 4).count() == 0
    many = sharding.resharded(edge.filter("doc_id < 3"), F.lit(7), 16)
    assert many.count() == 3 and many.filter(F.col(SHARD) > 15).count() == 0


def test_rows_that_are_all_equal_are_spread(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = [r["n"] for r in sharding.resharded(df, F.lit(0), 16).groupBy(SHARD).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
