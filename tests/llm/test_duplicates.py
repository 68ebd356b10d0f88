"""Near-duplicates and repeated windows against brute force, on the small table, on edge rows and on families made for it."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exchange as X
from tessera.llm import jaccard as J
from tessera.llm import scratch
from tessera.llm import substring as S
from tessera.llm.components import components
from tessera.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, k=5):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(n)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for n, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for m in holders[g]:
                common[m] += 1
        for m, c in common.items():
            if m < n and i is not None and sets[m][0] is not None and 100 * c >= 75 * (len(s) + len(sets[m][1]) - c):
                root[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, len(s), least[find(n)] if i is not None else None) for n, (i, s) in enumerate(sets)), key=repr)


def found(df):
    return sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=repr)


def test_small_table(documents, texts):
    assert found(documents) == brute_components(texts)


def test_edges(edge, edge_rows):
    assert found(edge) == brute_components([r[:2] for r in edge_rows])
    assert J.near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "pivots"), [(512, 32), (3, 2), (3, 100)])
def test_families(spark, monkeypatch, tmp_path, block, pivots):
    """Chains of edits, copies and texts that share a passage but no link; small blocks deal large regions to many tasks and levels."""
    for name, value in (("BLOCK", block), ("PIVOTS", pivots), ("CHUNK", max(2, block))):
        monkeypatch.setattr(J, name, value)
    random.seed(block)
    rows, n = [], 0
    passage = [f"p{i}" for i in range(60)]
    for family in range(8):
        words = [f"f{family}w{i}" for i in range(70)]
        for _ in range(14):
            for at in random.sample(range(70), random.choice([0, 1, 2, 3])):
                words = [*words[:at], f"e{random.randrange(10**6)}", *words[at + 1 :]]
            rows.append((n * 7 % 1009, " ".join(words)))
            n += 1
    for i in range(30):
        rows.append((n * 7 % 1009, " ".join(passage + [f"own{i}x{j}" for j in range(random.choice([3, 12, 25]))])))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = found(df)
    assert got == brute_components(rows)
    assert 8 < len({c for _, _, c in got}) < len(rows)


def test_chain_of_shared_passages_stays_linear(spark, monkeypatch, tmp_path):
    """Each text shares a passage with the one before and another with the next; none link. Rows sent to tasks grow with the texts."""
    sent = []
    real = J.Scratch.write
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "CHUNK", 4)

    def write(self, df, name):
        out = real(self, df, name)
        if name == "regions":
            sent.append(out[0].count())
        return out

    monkeypatch.setattr(J.Scratch, "write", write)
    for n in (60, 240):
        rows = [(i, " ".join([f"p{i}x{j}" for j in range(30)] + [f"p{i + 1}x{j}" for j in range(30)])) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / f"chain{n}"))
        sent.append(0)
        assert found(spark.read.parquet(str(tmp_path / f"chain{n}"))) == brute_components(rows)
    first, second = sum(sent[1 : sent.index(0, 1)]), sum(sent[sent.index(0, 1) :])
    assert 0 < second <= 4.5 * first


def test_region_that_does_not_divide(spark, monkeypatch, tmp_path):
    """Many texts that are all about as far from each other: all outside members meet all others, in groups and chunks."""
    for name, value in (("BLOCK", 4), ("PIVOTS", 3), ("CHUNK", 5)):
        monkeypatch.setattr(J, name, value)
    random.seed(4)
    paragraphs = [[f"t{i}x{j}" for j in range(9)] for i in range(12)]
    rows = [(i, " ".join(w for k in sorted(random.sample(range(12), 8)) for w in paragraphs[k])) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    real, stuck = J.Scratch.write, []

    def write(self, df, name):
        out = real(self, df, name)
        if name == "regions":
            stuck.append(out[0].filter("stuck").count())
        return out

    monkeypatch.setattr(J.Scratch, "write", write)
    got = found(spark.read.parquet(str(tmp_path / "d")))
    assert got == brute_components(rows) and any(stuck)


def plans(spark, run):
    """The plans, as they ran, of all that ``run`` executes."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    new = store.executionsList(int(before), int(store.executionsCount() - before))
    return [new.apply(i).physicalPlanDescription() for i in range(new.size())]


def test_joins_send_no_table_through_the_driver(spark, documents, tmp_path, monkeypatch):
    """Files of ids and counts are far smaller than their rows; all tables here lie under Spark's threshold for broadcasts, but not under our own."""
    monkeypatch.setattr(scratch, "SMALL", 1, raising=False)
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k, None) for k in settings]
    ran = plans(spark, lambda: J.near_duplicates(documents).write.parquet(str(tmp_path / "found")))
    assert sum("Join" in x for x in ran) > 5 and not any("Broadcast" in x for x in ran)
    assert [spark.conf.get(k, None) for k in settings] == before


def test_numbers_of_kept_rows_do_not_pass_through_the_driver(spark, documents, tmp_path, monkeypatch):
    """Nor does the row for each document that finds the one to keep: their number is that of the documents."""
    monkeypatch.setattr(scratch, "SMALL", 1, raising=False)
    ran = plans(spark, lambda: J.keep_one(documents).write.parquet(str(tmp_path / "kept")))
    assert any("Join" in x for x in ran) and not any(re.search(r"Broadcast\w+Join .*Inner", x) for x in ran)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1), min_size=3, max_size=14), st.integers(1, 4))
def test_linked_members_meet_in_a_voronoi_region(sets, k):
    distance = np.array([[1 - len(a & b) / len(a | b) for b in sets[:k]] for a in sets])
    regions = defaultdict(set)
    for i, p in zip(*J.voronoi(distance, 0.25)):
        regions[p].add(i)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= 75 * len(a | b):
                assert any({i, j} <= members for members in regions.values())


def test_made_collisions_do_not_link_nor_remove(spark):
    """Words that have one value in every polynomial modulo 2^64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    tail = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {tail}"), (4, f"{other} {tail}")], "doc_id long, text string")
    assert {i: c for i, _, c in found(df)} == {1: 1, 2: 2, 3: 3, 4: 3}  # 8 of 10 shingles
    assert {r["doc_id"]: r["n_removed"] for r in S.remove_repeated(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert [n for _, n, _ in found(df)] == [1, 1, 9, 9]


def test_equal_first_hashes_are_told_apart():
    first, second = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 0, 2, 1, 0], np.uint32)
    order, begin = S.W.group(first, second)
    assert [list(zip(first[x].tolist(), second[x].tolist())) for x in np.split(order, begin[1:])] == [[(3, 0)] * 2, [(5, 1)] * 2, [(5, 2)]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1), min_size=2, max_size=14))
def test_join_sets_joins_all_that_link(sets):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    links = J.join_sets(arrays, np.array([len(s) for s in sets]), np.arange(len(sets)))

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return [root.index(r) for r in root]

    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert all(linked(a, b) for a, b in links)
    assert groups(links) == groups([(a, b) for a in range(len(sets)) for b in range(a) if linked(a, b)])


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2, 40)]
    e = spark.createDataFrame([*chain, *hub, (7, 7), (300, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e, Scratch(spark, "test")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 300: 200, 200: 200}


def brute_cut(rows, k=13):
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - k + 1):
                g = tuple(w[a : a + k])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and least[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def cut(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in S.remove_repeated(df).collect()), key=repr)


@pytest.mark.parametrize("batch", [1 << 23, 4000])
def test_windows(documents, texts, edge, edge_rows, monkeypatch, batch):
    monkeypatch.setattr(X, "BATCH_BYTES", batch)  # many small batches meet in the buckets
    assert cut(documents) == brute_cut(texts)
    assert cut(edge) == brute_cut([r[:2] for r in edge_rows])
    assert S.remove_repeated(edge.limit(0)).count() == 0


def test_removed_spans_are_maximal(edge):
    rows = {r["doc_id"]: r for r in S.remove_repeated(edge).collect() if r["doc_id"] is not None}
    assert [(x["start"], x["end"]) for x in rows[10]["removed"]] == [(2, 22)] and rows[-17]["removed"] == []
    for r in rows.values():
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]


def test_cut_keeps_rows_and_columns(edge):
    out = S.cut_repeated(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[10] == "Start here and then it ends." and rows[6] == "   \n\t " and rows[5] is None


def test_keep_one(edge):
    kept = sorted((r["doc_id"], r["text"] or "") for r in J.keep_one(edge).collect() if r["doc_id"] is not None)
    ids = [i for i, _ in kept]
    assert 1 in ids and 2 not in ids and 3 not in ids and 11 not in ids and -17 in ids and 10 in ids and 7 in ids and 8 not in ids and 4 in ids and 5 in ids
    assert J.keep_one(edge).filter("doc_id is null").count() == 2


def test_repeated_ids_keep_one_row_of_each_component(spark):
    text = lambda name, end="": " ".join(f"{name}{i}" for i in range(60)) + end
    rows = [(5, text("a")), (5, text("b")), (3, text("b", " end")), (7, text("c")), (7, text("c", " end")), (8, text("d")), (8, text("d")), (None, text("a"))]
    got = [tuple(r) for r in J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((i or 0, t[0]) for i, t in got) == [(0, "a"), (3, "b"), (5, "a"), (7, "c"), (8, "d")]


def test_rows_that_differ_elsewhere_are_told_apart(spark):
    """Rows of one id and text with other columns: without words all stay, equal or not; of linked ones the first that is read."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(2, "", "u1"), (2, "", "u2"), (2, "", "u2"), (2, None, "u3"), (4, words, "u4"), (4, words, "u5"), (3, words + " end", "u6"), (9, "  ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").coalesce(1)
    got = sorted((tuple(r) for r in J.keep_one(df).collect()), key=repr)
    assert got == sorted([*rows[:4], rows[6], rows[7]], key=repr)
    same = J.keep_one(df.filter("doc_id = 4")).collect()
    assert [tuple(r) for r in same] == [rows[4]]
