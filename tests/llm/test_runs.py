"""Periodic runs against their definition: every period tried at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, exponent=3):
    """(start, length, period) by definition: stretches of words equal to those p before, p words added in front, each with its smallest p."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        at = p
        while at < n:
            to = at
            while to < n and words[to] == words[to - p]:
                to += 1
            if to > at and to - at + p >= max(least, exponent * p):
                found.setdefault((at - p, to), p)
            at = to + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@st.composite
def texts(draw):
    out = []
    for _ in range(draw(st.integers(0, 4))):
        block = draw(st.lists(st.integers(0, 2), min_size=1, max_size=5))
        inner = block * draw(st.integers(1, 8)) + draw(st.lists(st.integers(0, 3), max_size=2))
        out += inner * draw(st.integers(1, 4))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(texts(), max_size=4), st.sampled_from([(2, 2), (4, 2), (3, 3), (9, 3), (24, 3)]))
def test_runs_are_those_of_the_definition(some, limits):
    bounds = np.cumsum([0, *map(len, some)])
    got = runs.runs_of(np.array([x for t in some for x in t], np.int64), bounds, *limits).tolist()
    assert got == [[s + o, s + n + o, p] for t, o in zip(some, bounds.tolist()) for s, n, p in brute(t, *limits)]


def test_suffixes_and_previous_factors():
    rng = np.random.default_rng(4)
    some = [rng.integers(0, 2, 60).tolist(), [], [1] * 17, rng.integers(0, 9, 50).tolist() * 3]
    bounds = np.cumsum([0, *map(len, some)])
    s = runs.Suffixes.of(np.array(sum(some, []), np.int64), bounds)
    want = sorted((k, t[i:], i + bounds[k]) for k, t in enumerate(some) for i in range(len(t)))
    assert s.order.tolist() == [x[2] for x in want]
    length, source = s.previous_factors()
    common = lambda t, i, j: next((k for k in range(len(t) - i) if t[i + k] != t[j + k]), len(t) - i)
    for t, o in zip(some, bounds.tolist()):
        for i in range(len(t)):
            assert length[o + i] == max((common(t, i, j) for j in range(i)), default=0)
            assert not length[o + i] or common(t, i, source[o + i] - o) == length[o + i]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    from tessera.llm import words as W

    true, calls = W.Words.values, []

    def first_all_equal(self, base=W.FIXED.word[0]):
        calls.append(base)
        return np.zeros(len(self.start), np.uint64) if len(calls) == 1 else true(self, base)

    monkeypatch.setattr(W.Words, "values", first_all_equal)
    text = b"longer-than-seven another-long-one longer-than-seven"
    numbers = runs.exact_numbers(W.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]), W.SPACE, False))
    assert len(calls) == 2 and numbers[0] == numbers[2] != numbers[1]


def test_whole_table(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    with_runs = 0
    for i, text in texts:
        words = planted(i, WORD.findall(text or ""))
        # Runs of three periods hold words that return after each period: most texts have none, and their longest repeat is short.
        found = brute(words) if len(words) < 1500 else runs_by_hash(words)
        with_runs += bool(found)
        r = got[i]
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        if found:
            s, n, p = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, p, 1000 * n // p)
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
    assert with_runs > 5


def runs_by_hash(words):
    """``brute`` for long texts, by comparing arrays."""
    x = np.unique(words, return_inverse=True)[1]
    found = {}
    for p in range(1, len(x) // 3 + 1):
        same = np.r_[False, x[p:] == x[:-p], False].astype(np.int8)
        turn = np.flatnonzero(np.diff(same))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a + p >= max(24, 3 * p):
                found.setdefault((a, b + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.fixture(scope="module")
def edge_result(edge):
    return runs.periodic_runs(edge).collect()


def test_edges(edge_rows, edge_result, edge):
    want = []
    for i, t, *_ in edge_rows:
        words = WORD.findall(t or "")
        found = brute(words) if len(words) < 1000 else runs_by_hash(words)
        want.append((i, len(words), found, collapsed(words, found)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in edge_result]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(edge.limit(0)).count() == 0
    assert runs.periodic_runs(edge, least=6).filter("doc_id = 7").first()["runs"] == []


def test_one_word_and_one_long_period(spark):
    long = [f"w{i}" for i in range(9000)]
    rows = [(1, "a " * 50_000), (2, " ".join(long * 3 + long[:10])), (3, " ".join(["x"] * 23)), (4, " ".join(["x"] * 24))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    got = {r["doc_id"]: r for r in runs.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 50_000, 1)] and got[1]["collapsed_text"] == "a"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 27_010, 9000)] and got[2]["collapsed_text"] == " ".join(long)
    assert got[3]["runs"] == [] and got[4]["collapsed_text"] == "x"


def test_strongest_compares_exactly(spark):
    rows = [(1, [(0, 10**15 + 1, 10**7), (5, 10**8, 1), (7, 10**8, 1)]), (2, [(0, 30, 10), (1, 33, 11)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id long, runs array<struct<start:long,length:long,period:long>>")
    got = {r["id"]: r["best"] for r in df.select("id", runs.strongest(F.col("runs")).alias("best")).collect()}
    assert tuple(got[1]) == (0, 10**15 + 1, 10**7) and tuple(got[2]) == (0, 30, 10) and got[3] is None and got[4] is None
