"""Decontamination against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        if i is not None and n:
            for a in range(len(w) - n + 1):
                windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                g = tuple(w[a : a + n])
                if g in windows:
                    hit.update(range(a, a + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(out):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in out.collect()), key=repr)


ITEMS = [(1, "one two"), (2, "Shared3 shared4; shared5"), (3, " ".join(f"long{i}" for i in range(40))), (10, "one two"), (4, ""), (5, None), (None, "word1 word2"), (6, "日本語 тест"), (7, "two"), (1, "one two")]


@pytest.mark.parametrize("bits", [27, 16])
def test_edges(spark, edge, edge_rows, bits, monkeypatch):
    """With few bits and a full bitmap, far more places are joined; the result is the same."""
    monkeypatch.setattr(D, "MAX_BITS", bits)
    if bits == 16:
        real = D._bitmap
        monkeypatch.setattr(D, "_bitmap", lambda tokens, n: (np.full_like(real(tokens, n)[0], 255), 16))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("hits", F.lit(1))
    out = D.find_benchmark(edge, items)
    assert rows(out) == brute([r[:2] for r in edge_rows], ITEMS)
    clean = D.keep_clean(edge, items)
    bad = out.filter("contaminated").count()
    assert clean.columns == edge.columns and bad > 3 and clean.count() == edge.count() - bad
    assert rows(D.find_benchmark(edge, items.limit(0))) == brute([r[:2] for r in edge_rows], [])
    assert D.find_benchmark(edge.limit(0), items).count() == 0


def test_small_table(spark, sf_dir, documents, texts):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute(texts, [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert rows(D.find_benchmark(documents, benchmark)) == want and any(r[4] for r in want)


def test_hits_are_spans(spark, edge):
    items = spark.createDataFrame([(1, "shared2 shared3 shared4")], "item_id long, text string")
    r = D.find_benchmark(edge, items).filter("doc_id = 10").first()
    assert [(x["start"], x["end"]) for x in r["hits"]] == [(4, 7)] and r["item_ids"] == ["1"]


def test_words_are_compared(spark):
    """Words that have one value in every polynomial modulo 2^64, and words whose hash is made equal, are told apart."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    docs = spark.createDataFrame([(1, f"x {other} y"), (2, f"x {one} y")], "doc_id long, text string")
    items = spark.createDataFrame([("A", one)], "item_id string, text string")
    assert [r[2:4] for r in rows(D.find_benchmark(docs, items))] == [(0, ""), (1, "A")]


def test_equal_hashes_are_no_hit(spark, documents, texts, sf_dir, monkeypatch):
    """All shingles have one of 16 hashes: bounds and words alone decide."""
    monkeypatch.setattr(D, "_tokens", lambda w, k: D.W.windows(w, k) % np.uint64(16) << np.uint64(60))
    some = documents.limit(30)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(3)
    want = brute([(r["doc_id"], r["text"]) for r in some.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert rows(D.find_benchmark(some, benchmark)) == want
