"""The pipeline's stages on the small table and on edge rows, against brute force: each acts on all that the one before kept."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_benchmark import brute as brute_benchmark
from test_duplicates import brute_components, brute_cut

from tessera.llm import bpe, decontamination, jaccard, toxicity

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))) if t}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def kept_words(rows):
    """Texts without the 13-word windows that also start under a smaller id; those that lose nothing stay as they are."""
    least, out = {}, []
    split = [(i, t, re.findall(WORD, t or "")) for i, t in rows]
    for i, _, w in split:
        for a in range(len(w) - 12) if i is not None else ():
            g = tuple(w[a : a + 13])
            least[g] = min(least.get(g, i), i)
    for i, t, w in split:
        gone = {b for a in range(len(w) - 12) if i is not None and least[tuple(w[a : a + 13])] < i for b in range(a, a + 13)}
        out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone) if gone else t))
    return out


def brute(rows, benchmark, library, rejected=lambda i, t: False):
    rows = [r for r in rows if not rejected(*r)]
    named = [(n, t) for n, (i, t) in enumerate(rows) if i is not None]
    component = {n: c for n, _, c in brute_components(named)}
    kept = {}
    for n, _ in named:
        kept[component[n]] = min(kept.get(component[n], (rows[n][0], n)), (rows[n][0], n))
    one = list(dict.fromkeys(rows[n] for _, n in sorted(kept.values(), key=lambda x: x[1])))
    rows = kept_words([*one, *((i, t) for i, t in rows if i is None)])
    dirty = {r[0] for r in brute_benchmark([(n, t) for n, (_, t) in enumerate(rows)], benchmark) if r[4]}
    out = []
    for n, (i, t) in enumerate(rows):
        if n not in dirty:
            ids = np.array(library.encode_ordinary(t or ""), "<u4")
            out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()), key=repr)


def write(spark, at, docs, benchmark, labels):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


BENCHMARK = [(1, "two three"), (2, " ".join(f"long{i}" for i in range(40))), (3, None), (None, "word1 word2"), (4, "")]


def test_edge_rows_against_brute_force(spark, tmp_path, edge, edge_rows, library):
    """Null and repeated ids and texts, empty and very long texts, copies, near copies and columns named as ours are, without labels to learn from."""
    at = write(spark, tmp_path / "edge", edge, BENCHMARK, [])
    want = brute([r[:2] for r in edge_rows], BENCHMARK, library)
    assert result(corpus_pipeline.run(spark, at)) == want
    assert 8 < len(want) < len(edge_rows)
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, at)
        assert name == "byte_level_bpe" or docs.schema.simpleString() == before.schema.simpleString()
        docs.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    assert result(docs) == want


def test_empty_tables(spark, tmp_path, edge, edge_rows, library):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", edge.limit(0), BENCHMARK, [(1, 0, 1)])).count() == 0
    at = write(spark, tmp_path / "clean", edge, [], [(1, 0, None), (None, 1, 1)])
    assert result(corpus_pipeline.run(spark, at)) == brute([r[:2] for r in edge_rows], [], library)


def test_whole_run_against_brute_force(spark, sf_dir, documents, library):
    """All stages on the small table; which documents are toxic is taken from the operator, whose scores have a test of their own."""
    toxic = {r["doc_id"] for r in toxicity.toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert result(corpus_pipeline.run(spark, sf_dir)) == brute(rows, benchmark, library, lambda i, t: i in toxic)


def test_stages(spark, tmp_path, library):
    sf_dir = "/root/testdata/sf0.01"  # the smallest with enough labels to learn from
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert documents.count() > kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] > documents.count() / 2
    read = lambda n: spark.read.parquet(str(tmp_path / corpus_pipeline.STAGES[n][0]))
    groups = jaccard.near_duplicates(read(0)).select("component_id").distinct()
    assert kept[1] == groups.count()
    words = lambda t: len(re.findall(WORD, t or ""))
    longer = {r["doc_id"]: words(r["text"]) for r in read(1).collect()}
    assert all(words(r["text"]) <= longer[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in read(2).collect())
    assert {(r["doc_id"], len(re.findall(WORD, r["text"] or ""))) for r in read(2).collect()} == {(i, n - gone) for i, n, gone, _ in brute_cut([(r["doc_id"], r["text"]) for r in read(1).collect()])}
    assert decontamination.find_benchmark(read(3), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").count() == 0
    texts = {r["doc_id"]: r["text"] for r in read(3).collect()}
    assert all(r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]])) for r in docs.collect())
