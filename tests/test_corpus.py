"""The corpus as a data source: rows of a batch, parts, filters, and a stream over restarts."""

import os

from tessera.sources import corpus as C
from tessera.sources import files as S


def folder(tmp_path):
    at = tmp_path / "raw"
    (at / "below").mkdir(parents=True)
    for name, text in {"a.md": "# A", "b.MD": "# B" * 100, "b.meta.yaml": "title: b", "c.docx": "x", "c.meta.yaml": "title: c", "note.txt": "n", "below/d.md": "# D", "noend": "z"}.items():
        (at / name).write_text(text)
    return at


def rows(df):
    return sorted((r["name"], r["kind"], bytes(r["content"]), r["sidecar"] and bytes(r["sidecar"]), r["sha256"]) for r in df.collect())


def test_batch_reads_what_the_scan_reads(spark, tmp_path):
    at = folder(tmp_path)
    C.register(spark)
    for path in (str(at), f"file://{at}"):
        df = spark.read.format("corpus").option("partBytes", 50).load(path)
        assert rows(df) == rows(S.scan_corpus(spark, str(at))) and df.rdd.getNumPartitions() == 3
    assert rows(df.filter("name = 'a.md' and length(content) > 1")) == rows(df)[:1] and df.filter("name = 'zz'").count() == 0 and df.count() == 3
    some = spark.read.format("corpus").option("names", "[ab]*").load(str(at))
    assert [r["name"] for r in some.collect()] == ["a.md", "b.MD"] and some.rdd.getNumPartitions() == 1
    assert spark.read.format("corpus").option("names", "none*").load(str(at)).count() == 0
    parsed = {r["name"]: r["error"] for r in S.parse_corpus(df, pdf=False).collect()}
    assert parsed == {"a.md": None, "b.MD": None, "c.docx": "cannot be read here"}


def test_parts():
    sized = [C.Found(str(i), None, n, "") for i, n in enumerate([5, 5, 1, 30, 2, 2])]
    assert [[int(f.name) for f in p.files] for p in C.packed(sized, 10)] == [[0, 1], [2], [3], [4, 5]]


def test_stream_gives_changed_documents_again(spark, tmp_path):
    at = folder(tmp_path)
    C.register(spark)
    seen = []

    def run():
        """A query of its own that goes on from the checkpoint."""
        del seen[:]
        stream = spark.readStream.format("corpus").load(str(at))
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r["name"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(seen)

    assert run() == ["a.md", "b.MD", "c.docx"]
    assert run() == []
    os.utime(at / "a.md", (1, 1))  # touched, not changed
    assert run() == []
    (at / "b.meta.yaml").write_text("title: bb")
    (at / "e.md").write_text("# E")
    (at / "c.docx").unlink()
    assert run() == ["b.MD", "e.md"]
    (at / "a.md").write_text("# AA")
    assert run() == ["a.md"]
