"""Chunking, ingestion, layout and sources on fixtures of our own."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import ingest as I
from tessera.operators import layout as L
from tessera.sources import files as S
from tessera.sources.store import Store

DOC = """---
doc_id: guide
title: "Field Guide"
category: leave
version: 2
---
# Field Guide

Opening words.

## Rivers

{rivers}

### Banks

Short.

## Hills

| a | b |
|---|---|
| 1 | 2 |
"""


HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")


def tokens(s):
    return max(1, round(len(s) / 4))


def expected_sections(body, title):
    """By definition: a line of text belongs to the headings above it that no later heading of the same or a higher level ends."""
    lines = body.splitlines()
    heads = {i: (len(m[1]), m[2]) for i, m in ((i, HEADING.match(x)) for i, x in enumerate(lines)) if m}
    first = min((i for i in heads), default=len(lines))
    while first in heads and heads[first][0] == 1 and heads[first][1].lower() == title.lower():
        del heads[first]  # a title line
        del lines[first]
        heads = {i - (i > first): h for i, h in heads.items()}
        first = min(heads, default=len(lines))
    open_at = lambda i: [h for h in sorted(heads) if h < i and not any(h < g < i and heads[g][0] <= heads[h][0] for g in heads)]
    groups = {}
    for i, line in enumerate(lines):
        if i not in heads:
            groups.setdefault(max((h for h in heads if h < i), default=-1), []).append((i, line))
    texts = [([heads[h][1] for h in open_at(rows[0][0])], "\n".join(x for _, x in rows).strip()) for _, rows in sorted(groups.items())]
    return [(path, text) for path, text in texts if text]


def expected_merge(sections, least):
    """By definition: the first and the larger sections stay; any other goes to the nearest of these before it whose path begins its own, else to the last."""
    stay = [i for i, (_, t) in enumerate(sections) if i == 0 or tokens(t) >= least]
    goes = {i: max([k for k in stay if k < i and sections[i][0][: len(sections[k][0])] == sections[k][0]] or [max(k for k in stay if k < i)]) for i in range(len(sections)) if i not in stay}
    labelled = lambda i: f"**{sections[i][0][-1]}:** {sections[i][1]}" if sections[i][0] else sections[i][1]
    return [(sections[k][0], "\n\n".join([sections[k][1], *(labelled(i) for i in sorted(goes) if goes[i] == k)])) for k in stay]


def test_sections_and_merging(spark):
    """Some hundred small documents at once: headings of any level, titles, repeated names, short sections."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(15)):
            n, text = rng.randrange(5), "".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 3, 3, 12, 30])))
            lines.append(("#" * n + " " if n else "") + text)
        heading = next((i for i, x in enumerate(lines) if x.startswith("#")), None)
        if heading and rng.random() < 0.5:
            lines[heading] = "# abc"
            lines[:heading] = []
        rows.append(("\n".join(lines), "ABC", rng.randrange(1, 7)))
    df = spark.createDataFrame(rows, "body string, title string, least int")
    parts = C.sections(F.col("body"), F.col("title"))
    for r in df.select("*", parts.alias("s"), C.merge_small(parts, F.col("least")).alias("m")).collect():
        want = expected_sections(r["body"], r["title"])
        assert [(list(p["path"]), p["text"]) for p in r["s"]] == want, r["body"]
        assert [(list(p["path"]), p["text"]) for p in r["m"]] == expected_merge(want, r["least"]), r["body"]


def test_repeated_header_keys(spark):
    text = "---\ndoc_id: a\ntitle: one\ncategory: leave\ntitle: 'two'\ndoc_id: a\n---\nbody"
    chunks, refused = C.chunk_markdown(spark.createDataFrame([(text,)], "markdown string"))
    assert [(r["doc_id"], r["title"]) for r in chunks.collect()] == [("a", "two")] and refused.count() == 0


@pytest.mark.parametrize("title", ["a\u2028b", "a\u2029", "\x85a", "a\x0bb", "a\x0cb", "a\x1cb", "a\rb", "'a\u2028b'", ""])
def test_no_header_fails_the_job(spark, title):
    """Line ends of every kind in a value, and a key without one; rows that follow are chunked all the same."""
    odd = f"---\ndoc_id: x\ntitle: {title}\ncategory: leave\nempty:\n: no key\n\u2028: odd\n---\nbody"
    fine = "---\ndoc_id: y\ntitle: t\ncategory: leave\n---\nbody"
    chunks, refused = C.chunk_markdown(spark.createDataFrame([(odd,), (fine,)], "markdown string"))
    assert sorted(r["doc_id"] for r in chunks.collect()) == ["x", "y"] and refused.count() == 0
    assert chunks.filter("doc_id = 'x'").first()["title"] == title.strip(" \x0b\x0c\r").strip("'")


def test_ingest_runs(spark, tmp_path):
    """Four runs: all new, nothing to do, one changed and one gone, and forced; and the three errors."""
    raw, store = tmp_path / "raw", f"file://{tmp_path}/store"
    raw.mkdir()
    with pytest.raises(ValueError, match="no source documents"):
        S.ingest(spark, str(raw), store)
    page = lambda k, body: f"---\ndoc_id: {k}\ntitle: Page {k}\ncategory: leave\n---\n{body}\n"
    for k in "abc":
        (raw / f"{k}.md").write_text(page(k, f"Words of {k}."))
    day = datetime.datetime(2024, 5, 6, 7, 8)
    status = lambda **o: {r["name"]: r["status"] for r in S.ingest(spark, str(raw), store, {"embedding_model": "m", "embedding_dim": 3}, now=day, **o).collect()}
    kept = Store(spark, store)
    rows = lambda: {r["name"]: (r["doc_id"], r["chunk_count"]) for r in S.load_manifest(kept).collect()}
    texts = lambda: {r["doc_id"]: r["text"] for r in kept.read("chunks").collect()}
    assert status() == {f"{k}.md": "new" for k in "abc"}
    header = kept.properties()
    assert (header["embedding_model"], header["embedding_dim"], header["files"], header["total_chunks"], header["ingested_at"][:16]) == ("m", 3, 3, 3, "2024-05-06T07:08")
    assert rows() == {f"{k}.md": (k, 1) for k in "abc"}
    assert status() == {f"{k}.md": "unchanged" for k in "abc"} and len(texts()) == 3
    (raw / "a.md").write_text(page("a", "Other words."))
    (raw / "b.md").unlink()
    assert status() == {"a.md": "changed", "b.md": "deleted", "c.md": "unchanged"}
    assert {k: t.split("\n\n")[1] for k, t in texts().items()} == {"a": "Other words.", "c": "Words of c."} and set(rows()) == {"a.md", "c.md"}
    pages = {r["doc_id"]: r["markdown"] for r in kept.read("documents").collect()}
    assert set(pages) == {"a", "c"} and "source_file: a.md" in pages["a"] and "Other words." in pages["a"]
    assert status(force=True) == {"a.md": "changed", "c.md": "changed"} and len(texts()) == 2
    for name, content, error in (("d.md", page("d", ""), "no chunks"), ("d.md", "no header", "missing header"), ("d.docx", "broken", "cannot be read")):
        (raw / name).write_text(content)
        (raw / "d.meta.yaml").write_text("title: d")
        with pytest.raises(ValueError, match=error):
            S.ingest(spark, str(raw), store)
        (raw / name).unlink()
    assert set(rows()) == {"a.md", "c.md"}


def test_broken_pdf_is_reported_not_raised(spark, tmp_path):
    def open_pdf(stream):
        raise OSError("not a pdf")

    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "a.meta.yaml").write_text("title: a")
    (tmp_path / "b.md").write_text("# fine")
    assert {r["name"]: r["error"] for r in S.parse_corpus(S.scan_corpus(spark, str(tmp_path)), open_pdf).collect()} == {"a.pdf": "cannot be read here", "b.md": None}


def test_report(spark, tmp_path):
    at = S.write_report(spark.createDataFrame([(0.5,)], "mrr double"), spark.createDataFrame([(1, None)], "id int, first_rank int"), str(tmp_path), now=datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert at.endswith("retrieval_eval_20240102T030405Z") and spark.read.json(f"{at}/metrics").first()["mrr"] == 0.5 and spark.read.json(f"{at}/per_question").count() == 1


def test_chunk_markdown(spark):
    text = DOC.format(rivers=" ".join(f"Sentence {i} about water." for i in range(150)))
    rows = spark.createDataFrame([(text,), ("no header",), ("---\ndoc_id: x\ntitle: t\ncategory: zoo\n---\nb",)], "markdown string")
    chunks, refused = C.chunk_markdown(rows)
    found = chunks.orderBy("chunk_id").collect()
    assert [c["chunk_id"] for c in found] == [f"guide#{i:03d}" for i in range(len(found))]
    assert all(c["text"].startswith(f"Field Guide > {c['section_path']}\n\n") and c["version"] == "2" for c in found)
    assert found[0]["section_path"] == "General" and any("**Banks:** Short." in c["text"] for c in found)
    assert any("| 1 | 2 |" in c["text"] for c in found)
    assert sorted(r["errors"][0] for r in refused.collect()) == ["missing header", "unknown category"]


@pytest.mark.parametrize(("force", "want"), [(False, "unchanged"), (True, "changed")])
def test_plan_changes(spark, force, want):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, sha256 string")
    plan = {r["name"]: r["status"] for r in I.plan_changes(now, before, force).collect()}
    assert plan == {"a": want, "b": "changed", "c": "new", "d": "deleted"}


def test_replace_and_manifest(spark):
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, n int")
    new = spark.createDataFrame([("a", 7)], "doc_id string, n int")
    touched = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert [tuple(r) for r in I.replace_documents(chunks, new, touched).collect()] == [("a", 7)]
    assert I.delete_documents(chunks, touched.filter("doc_id = 'a'")).count() == 1
    manifest = spark.createDataFrame([("x", "1", "a", "a.md", 3), ("y", "2", "b", "b.md", 4)], I.MANIFEST)
    plan = spark.createDataFrame([("y", "deleted"), ("x", "changed")], "name string, status string")
    after = I.next_manifest(manifest, plan, spark.createDataFrame([("x", "9", "a", "a.md", 5)], I.MANIFEST))
    assert [tuple(r) for r in after.collect()] == [("x", "9", "a", "a.md", 5)]
    assert I.manifest_totals(manifest.limit(0)).first()["total_chunks"] == 0


def test_pdf_keeps_headings_and_tables(spark, tmp_path):
    """A stand-in for the pdf library, which is not installed here: two pages with a title, a table, paragraphs, a footer and page numbers."""

    def open_pdf(stream):
        from contextlib import contextmanager
        from types import SimpleNamespace as N

        def line(text, top, size=10.0, font="Times"):
            return {"text": text, "top": top, "bottom": top + size, "chars": [{"size": size, "fontname": font} for _ in text]}

        table = N(bbox=(0, 200, 100, 240), extract=lambda: [["Plan", "Days"], ["Basic", None], [None, " "], ["Long\nterm", "30"]])
        first = [line("Travel Policy", 100, 20.0), line("Plans are listed in the fol-", 140), line("lowing table for all.", 152), line("Plan Days", 205), line("Basic", 220), line("Applies to everyone here.", 260), line("ACME internal", 760), line("Page 1 of 3", 775)]
        second = [line("Refunds", 100, 14.0), line("Refunds take a week.", 130), line("Run-in title", 150, font="Times-Bold"), line("Ask the desk.", 164), line("acme internal", 760), line("2", 775)]
        pages = [(first, [table]), (second, []), ([], [])] if stream.read() == b"full" else [([], [])]

        @contextmanager
        def opened():
            yield N(pages=[N(height=800, extract_text_lines=lambda return_chars, x=x: x, find_tables=lambda t=t: t) for x, t in pages])

        return opened()

    for name, content in (("a", b"full"), ("b", b"blank"), ("c", b"full")):
        (tmp_path / f"{name}.pdf").write_bytes(content)
    for name in ("a", "b"):
        (tmp_path / f"{name}.meta.yaml").write_text(f"title: {name}\n")
    (tmp_path / "d.md").write_text("# As it is\n")
    rows = {r["name"]: r for r in S.parse_corpus(S.scan_corpus(spark, str(tmp_path)), open_pdf).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"a.pdf": None, "b.pdf": None, "c.pdf": "missing sidecar", "d.md": None}
    text = rows["a.pdf"]["markdown"].split("---\n", 2)[2].strip()
    table = "| Plan | Days |\n| --- | --- |\n| Basic |  |\n| Long term | 30 |"
    assert text.split("\n\n") == ["# Travel Policy", "Plans are listed in the following table for all.", table, "Applies to everyone here.", "## Refunds", "Refunds take a week.", "### Run-in title", "Ask the desk."]
    assert "title: b" in rows["b.pdf"]["markdown"] and "As it is" in rows["d.md"]["markdown"]


def test_corpus_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text(DOC.format(rivers="Wide re-\nport."))
    (tmp_path / "b.docx").write_bytes(b"not really")
    (tmp_path / "notes.txt").write_text("ignored")
    files = S.scan_corpus(spark, str(tmp_path))
    assert sorted(r["name"] for r in files.collect()) == ["a.md", "b.docx"]
    rows = {r["name"]: r for r in S.parse_corpus(files).collect()}
    assert "source_file: a.md" in rows["a.md"]["markdown"] and "Wide report." in rows["a.md"]["markdown"]
    assert rows["b.docx"]["error"] == "missing sidecar"
    assert S.load_manifest(Store(spark, f"file://{tmp_path}/none")).count() == 0
    (tmp_path / "p.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert [r["id"] for r in S.read_json_lines(spark, f"{tmp_path}/p.jsonl", "id string").filter("id is not null").collect()] == ["1", "2"]


def test_render(spark):
    def line(page, text, top, size=10.0, bold=False):
        return ("d", page, text, float(top), float(top) + 10, size, bold, 200.0)

    rows = [
        line(0, "Company News", 2), line(1, "Company News", 2), line(2, "company news", 2), line(0, "Page 1 of 3", 190),
        line(0, "Big Title", 30, 16.0), line(0, "The first para-", 50), line(0, "graph goes on.", 62), line(0, "A second one", 90), line(0, "Run-in head", 110, 10.0, True),
        line(0, "under it", 122), line(1, "next page", 40), line(1, "Middle", 60, 13.0), line(2, "Small", 60, 12.0), line(2, "Smaller", 80, 11.0), line(2, "end.", 100),
    ]
    lines = spark.createDataFrame(rows, "doc string, page int, text string, top double, bottom double, size double, bold boolean, height double")
    tables = spark.createDataFrame([("d", 1, 75.0, "| a |\n| --- |")], "doc string, page int, top double, markdown string")
    kept = L.drop_chrome(lines)
    assert kept.filter("lower(text) like 'company%' or text like 'Page%'").count() == 0
    text = L.render(kept, tables).first()["markdown"]
    assert text == "# Big Title\n\nThe first paragraph goes on.\n\nA second one\n\n### Run-in head\n\nunder it\n\nnext page\n\n## Middle\n\n| a |\n| --- |\n\n### Small\n\n### Smaller\n\nend.\n"
    boxes = spark.createDataFrame([("d", 0, 48.0, 70.0)], "doc string, page int, top double, bottom double")
    assert {r["text"] for r in kept.join(L.outside_tables(kept, boxes).select("text"), "text", "left_anti").collect()} == {"The first para-", "graph goes on."}


def test_lines_of_characters_and_tables(spark):
    chars = [("d", 0, 0, i, c, 1.0, 11.0, 10.2, "Arial-Bold" if i < 2 else "Arial", 100.0) for i, c in enumerate("Hey ")]
    row = L.line_rows(spark.createDataFrame(chars, "doc string, page int, line int, pos int, char string, top double, bottom double, size double, font string, height double")).first()
    assert (row["text"], row["size"], row["bold"]) == ("Hey", 10.0, True)
    table = spark.createDataFrame([([["h", None], [" ", ""], ["a\nb", "c", "d"]],), ([[None]],)], "rows array<array<string>>")
    assert [r[0] for r in table.select(L.table_markdown(F.col("rows"))).collect()] == ["| h |  |  |\n| --- | --- | --- |\n| a b | c | d |", ""]


def test_lines_of_documents_are_made_without_a_shuffle(spark, tmp_path):
    from tessera.plans.document_queries import QUERIES

    wide = chr(0x1F600)
    spark.createDataFrame([(1, f"a{wide}b \n\nsecond\n"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["character_lines"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert {(r["doc"], r["line"]): (r["text_sha256"], r["size"]) for r in found.collect()} == {(1, 0): (sha(f"a{wide}b"), 9.0), (1, 2): (sha("second"), 11.0)}


def test_lines_from_rows_and_from_arrays_of_characters_agree(spark):
    rng = random.Random(5)
    chars = [(d, p, n, i, rng.choice("ab "), rng.random(), 2 + rng.random(), rng.choice([None, 0.0, 9.0, 10.5, 12.0]), rng.choice([None, "X", "X-BOLD"]), 50.0) for d in "de" for p in range(2) for n in range(30) for i in range(rng.randrange(1, 9))]
    rng.shuffle(chars)
    rows = spark.createDataFrame(chars, "doc string, page int, line int, pos int, char string, top double, bottom double, size double, font string, height double")
    sorted_ = rows.groupBy("doc", "page", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "char", "size", "font"))).alias("c"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.first("height").alias("height"))
    lines = sorted_.select("doc", "page", "line", F.col("c.char").alias("chars"), F.col("c.size").alias("sizes"), F.col("c.font").alias("fonts"), "top", "bottom", "height")
    by = lambda df: sorted(tuple(r) for r in df.select("doc", "page", "line", "text", "top", "bottom", "size", "bold", "height").collect())
    assert by(L.lines_of(lines)) == by(L.line_rows(rows))


def test_an_ingest_run_chunks_each_document_once(spark, sf_dir):
    from tessera.plans.document_queries import QUERIES

    plan = QUERIES["ingest_run"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "Generate" not in plan


def test_what_becomes_of_files_is_told_by_the_file(spark):
    text = lambda doc, body, category="leave": f"---\ndoc_id: {doc}\ntitle: T\ncategory: {category}\n---\n{body}"
    files = [("a", text("x", "Some words."), None), ("b", text("x", "# H\n\nMore words.\n"), None), ("c", text("x", " \n"), None), ("d", text("y", "Words", "z"), None), ("e", "Words", None), ("f", None, "cannot be read here"), ("g", "---\ntitle: T\n---\nWords", None)]
    parsed = spark.createDataFrame([(n, n, m, e) for n, m, e in files], "name string, sha256 string, markdown string, error string")
    times = []
    chunks, rows, errors = I.ingested(parsed, lambda df: times.append(1) or df.cache())
    assert {r["name"]: (r["doc_id"], r["chunk_count"]) for r in rows.collect()} == {"a": ("x", 1), "b": ("x", 1)} and len(times) == 1 and chunks.count() == 2
    assert {r["name"]: r["error"] for r in errors.collect()} == {"c": "no chunks", "d": "unknown category", "e": "missing header", "f": "cannot be read here", "g": "missing doc_id, missing category"}
    assert "Exchange" not in I.outcomes(parsed)._jdf.queryExecution().executedPlan().toString()
