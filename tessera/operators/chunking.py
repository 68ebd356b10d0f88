"""Section-aware chunking of Markdown documents: headings to sections, small sections merged, sections packed to chunks.

Each step works on array columns, so a document is one row until its chunks are exploded and nothing is shuffled; see ``functions.text`` for the folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lines, scan, split_text, strip, token_estimate

TARGET, OVERLAP, SMALLEST = 400, 50, 80
# What is a heading and what is a header.
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
HEADER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
# The categories a document may have.
CATEGORIES = ["leave", "benefits", "payroll", "conduct", "complaints", "onboarding", "labor_law"]


# A key and its value; a value may hold any character but LF.
_FIELD = r"(?s)\A([^:#\s][^:]*):\s*(.*?)\s*\z"


def header_of(markdown: Column) -> Column:
    """The header's keys as a map; null without a header. Flat ``key: value`` lines; one pair of quotes around a value goes; of a repeated key the last counts."""
    inner = F.filter(F.split(F.regexp_extract(markdown, HEADER, 1), "\n"), lambda x: x.rlike(_FIELD))
    value = lambda x: F.regexp_replace(F.regexp_extract(x, _FIELD, 2), r"(?s)\A(['\"])(.*)\1\z", "$2")
    entries = F.transform(inner, lambda x: F.struct(strip(F.regexp_extract(x, _FIELD, 1)).alias("k"), value(x).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.when(markdown.rlike(HEADER), F.map_from_entries(last))


def body_of(markdown: Column) -> Column:
    return F.regexp_replace(markdown, HEADER, "")


def header_errors(header: Column, categories: list[str] = CATEGORIES) -> Column:
    """What keeps a document from being ingested; empty if nothing does."""
    missing = [F.when(header[k].isNull(), F.lit(f"missing {k}")) for k in ("doc_id", "title", "category")]
    unknown = F.when(header["category"].isNotNull() & ~header["category"].isin(categories), F.lit("unknown category"))
    return F.when(header.isNull(), F.array(F.lit("missing header"))).otherwise(F.array_compact(F.array(*missing, unknown)))


def sections(body: Column, title: Column) -> Column:
    """array<struct<path, text>>: text between headings with the headings above it; sections without text are left out.

    Level-1 headings equal to the title, before any other heading, are the document's title lines. Headings are found first; what is above each is kept
    as one name for each level, and a section's lines are joined once.
    """

    def headings(all_lines: Column) -> Column:
        one = lambda x, i: F.when(x.startswith("#"), F.struct(i.alias("at"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), strip(F.regexp_extract(x, HEADING, 2)).alias("name")))
        return F.filter(F.transform(all_lines, one), lambda h: h.isNotNull() & (h["level"] > 0))

    def without_titles(found: Column) -> Column:
        other = F.array_position(F.transform(found, lambda h: (h["level"] > 1) | (F.lower(h["name"]) != F.lower(title))), True)
        return F.when(other == 0, F.slice(found, 1, 0)).otherwise(F.slice(found, other.cast("int"), F.size(found)))

    def paths(found: Column) -> Column:
        def step(above: Column, h: Column) -> Column:
            now = F.transform(above, lambda name, k: F.when(k + 1 < h["level"], name).when(k + 1 == h["level"], h["name"]))
            return let(now, lambda names: F.struct(names.alias("state"), F.array_compact(names).alias("out")))  # six names at most

        return scan(found, F.array_repeat(F.lit(None).cast("string"), 6), step, "array<string>")

    def cut(all_lines: Column, found: Column, above: Column) -> Column:
        until = lambda k: F.coalesce(F.try_element_at(found, k + 1)["at"], F.size(all_lines))
        joined = lambda some: strip(F.array_join(some, "\n"))
        opening = F.filter(F.slice(all_lines, F.lit(1), until(F.lit(0))), lambda x: ~x.rlike(HEADING))
        first = F.struct(F.array().cast("array<string>").alias("path"), joined(opening).alias("text"))
        rest = F.transform(found, lambda h, k: F.struct(above[k].alias("path"), joined(F.slice(all_lines, h["at"] + 2, until(k + 1) - h["at"] - 1)).alias("text")))
        return F.filter(F.concat(F.array(first), rest), lambda s: s["text"] != "")

    return let(lines(body), lambda all_lines: let(without_titles(headings(all_lines)), lambda found: let(paths(found), lambda above: cut(all_lines, found, above))))


def merge_small(parts: Column, smallest: Column | int = SMALLEST) -> Column:
    """Sections under ``smallest`` tokens, but for the first, go to the nearest kept one before whose path begins theirs, else to the last kept.

    Kept sections by their path and small ones by each beginning of theirs are sorted together; in that order a small one comes right after the kept one that it asks for.
    """
    smallest = F.lit(smallest) if isinstance(smallest, int) else smallest

    def targets(p: Column, small: Column) -> Column:
        """(at, into) of every small section, ``into`` the number of a kept one or null."""
        entry = lambda path, i, asks: F.struct(path.alias("path"), i.alias("at"), F.lit(asks).alias("asks"))
        asked = lambda x, i: F.transform(F.sequence(F.lit(0), F.size(x["path"])), lambda m: entry(F.slice(x["path"], F.lit(1), m), i, True))
        entries = F.array_sort(F.flatten(F.transform(p, lambda x, i: F.when(small[i], asked(x, i)).otherwise(F.array(entry(x["path"], i, False))))))

        def step(last: Column, e: Column) -> Column:
            answer = F.struct(e["at"].alias("at"), F.when(e["asks"] & (last["path"] == e["path"]), last["at"]).alias("into"), e["asks"].alias("asks"))
            return F.struct(F.when(e["asks"], last).otherwise(F.struct(e["path"].alias("path"), e["at"].alias("at"))).alias("state"), answer.alias("out"))

        none = F.lit(None).cast("struct<path:array<string>,at:int>")
        answers = F.array_sort(F.filter(scan(entries, none, step, "struct<at:int,into:int,asks:boolean>"), lambda a: a["asks"]))
        # Of each small section the last answer is the greatest; nulls come first.
        return let(answers, lambda found: F.filter(found, lambda a, k: F.coalesce(F.try_element_at(found, k + 2)["at"] != a["at"], F.lit(True))))

    def merged(p: Column, small: Column, found: Column) -> Column:
        own = F.filter(F.transform(p, lambda x, i: F.when(~small[i], F.struct(i.alias("into"), i.alias("at"), x["text"].alias("text")))), lambda x: x.isNotNull())

        def added(a: Column, before: Column) -> Column:
            part = p[a["at"]]
            label = F.coalesce(F.try_element_at(part["path"], F.lit(-1)), F.lit(""))
            text = F.when(label != "", F.concat(F.lit("**"), label, F.lit(":** "), part["text"])).otherwise(part["text"])
            return F.struct(F.coalesce(a["into"], before[a["at"]]).alias("into"), a["at"].alias("at"), text.alias("text"))

        kept_before = scan(F.transform(small, lambda x, i: F.when(~x, i)), F.lit(0), lambda n, i: let(F.coalesce(i, n), lambda k: F.struct(k.alias("state"), k.alias("out"))), "int")
        pieces = F.array_sort(F.concat(own, let(kept_before, lambda before: F.transform(found, lambda a: added(a, before)))))

        def joined(all_: Column, begins: Column) -> Column:
            to = lambda k: F.coalesce(F.try_element_at(begins, k + 2), F.size(all_))
            text = lambda b, k: F.array_join(F.transform(F.slice(all_, b + 1, to(k) - b), lambda x: x["text"]), "\n\n")
            return F.transform(begins, lambda b, k: F.struct(p[all_[b]["at"]]["path"].alias("path"), text(b, k).alias("text")))

        begins = lambda all_: F.filter(F.transform(all_, lambda x, k: F.when(x["at"] == x["into"], k)), lambda k: k.isNotNull())
        return let(pieces, lambda all_: let(begins(all_), lambda b: joined(all_, b)))

    def all_(p: Column) -> Column:
        small = F.transform(p, lambda x, i: (i > 0) & (token_estimate(x["text"]) < smallest))
        return let(small, lambda s: F.when(~F.exists(s, lambda x: x), p).otherwise(let(targets(p, s), lambda found: merged(p, s, found))))

    return let(parts, all_)


def pieces(body: Column, title: Column, target: int = TARGET, overlap: int = OVERLAP, smallest: int = SMALLEST) -> Column:
    """array<struct<path, piece>>: what the chunks of a document are made of, in order."""

    def cut(part: Column) -> Column:
        path = F.when(F.size(part["path"]) == 0, F.lit("General")).otherwise(F.array_join(part["path"], " > "))
        return F.transform(split_text(part["text"], target, overlap), lambda p: F.struct(path.alias("path"), p.alias("piece")))

    return F.flatten(F.transform(merge_small(sections(body, title), smallest), cut))


def chunk(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP, smallest: int = SMALLEST) -> DataFrame:
    """Chunks of documents (doc_id, title, category, body and, if present, effective_date, version), each under a line of title and path."""
    for name in ("effective_date", "version"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(""))
    rows = docs.select("doc_id", "title", "category", "effective_date", "version", F.posexplode(pieces(F.col("body"), F.col("title"), target, overlap, smallest)).alias("n", "c"))
    text = F.concat(F.col("title"), F.lit(" > "), F.col("c.path"), F.lit("\n\n"), F.col("c.piece"))
    return rows.select(
        F.format_string("%s#%03d", F.col("doc_id").cast("string"), "n").alias("chunk_id"), "doc_id", "title", "category", F.col("c.path").alias("section_path"),
        text.alias("text"), token_estimate(text).alias("token_count"), F.coalesce("effective_date", F.lit("")).alias("effective_date"), F.coalesce("version", F.lit("")).alias("version"),
    )


def chunk_markdown(files: DataFrame, markdown_col: str = "markdown", **options) -> tuple[DataFrame, DataFrame]:
    """Chunks of whole Markdown documents with a header, and the rows that were refused with their ``errors``."""
    header = header_of(F.col(markdown_col))
    rows = files.withColumn("header", header).withColumn("errors", header_errors(F.col("header")))
    fine = rows.filter(F.size("errors") == 0)
    docs = fine.select(*(F.coalesce(F.col("header")[k], F.lit("")).alias(k) for k in ("doc_id", "title", "category", "effective_date", "version")), body_of(F.col(markdown_col)).alias("body"))
    return chunk(docs, **options), rows.filter(F.size("errors") > 0)


def metadata(chunks: DataFrame) -> DataFrame:
    """The scalar fields that go with a chunk's vector."""
    return chunks.select("chunk_id", "doc_id", "title", "category", "section_path", "effective_date", "version", "token_count")
