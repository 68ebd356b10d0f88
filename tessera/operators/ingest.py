"""Incremental ingestion: content hashes against a manifest, replacement of changed documents, removal of vanished ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import body_of, chunk_markdown, header_errors, header_of, pieces

MANIFEST = "name string, sha256 string, doc_id string, processed_file string, chunk_count long"


def plan_changes(current: DataFrame, manifest: DataFrame, force: bool = False, name: str = "name", digest: str = "sha256") -> DataFrame:
    """(name, status) with status unchanged, new, changed or deleted: one full outer join. ``force`` makes unchanged ones changed."""
    now, before = current.select(name, F.col(digest).alias("_now")), manifest.select(name, F.col(digest).alias("_before"))
    status = (
        F.when(F.col("_now").isNull(), "deleted").when(F.col("_before").isNull(), "new")
        .when((F.col("_now") == F.col("_before")) & F.lit(not force), "unchanged").otherwise("changed")
    )
    return now.join(before, name, "full_outer").select(name, status.alias("status"))


def replace_documents(chunks: DataFrame, new: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of ``touched`` documents go, the rows of ``new`` come; a touched document without new rows is only deleted.

    Plain files know no MERGE: the result is to be written to a fresh place.
    """
    return chunks.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_documents(chunks: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.join(gone.select(key).distinct(), key, "left_anti")


def outcomes(parsed: DataFrame, **options) -> DataFrame:
    """(name, sha256, doc_id, chunk_count, error) of parsed documents (name, sha256, markdown, error): each is looked at in its row, nothing is shuffled."""
    rows = parsed.select("name", "sha256", "markdown", "error", header_of(F.col("markdown")).alias("header"))
    rows = rows.select("name", "sha256", "markdown", "header", F.coalesce("error", F.nullif(F.array_join(header_errors(F.col("header")), ", "), F.lit(""))).alias("error"))
    count = F.size(pieces(body_of(F.col("markdown")), F.coalesce(F.col("header")["title"], F.lit("")), **options))
    rows = rows.select("name", "sha256", "error", F.col("header")["doc_id"].alias("doc_id"), F.when(F.col("error").isNull(), count).cast("long").alias("chunk_count"))
    error = F.coalesce("error", F.when(F.coalesce("chunk_count", F.lit(0)) == 0, "no chunks"))
    return rows.select("name", "sha256", "doc_id", "chunk_count", error.alias("error"))


def ingested(parsed: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of parsed documents (name, sha256, markdown, error): their chunks, their rows of MANIFEST, and (name, error) of those that give none.

    ``keep`` may write what became of each document, a row of a few short values, and return what it wrote; without it all are chunked again for each use of rows and errors.
    """
    chunks, _ = chunk_markdown(parsed.filter("error is null"), **options)
    found = outcomes(parsed, **options)
    found = keep(found) if keep else found
    rows = found.filter("error is null").select("name", "sha256", "doc_id", F.concat("doc_id", F.lit(".md")).alias("processed_file"), "chunk_count")
    return chunks, rows, found.filter("error is not null").select("name", "error")


def next_manifest(manifest: DataFrame, plan: DataFrame, ingested: DataFrame) -> DataFrame:
    """The manifest after a run: deleted names go, ingested ones (rows of MANIFEST) replace theirs."""
    kept = manifest.join(plan.filter("status = 'deleted'").select("name"), "name", "left_anti")
    return kept.join(ingested.select("name"), "name", "left_anti").unionByName(ingested)


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))
