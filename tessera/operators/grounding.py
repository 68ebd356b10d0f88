"""Grounding: citations are kept only if what they cite was retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify(citations: Column, retrieved: Column) -> Column:
    """Citations (struct with chunk_id) whose chunk is among the retrieved ids."""
    return F.filter(citations, lambda c: F.array_contains(retrieved, c["chunk_id"]))


def verify_rows(citations: DataFrame, retrieved: DataFrame, keys: tuple[str, ...] = ("answer_id", "chunk_id")) -> DataFrame:
    """The same for citations in rows of their own: a semi-join."""
    return citations.join(retrieved.select(*keys), list(keys), "left_semi")


def check(citations: Column, retrieved: Column, insufficient: Column) -> Column:
    """struct(citations, insufficient). Insufficient answers lose their citations; so does one that had citations of which none
    is verified, and it becomes insufficient. A sufficient answer without any citation passes."""
    good = verify(citations, retrieved)
    had = F.coalesce(F.size(citations), F.lit(0)) > 0
    bad = F.coalesce(insufficient, F.lit(False)) | (had & (F.size(good) == 0))
    none = F.slice(citations, 1, 0)
    return F.struct(F.when(bad, none).otherwise(good).alias("citations"), bad.alias("insufficient"))


def accept_answer(answer: Column, citations: Column, retrieved: Column, insufficient: Column, canned: str) -> Column:
    """struct(text, citations, insufficient): a missing answer, and an insufficient one without a verified citation, become the canned one."""
    good = verify(citations, retrieved)
    refuse = answer.isNull() | (F.coalesce(insufficient, F.lit(False)) & (F.coalesce(F.size(good), F.lit(0)) == 0))
    return F.struct(
        F.when(refuse, F.lit(canned)).otherwise(answer).alias("text"),
        F.when(refuse, F.slice(citations, 1, 0)).otherwise(good).alias("citations"),
        (refuse | F.coalesce(insufficient, F.lit(False))).alias("insufficient"),
    )


def shape_web_answer(answer: Column, results: Column, insufficient: Column, canned: str) -> Column:
    """struct(text, source, web_citations) over results (struct url, title, content); snippets have 300 characters at most."""
    refuse = answer.isNull() | F.coalesce(insufficient, F.lit(False))
    cite = lambda r: F.struct(r["url"].alias("url"), F.coalesce(F.nullif(r["title"], F.lit("")), r["url"]).alias("title"), F.substring(F.coalesce(r["content"], F.lit("")), 1, 300).alias("snippet"))
    cited = F.transform(results, cite)
    return F.struct(
        F.when(refuse, F.lit(canned)).otherwise(answer).alias("text"),
        F.when(refuse, "none").otherwise("web").alias("source"),
        F.when(refuse, F.slice(cited, 1, 0)).otherwise(cited).alias("web_citations"),
    )


def allowed_results(results: DataFrame, domains: list[str], limit: int = 5, query_col: str = "query_id", rank_col: str = "rank") -> DataFrame:
    """Web results (url) of allowed hosts or hosts below them, ``limit`` for each query in order of rank."""
    from pyspark.sql import Window

    host = F.lower(F.parse_url(F.col("url"), F.lit("HOST")))
    fine = F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    order = Window.partitionBy(query_col).orderBy(rank_col, "url")
    return results.filter(fine).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
