"""A bounded, deterministic sample of labelled rows, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def crc(column: str = "id"):
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, held_out: int, bound: int, scratch: Scratch, label_id: str = "doc_id", max_bytes: int | None = None) -> DataFrame:
    """(id, text, label) of at most ``bound`` labelled ids whose crc32(id) mod ``parts`` is not ``held_out``, and of ``max_bytes`` of text.

    ``docs`` has columns id and text. Rows are taken in the order of a hash of their id, so the choice depends on the ids
    alone. An id with several labels has the largest; null ids and labels teach nothing. The bound makes the
    label side safe to broadcast, so no text is shuffled.
    """
    chosen = labels.select(F.col(f"`{label_id}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    chosen = chosen.filter(crc() % parts != held_out).groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(bound)
    rows, at = scratch.write(docs.join(F.broadcast(chosen), "id").select("id", "text", "label"), "training")
    if max_bytes is None:
        return rows
    sizes = rows.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    if (sizes.agg(F.sum("bytes")).first()[0] or 0) <= max_bytes:
        return rows
    # One row for each of the ids, of which there are few.
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id"))
    some, _ = scratch.write(rows.join(F.broadcast(sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).select("id")), "id"), "bounded")
    scratch.drop(at)
    return some
