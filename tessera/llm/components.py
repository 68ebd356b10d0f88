"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregate to a minimum and a join on a node; nothing is gathered on the driver but an edge count
and a checksum. The number of rounds grows with the logarithm of a component's size, also for long chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reached."""
    e, at = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below is between two plain exchanges: there, Spark splits the rows of a hub.
        least, least_at = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").filter("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        new, new_at = scratch.write(new.unionByName(small.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(at), scratch.drop(least_at)
        e, at, before, mark = new, new_at, mark, _mark(new)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
