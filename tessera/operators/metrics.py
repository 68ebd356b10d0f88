"""Evaluation metrics: hits and ranks of retrieval, correctness by group, guardrail rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The depths at which hits are counted.
DEPTHS = [1, 3, 5, 8]


def is_hit(doc: Column, path: Column, text: Column, expected_doc: Column, expected_section: Column) -> Column:
    """The expected document and, if a section is expected, its name in path or text, whatever the case."""
    needle = F.lower(F.coalesce(expected_section, F.lit("")))
    return F.coalesce((doc == expected_doc) & ((needle == "") | F.contains(F.lower(path), needle) | F.contains(F.lower(text), needle)), F.lit(False))


def first_ranks(ranked: DataFrame, questions: DataFrame | None = None, key: str = "query_id", hit: str = "hit") -> DataFrame:
    """(key, first_rank) for every question, by default those that have a rank: the smallest rank that hits, null if none does."""
    best = ranked.groupBy(key).agg(F.min(F.when(F.col(hit), F.col("rank"))).alias("first_rank"))
    return best if questions is None else questions.select(key).join(best, key, "left")


def retrieval_metrics(ranks: DataFrame, top_k: int, depths: list[int] = DEPTHS) -> DataFrame:
    """One row: hit rates at the depths within ``top_k`` and the mean reciprocal rank; a question without a hit counts as a miss."""
    rate = lambda k: F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_rate_at_{k}")
    return ranks.agg(*(rate(k) for k in depths if k <= top_k), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("questions"))


def correctness(results: DataFrame, group: str = "category") -> DataFrame:
    """(group, total, correct, rate) for every group and, with a null group, over all; empty input has no rows but the overall one of rate 0."""
    # A row that counts for nothing gives the total over all also where there is no other.
    kind = results.schema[group].dataType
    rows = results.select(F.col(group), F.coalesce(F.col("correct").cast("int"), F.lit(0)).alias("_right"), F.lit(1).alias("_n"))
    none = results.sparkSession.range(1).select(F.lit(None).cast(kind).alias(group), F.lit(0).alias("_right"), F.lit(0).alias("_n"))
    sets = rows.unionByName(none).groupingSets([[F.col(group)], []], F.col(group))
    counted = sets.agg(F.sum("_n").alias("total"), F.sum("_right").alias("correct"), (F.grouping(group) == 1).alias("overall")).filter("overall or total > 0")
    return counted.select(group, "total", "correct", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)).alias("rate"), "overall")


def escalation_correct(expected_flag: Column, expected_rule: Column, flag: Column, rule: Column) -> Column:
    """Flag and rule as expected; no rule equals no rule."""
    return (flag == expected_flag) & rule.eqNullSafe(expected_rule)


def same_labels(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def guardrail_metrics(probes: DataFrame) -> DataFrame:
    """One row of rates over probes (category, blocked, expected_blocked, labels, expected_labels); 0 where a kind has no probe."""

    def rate(kinds: list[str], right: Column) -> Column:
        return F.coalesce(F.avg(F.when(F.col("category").isin(kinds), F.when(right, 1.0).otherwise(0.0))), F.lit(0.0))

    blocked = F.col("blocked") == F.col("expected_blocked")
    return probes.agg(
        rate(["injection", "toxicity"], blocked).alias("block_rate"), rate(["pii"], same_labels(F.col("labels"), F.col("expected_labels"))).alias("pii_rate"),
        rate(["complaint_exempt"], blocked).alias("exempt_rate"), rate(["off_topic"], F.col("blocked")).alias("off_topic_rate"),
    )


def misses(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("correct"))
