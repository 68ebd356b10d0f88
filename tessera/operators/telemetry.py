"""Telemetry that may leave the system: maps are cut down to allowed keys, metrics are derived from shapes alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys that may be logged.
TAGS = ["component", "session_id", "chat_model", "embedding_model", "route", "insufficient_context", "escalated", "trigger_rule", "status", "error_type"]
METRICS = ["citation_count", "source_count", "web_citation_count", "action_count", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms"]


def allowed_tags(tags: Column, keys: list[str] = TAGS) -> Column:
    """Tags of allowed keys as strings; all others are dropped without a word."""
    return F.map_filter(tags, lambda k, v: k.isin(keys))


def allowed_metrics(metrics: Column, keys: list[str] = METRICS) -> Column:
    """Metrics (map of strings) of allowed keys whose value is a number; true and false count as 1 and 0."""
    number = lambda v: F.when(F.lower(v).isin("true", "false"), (F.lower(v) == "true").cast("double")).otherwise(v.try_cast("double"))
    return F.map_filter(F.transform_values(F.map_filter(metrics, lambda k, v: k.isin(keys)), lambda k, v: number(v)), lambda k, v: v.isNotNull())


def chat_metrics(citations: Column, sources: Column, web_citations: Column, actions: Column) -> Column:
    """Sizes of a reply's lists, and whether and by which rule its first filed complaint escalated."""
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    first = F.try_element_at(F.filter(actions, lambda a: a["action"] == "complaint_filed"), F.lit(1))
    return F.struct(
        n(citations).alias("citation_count"), n(sources).alias("source_count"), n(web_citations).alias("web_citation_count"), n(actions).alias("action_count"),
        F.coalesce(first["escalated"], F.lit(False)).alias("escalated"), first["rule"].alias("trigger_rule"),
    )


def trace(started: Column, ended: Column, error: Column) -> Column:
    """struct(latency_ms, status, error_type) of a finished turn."""
    latency = (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1000.0
    return F.struct(latency.alias("latency_ms"), F.when(error.isNotNull(), "error").alias("status"), error.alias("error_type"))
