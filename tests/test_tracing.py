"""Traces of runs that pass and that fail, in batch and in streams."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators.tracing import Traces


def test_batch_runs(spark):
    traces = Traces(spark)
    rows = spark.range(10).withColumn("total_tokens", F.col("id") * 2)
    sums = [F.sum("total_tokens").alias("total_tokens"), F.max("id").alias("secret_count")]
    got = traces.run("usage", rows, lambda df: df.filter("id > 3").count(), sums, route="faq", employee="ana")
    assert got == 6
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        traces.run("broken", rows, lambda df: df.select(F.lit(1) / (F.col("id") - 5).cast("int")).collect(), status="fine")
    with pytest.raises(KeyError):
        traces.run("own", rows, lambda df: {}["x"])
    one, two, three = traces.rows().collect()
    assert one["tags"] == {"component": "usage", "route": "faq"} and one["metrics"]["total_tokens"] == 90.0 and set(one["metrics"]) == {"total_tokens", "latency_ms"}
    assert two["tags"] == {"component": "broken", "status": "error", "error_type": "ArithmeticException"} and two["metrics"]["latency_ms"] > 0
    assert three["tags"]["error_type"] == "KeyError"


def test_streams(spark, tmp_path):
    traces = Traces(spark)
    listener = traces.listener(route="ingest")
    spark.streams.addListener(listener)
    try:
        for name, value in (("fine", F.col("id")), ("broken", F.lit(1) / (F.col("id") - 2).cast("int"))):
            spark.range(5).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
            stream = spark.readStream.schema("id long").parquet(str(tmp_path / name)).observe(name, F.count(F.lit(1)).alias("source_count"), F.max("id").alias("hidden"))
            q = stream.select(value.alias("x")).writeStream.queryName(name).format("noop").trigger(availableNow=True).start()
            try:
                q.awaitTermination(60)
            except Exception:
                assert name == "broken"
        until = time.time() + 30
        while time.time() < until and traces.rows().filter("tags['status'] = 'error'").count() == 0:
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(listener)
    found = traces.rows().collect()
    passed = [r for r in found if r["component"] == "fine" and r["metrics"].get("source_count")]
    assert [r["metrics"]["source_count"] for r in passed] == [5.0] and passed[0]["metrics"]["latency_ms"] > 0 and "status" not in passed[0]["tags"] and passed[0]["tags"]["route"] == "ingest"
    failed = [r for r in found if r["tags"].get("status") == "error"]
    assert [r["component"] for r in failed] == ["broken"] and failed[0]["tags"]["error_type"] and not any("hidden" in r["metrics"] for r in found)
