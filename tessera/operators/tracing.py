"""Traces of real runs: latency, status and error type of batch actions and of streaming triggers, with observed metrics, cut down to what may be logged."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .telemetry import allowed_metrics, allowed_tags

_KIND = "component string, tags map<string,string>, metrics map<string,string>"


class Traces:
    """Gathers a trace for every run; one small row each, on the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows, self._lock = spark, [], threading.Lock()

    def _add(self, component: str, tags: dict[str, str], metrics: dict[str, Any], latency_ms: float | None, error_type: str | None = None) -> None:
        tags = {**tags, "component": component} | ({"status": "error", "error_type": error_type} if error_type else {})
        metrics = metrics | ({} if latency_ms is None else {"latency_ms": latency_ms})
        with self._lock:
            self._rows.append((component, {k: str(v) for k, v in tags.items()}, {k: None if v is None else str(v) for k, v in metrics.items()}))

    def run(self, component: str, rows: DataFrame, action: Callable[[DataFrame], Any], metrics: list[Column] = (), **tags: str) -> Any:
        """What ``action`` gives for ``rows``, which it has to run once if there are ``metrics``: named aggregates that are observed on the way, without a
        second pass. An error leaves its trace and is raised."""
        seen = Observation() if metrics else None
        began = time.perf_counter()
        try:
            result = action(rows.observe(seen, *metrics) if metrics else rows)
        except Exception as failed:
            self._add(component, tags, {}, (time.perf_counter() - began) * 1000, type(failed).__name__)
            raise
        took = (time.perf_counter() - began) * 1000
        self._add(component, tags, dict(seen.get) if metrics else {}, took)
        return result

    def listener(self, **tags: str) -> StreamingQueryListener:
        """To be added to ``spark.streams``: a trace for each trigger, with what the stream observes, and one for a query that ends by an error."""
        traces = self

        class Listener(StreamingQueryListener):
            def __init__(self):
                self.names = {}

            def onQueryStarted(self, event):
                self.names[str(event.id)] = event.name or str(event.id)

            def onQueryProgress(self, event):
                p = event.progress
                observed = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
                traces._add(p.name or str(p.id), tags, observed, p.durationMs.get("triggerExecution"))

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                if event.exception is not None:
                    traces._add(self.names.get(str(event.id), str(event.id)), tags, {}, None, event.errorClassOnException or "StreamingQueryException")

        return Listener()

    def rows(self) -> DataFrame:
        """(component, tags, metrics) of all runs so far; keys that may not be logged are dropped."""
        with self._lock:
            found = list(self._rows)
        kept = self.spark.createDataFrame(found, _KIND)
        return kept.select("component", allowed_tags(F.col("tags")).alias("tags"), allowed_metrics(F.col("metrics")).alias("metrics"))
