"""Streaming forms of the keyed state machine, of windowed memory, of the outbox and of incremental ingestion. The batch forms define the results; no timers and
no late-data rules are added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import BATCH, CONSENT, FORM, MISSES, NORMAL, WINDOW
from ..sources.store import Store

OUT = "session_id string, turn_index long, state string, misses int, action string"


def advance(state: str, misses: int, cancel: bool, file: bool, complaint: bool, form: bool) -> tuple[str, int, str]:
    """One step of the state machine, as ``operators.sessions.step`` takes it."""
    if state == CONSENT:
        return (NORMAL, 0, "cancelled") if cancel else (FORM, 0, "form_required") if file else (NORMAL, 0, "escalated")
    if state == FORM:
        if cancel or form:
            return NORMAL, 0, "cancelled" if cancel else "filed"
        return (NORMAL, 0, "fail_safe") if misses + 1 >= MISSES else (FORM, misses + 1, "reminded")
    return (CONSENT, 0, "consent_asked") if complaint else (NORMAL, 0, "answered")


class Flow(StatefulProcessor):
    """Keeps (state, misses) for every session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("flow", "state string, misses int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, misses = self.state.get() if self.state.exists() else (NORMAL, 0)
        turns = pd.concat(list(rows)).sort_values("turn_index")
        out = []
        for t in turns.itertuples():
            state, misses, action = advance(state, misses, bool(t.cancel), bool(t.file), bool(t.complaint), bool(t.form))
            out.append((key[0], int(t.turn_index), state, misses, action))
        if state == NORMAL:
            self.state.clear()
        else:
            self.state.update((state, misses))
        yield pd.DataFrame(out, columns=["session_id", "turn_index", "state", "misses", "action"])

    def close(self) -> None:
        pass


def stream_flow(turns: DataFrame) -> DataFrame:
    """The state machine over a stream of (session_id, turn_index, cancel, file, complaint, form); needs the RocksDB state store."""
    return turns.groupBy("session_id").transformWithStateInPandas(Flow(), OUT, "append", "None")


EVICTED = "session_id string, turn_index long, role string, content string, through long, watermark long"


class Memory(StatefulProcessor):
    """Keeps the turns of a session that no summary has taken in yet, oldest first, and how many turns and summarized turns there were.

    That is a window of turns and less than a batch besides, whatever the length of the session. When a batch has left the window, the turns that left
    come out, once, with the old and the new watermark.
    """

    def __init__(self, window: int, batch: int):
        self.window, self.batch = window, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, content string")
        self.counts = handle.getValueState("counts", "total long, through long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, through = self.counts.get() if self.counts.exists() else (0, 0)
        new = pd.concat(list(rows)).sort_values(["created_at", "role", "content"])
        added = [(t.role, t.content) for t in new.itertuples()]
        total += len(added)
        mark = total - self.window
        out = []
        if mark > 0 and mark - through >= self.batch:
            kept = [*self.turns.get(), *added]
            gone = mark - through
            out = [(key[0], through + k, role, content, through, mark) for k, (role, content) in enumerate(kept[:gone])]
            self.turns.put(kept[gone:])
            through = mark
        else:
            self.turns.appendList(added)
        self.counts.update((total, through))
        yield pd.DataFrame(out, columns=["session_id", "turn_index", "role", "content", "through", "watermark"])

    def close(self) -> None:
        pass


def stream_memory(turns: DataFrame, window: int = WINDOW, batch: int = BATCH) -> DataFrame:
    """The turns that summaries are due for, over a stream of (session_id, role, content, created_at): after each trigger what ``append_turns``, ``due_summaries`` and
    ``evicted_turns`` give for the turns so far and the watermarks before. Needs the RocksDB state store."""
    return turns.groupBy("session_id").transformWithStateInPandas(Memory(window, batch), EVICTED, "append", "None")


def once(store: Store, table: str, key: str, order: list[str], query: str) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``: a batch's rows and its number go into the store together, so that a batch that failed, or was written and is
    given again after a restart, leaves its rows once. Of several rows of a key the ``latest`` by ``order`` counts."""
    ledger = f"batch.{query}"

    def write(rows: DataFrame, batch: int) -> None:
        if batch > store.properties().get(ledger, -1):
            store.transaction().upsert(table, key, rows, order).commit({ledger: batch})

    return write


def stream_outbox(records: DataFrame, store: Store, query: str = "outbox") -> DataStreamWriter:
    """Escalation records (ticket_id, rule, severity, deadline, summary, channel) into the store's table ``outbox``, each once; to be started with a checkpoint."""
    known = F.sha2(F.to_json(F.struct("ticket_id", "rule", "severity", "deadline", "summary")), 256)
    return records.withColumn("record_id", known).writeStream.queryName(query).foreachBatch(once(store, "outbox", "record_id", ["deadline"], query))


def stream_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as they come, with a content hash for the change plan."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("sha256", F.sha2("text", 256))


def stream_usage(rows: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests and tokens by day and session over a stream of usage rows; rows later than ``late`` are not counted."""
    windowed = rows.withWatermark("created_at", late).groupBy(F.window("created_at", every).alias("w"), "session_id")
    return windowed.agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("total_tokens")).select(F.col("w.start").alias("since"), "session_id", "requests", "total_tokens")
