"""Token usage and tickets: totals, appends and updates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COUNTS = ["prompt_tokens", "completion_tokens", "total_tokens"]
#: Where tickets are looked for, and under which keys, in this order.
TABLES = ("tickets", "complaint_tickets")
KEYS = ("ticket_id", "id")


def counts_of(usage: Column) -> list[Column]:
    """The three counts of a usage struct; null is 0."""
    return [F.coalesce(usage[c], F.lit(0)).cast("long").alias(c) for c in COUNTS]


def recordable(rows: DataFrame) -> DataFrame:
    """Rows worth recording: not all three counts are 0."""
    return rows.filter(" or ".join(f"coalesce({c}, 0) <> 0" for c in COUNTS))


def summary(rows: DataFrame, since: Column | None = None, session: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Requests and token sums, 0 where there is none; ``since`` and ``session`` narrow, ``by`` groups."""
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if session is not None:
        rows = rows.filter(F.col("session_id") == session)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("requests"), *sums)


def today(rows: DataFrame, now: Column) -> DataFrame:
    """The summary since midnight (UTC session) before ``now``."""
    return summary(rows, F.date_trunc("day", now))


def turn_usage(turns: DataFrame, rows: DataFrame, seconds: int = 3600) -> DataFrame:
    """(session_id, turn_index, sums) of what a session used from a turn's start (started_at) until its next turn.

    Rows of a session are ordered within spans of ``seconds`` only; the last turn of each span is carried on to later ones, of which there is one row each. So a session
    that holds most rows is dealt over as many tasks as it has spans.
    """
    # Both kinds of rows in one order: a usage row belongs to the last turn that started before it or with it.
    starts = turns.select("session_id", F.col("started_at").alias("_at"), F.lit(0).alias("_kind"), "turn_index", *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    used = rows.select("session_id", F.col("created_at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(turns.schema["turn_index"].dataType).alias("turn_index"), *(F.col(c).cast("long").alias(c) for c in COUNTS))
    both = starts.unionByName(used).withColumn("_span", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (seconds * 1_000_000)))
    order = Window.partitionBy("session_id", "_span").orderBy("_at", "_kind", "turn_index").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("turn_index", F.last("turn_index", ignorenulls=True).over(order))
    sums = lambda df, *by: df.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS))
    here = sums(met, "session_id", "_span", "turn_index")
    last = both.groupBy("session_id", "_span").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_at", "turn_index")))["turn_index"].alias("_last"))
    before = Window.partitionBy("session_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select("session_id", "_span", "_carried")
    late = here.filter("turn_index is null").join(carried, ["session_id", "_span"]).withColumn("turn_index", F.col("_carried")).select("session_id", "turn_index", *COUNTS)
    return sums(here.select("session_id", "turn_index", *COUNTS).unionByName(late).filter("turn_index is not null"), "session_id", "turn_index")


def file_tickets(tickets: DataFrame, new: DataFrame) -> DataFrame:
    """Appends tickets: open, not escalated, the parties as JSON."""
    rows = new.withColumn("parties_involved", F.to_json("parties_involved")).withColumns({"status": F.lit("open"), "escalated": F.lit(False), "trigger_rule": F.lit(None).cast("string"), "sla_deadline": F.lit(None).cast("timestamp"), "redacted_summary": F.lit(None).cast("string")})
    return tickets.unionByName(rows, allowMissingColumns=True)


def latest_events(events: DataFrame) -> DataFrame:
    """One event (ticket_id, rule, deadline, summary and others) of each ticket: that of the latest deadline, of equal ones that of the greater rule."""
    names = [c for c in events.columns if c != "ticket_id"]
    value = F.struct(*names)
    found = events.groupBy("ticket_id").agg(F.max_by(value, F.struct("deadline", "rule", "summary", F.to_json(value))).alias("_e"))
    return found.select("ticket_id", *(F.col(f"_e.{c}").alias(c) for c in names))


def escalate_tickets(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Updates by key: tickets with an event become escalated; the rest stay. Of several events of a ticket the one that ``latest_events`` names counts."""
    e = latest_events(events).select("ticket_id", F.col("rule").alias("_rule"), F.col("deadline").alias("_deadline"), F.col("summary").alias("_summary"), F.lit(True).alias("_hit"))
    rows = tickets.join(e, "ticket_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {"escalated": hit | F.col("escalated"), "status": F.when(hit, "escalated").otherwise(F.col("status")), "trigger_rule": F.coalesce("_rule", "trigger_rule"), "sla_deadline": F.coalesce("_deadline", "sla_deadline"), "redacted_summary": F.coalesce("_summary", "redacted_summary")}
    return rows.withColumns(new).select(*tickets.columns)


def find_tickets(tables: list[DataFrame], ticket_id: Column) -> DataFrame:
    """Looks a ticket up in tables of different layouts: the first table that has it wins, and in one with both keys ``ticket_id`` before ``id``."""
    found = None
    for k, table in enumerate(tables):
        keys = [c for c in KEYS if c in table.columns]
        place = F.coalesce(*(F.when(F.col(c) == ticket_id, j) for j, c in enumerate(keys)))
        rows = table.withColumns({"_table": F.lit(k), "_key": place}).filter("_key is not null")
        rows = rows if "ticket_id" in keys else rows.withColumnRenamed("id", "ticket_id")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found.orderBy("_table", "_key").limit(1).drop("_table", "_key")


def catalog_ticket(spark: SparkSession, ticket_id: Column, names: tuple[str, ...] = TABLES) -> DataFrame | None:
    """``find_tickets`` over those of the named tables that the catalog has and that hold a key column; None where there is none."""
    tables = [spark.table(n) for n in names if spark.catalog.tableExists(n)]
    tables = [t for t in tables if set(KEYS) & set(t.columns)]
    return find_tickets(tables, ticket_id) if tables else None
