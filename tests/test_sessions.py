"""Session state, rules and patterns; the streaming state machine gives what the batch fold gives."""

import datetime
import random

from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.operators import rules as R
from tessera.operators import sessions as S
from tessera.operators import telemetry as L
from tessera.operators import usage as U
from tessera.streaming import flows


def test_patterns_at_their_edges(spark):
    rows = [
        ("gunfire", None), ("a GUN here", "danger"), ("né gun", "danger"), ("they will fire me for reporting", "retaliation"), ("knife, retaliation", "danger"), ("", None), (None, None),
    ]
    got = spark.createDataFrame(rows, "t string, want string").select(P.danger_signal(F.col("t")).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]
    text = "mail a.b@c.org call +63917 555 1234 EMP-12345 xEMP-12345"
    row = spark.createDataFrame([(text,)], "t string").select(P.personal_labels(F.col("t")).alias("l"), P.redact(F.col("t")).alias("r")).first()
    assert row["l"] == ["email", "phone", "employee_id"]
    assert row["r"] == "mail [REDACTED_EMAIL] call [REDACTED_PHONE] [REDACTED_EMPLOYEE_ID] xEMP-12345"


def test_consent_prefers_escalation(spark):
    cases = {"b": "escalate_now", "(A)": "file_ticket", "a bee": "file_ticket", "use the form or escalate": "escalate_now", "maybe": None, "bee": None}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select(P.consent_choice(F.col("t")).alias("g"), "want").collect()
    assert [r["g"] for r in rows] == [r["want"] for r in rows]


def test_severity_never_falls(spark):
    rows = spark.createDataFrame([("low", "high"), ("high", "high"), ("critical", "critical")], "s string, want string")
    assert all(r[0] == r[1] for r in rows.select(R.at_least(F.col("s"), "high"), "want").collect())


def test_verdict_order_and_floor(spark):
    kind = "v struct<jailbreak:boolean,injection:boolean,toxicity:boolean,off_topic:boolean,pii:boolean,confidence:double>"
    rows = [((False, True, True, False, True, 0.6),), ((True, True, True, True, True, 0.59),), (None,), ((False, False, False, False, True, 1.0),)]
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(R.verdict_block(F.col("v"))).collect()] == ["injection", None, None, None]


def test_usage_of_no_rows_is_zero(spark):
    empty = spark.createDataFrame([], "session_id string, created_at timestamp, prompt_tokens long, completion_tokens long, total_tokens long")
    assert tuple(U.summary(empty).first()) == (0, 0, 0, 0)
    rows = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 0, 1), ("a", None, None, None)], "session_id string, prompt_tokens long, completion_tokens long, total_tokens long")
    assert U.recordable(rows).count() == 1


def test_find_ticket_takes_the_first_table(spark):
    a = spark.createDataFrame([("1", "x")], "ticket_id string, status string")
    b = spark.createDataFrame([("1", "y"), ("2", "z")], "id string, state string")
    assert U.find_tickets([a, b], F.lit("1")).first()["status"] == "x"
    assert U.find_tickets([a, b], F.lit("2")).first()["state"] == "z"


def test_find_ticket_by_either_key_of_a_table(spark):
    both = spark.createDataFrame([("1", "9", "by id"), ("9", "1", "by ticket_id")], "id string, ticket_id string, status string")
    assert U.find_tickets([both], F.lit("1")).first()["status"] == "by ticket_id"
    assert U.find_tickets([both], F.lit("8")).count() == 0
    assert U.find_tickets([both], F.lit(None).cast("string")).count() == 0


def test_catalog_ticket_looks_in_the_tables_that_exist(spark):
    names = ("probe_tickets", "probe_absent", "probe_keyless", "probe_complaints")
    assert U.catalog_ticket(spark, F.lit("1"), names) is None
    spark.createDataFrame([("1", "open")], "ticket_id string, status string").createOrReplaceTempView("probe_tickets")
    spark.createDataFrame([("1",)], "name string").createOrReplaceTempView("probe_keyless")
    spark.createDataFrame([("1", "b"), ("2", "c")], "id string, state string").createOrReplaceTempView("probe_complaints")
    try:
        assert U.catalog_ticket(spark, F.lit("1"), names).first()["status"] == "open"
        assert U.catalog_ticket(spark, F.lit("2"), names).first()["state"] == "c"
        assert U.catalog_ticket(spark, F.lit("3"), names).count() == 0
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def test_a_flag_blocks_alone(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, flag boolean")
    assert [r[0] for r in rows.select(P.flagged_block(F.col("flag"))).collect()] == ["injection", None, None]


def test_telemetry_drops_what_is_not_listed(spark):
    row = spark.createDataFrame([({"route": "faq", "text": "secret"}, {"latency_ms": "1.5", "total_tokens": "x", "action_count": "true", "age": "4"})], "t map<string,string>, m map<string,string>")
    got = row.select(L.allowed_tags(F.col("t")).alias("t"), L.allowed_metrics(F.col("m")).alias("m")).first()
    assert got["t"] == {"route": "faq"} and got["m"] == {"latency_ms": 1.5, "action_count": 1.0}


def test_context_seeds_only_an_empty_session(spark):
    turns = spark.createDataFrame([("s1", 0, "user", "hi")], "session_id string, turn_index long, role string, content string")
    summaries = spark.createDataFrame([("old", "e", "first", 3, "2024-01-01"), ("new", "e", "second", 3, "2024-01-02")], "session_id string, employee_id string, summary_text string, summarized_through_turn long, updated_at string")
    sessions = spark.createDataFrame([("s1", "e"), ("s2", "e"), ("s3", None), ("old", "e")], "session_id string, employee_id string")
    got = {r["session_id"]: [t["content"] for t in r["turns"]] for r in S.context(turns, summaries, sessions).collect()}
    told = "[Summary of earlier conversation: {}]"
    assert got == {"s1": ["hi"], "s2": [told.format("second")], "s3": [], "old": [told.format("first")]}


def test_stream_equals_fold(spark, tmp_path):
    random.seed(5)
    flip = lambda p: random.random() < p
    rows = [(f"s{s}", t, flip(0.15), flip(0.3), flip(0.5), flip(0.2)) for s in range(12) for t in range(9)]
    kind = "session_id string, turn_index long, cancel boolean, file boolean, complaint boolean, form boolean"
    turns = spark.createDataFrame(rows, kind)
    batch = S.run_flow(turns.withColumn("signal", F.struct("cancel", "file", "complaint", "form")))
    want = {tuple(r) for r in batch.select("session_id", "turn_index", "state", "misses", "action").collect()}
    for part in range(3):  # turns come in three files, in order
        turns.filter(f"turn_index >= {part * 3} and turn_index < {part * 3 + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.stream_flow(stream).writeStream.format("memory").queryName("flow").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("flow").collect()}
    assert got == want and len({r[4] for r in want}) >= 7


def test_scan_equals_fold(spark):
    """Sessions of one to fifty thousand turns, with gaps, by chunks of any width."""
    flag = lambda k: F.pmod(F.xxhash64("session_id", "turn_index", F.lit(k)), F.lit(7)) < (k % 3 + 1)
    signal = F.struct(flag(1).alias("cancel"), flag(2).alias("file"), flag(3).alias("complaint"), flag(5).alias("form"))
    some = spark.range(4000).select((F.col("id") % 37).alias("session_id"), F.floor(F.col("id") / 37 * (F.col("id") % 37 + 1)).cast("long").alias("turn_index")).distinct()
    some = some.withColumn("signal", F.when(F.col("turn_index") % 11 != 0, signal))
    want = sorted(map(tuple, S.run_flow(some).collect()))
    for chunk, levels in ((1, 0), (5, 3)):
        assert sorted(map(tuple, S.scan_flow(some, chunk=chunk, levels=levels).collect())) == want
    n = 50_000
    long = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("turn_index")).withColumn("signal", signal)
    rows = S.scan_flow(long).orderBy("turn_index").collect()
    state, misses = "normal", 0
    for r, g in zip(rows, long.select("signal.*").collect()):
        state, misses, action = flows.advance(state, misses, g["cancel"], g["file"], g["complaint"], g["form"])
        assert (r["state"], r["misses"], r["action"]) == (state, misses, action)
    assert len(rows) == n and len({r["action"] for r in rows}) == 8
    widest = long.groupBy(F.floor(F.col("turn_index") / S.CHUNK)).count().agg(F.max("count")).first()[0]
    assert widest == S.CHUNK


def test_stream_memory_equals_the_batch_operators(spark, tmp_path):
    """Four triggers, each in a query of its own that starts from the checkpoint of the one before."""
    random.seed(8)
    kind = "session_id string, role string, content string, created_at long"
    parts, at = [], 0
    for _ in range(4):
        rows = []
        for s in range(6):
            for _ in range(random.choice([0, 1, 4, 9])):
                rows.append((f"s{s}", random.choice(["user", "assistant"]), f"m{at}", at))
                at += 1
        parts.append(rows)
    turns = spark.createDataFrame([], "session_id string, turn_index long, role string, content string, created_at long")
    summaries = spark.createDataFrame([], "session_id string, employee_id string, summary_text string, summarized_through_turn long, updated_at long")
    want, total = [], 0
    for n, rows in enumerate(parts):
        turns = spark.createDataFrame(S.append_turns(turns, spark.createDataFrame(rows, kind)).select(*turns.columns).collect(), turns.schema)
        due = S.due_summaries(turns, summaries, 4, 3)
        want += [tuple(r) for r in S.evicted_turns(turns, due).select("session_id", "turn_index", "role", "content", "through", "watermark").collect()]
        new = due.select("session_id", F.lit(None).cast("string").alias("employee_id"), F.lit("s").alias("summary_text"), F.col("watermark").alias("summarized_through_turn"), F.lit(n).cast("long").alias("updated_at"))
        summaries = spark.createDataFrame(S.upsert_summaries(summaries, new).collect(), summaries.schema)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.stream_memory(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 4, 3)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(map(tuple, spark.read.schema(flows.EVICTED).parquet(str(tmp_path / "out")).collect()))
        assert got == sorted(want)
        total += len(rows)
    assert len(want) > 20 and len({(r[0], r[1]) for r in want}) == len(want)


def test_outbox_writes_each_record_once(spark, tmp_path):
    """A batch that fails before and after its commit, a batch that comes twice, and a record that comes in two batches."""
    from tessera.sources.store import Store

    kind = "ticket_id string, rule string, severity string, deadline string, summary string, channel string"
    record = lambda k: (f"t{k}", "danger_scan", "critical", "2024-01-01", f"s{k}", "mock")
    failing = {"data of outbox", "snapshot put"}

    def after(step):
        if step in failing:
            failing.remove(step)
            raise RuntimeError(step)

    store = Store(spark, f"file://{tmp_path}/store", after)
    for rows in ([record(1), record(2)], [record(2), record(3)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    failures = 0
    for _ in range(4):
        q = flows.stream_outbox(source(), store).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
            break
        except Exception:
            failures += 1
    assert failures == 2 and not failing
    sent = sorted(r["ticket_id"] for r in store.read("outbox").collect())
    assert sent == ["t1", "t2", "t3"] and store.properties()["batch.outbox"] == 1 and store.versions() == [1, 2]


def test_stream_documents(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    q = flows.stream_documents(spark, str(tmp_path / "d"), "doc_id long, text string").writeStream.format("memory").queryName("docs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("docs").select("sha256").distinct().count() == docs.select("text").distinct().count()


def test_stream_usage_equals_batch(spark, tmp_path):
    rows = [("a", "2024-01-01 01:00:00", 3), ("a", "2024-01-01 23:00:00", 4), ("b", "2024-01-02 00:30:00", 5), ("a", "2024-01-09 00:00:00", 0)]
    df = spark.createDataFrame(rows, "session_id string, at string, total_tokens long").select("session_id", F.col("at").cast("timestamp").alias("created_at"), "total_tokens")
    df.coalesce(1).write.parquet(str(tmp_path / "u"))
    stream = flows.stream_usage(spark.readStream.schema(df.schema).parquet(str(tmp_path / "u")))
    q = stream.writeStream.format("memory").queryName("used").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r["since"])[:10], r["session_id"], r["requests"], r["total_tokens"]) for r in spark.table("used").collect()}
    assert got == {("2024-01-01", "a", 2, 7), ("2024-01-02", "b", 1, 5), ("2024-01-09", "a", 1, 0)}


def test_outbox_and_answers(spark, tmp_path):
    from tessera.sources import files

    tickets = spark.createDataFrame([("1", "x"), ("2", "y")], "ticket_id string, category string")
    events = spark.createDataFrame([("1", "danger_scan", "critical", "2024-01-02", "category=x", False)], "ticket_id string, rule string, severity string, deadline string, summary string, delivered boolean")
    records = files.outbox_records(tickets, events)
    files.append_json(records, str(tmp_path / "o"))
    files.append_json(records, str(tmp_path / "o"))
    assert [r["channel"] for r in spark.read.json(str(tmp_path / "o")).collect()] == ["mock", "mock"]
    repeated = events.unionByName(events).unionByName(spark.createDataFrame([("1", "severity", "high", "2024-01-01", "earlier", True)], events.schema))
    assert [(r["rule"], r["severity"], r["channel"]) for r in files.outbox_records(tickets, repeated).collect()] == [("danger_scan", "critical", "mock")]


def test_repeated_summaries_of_a_session_count_once(spark):
    kind = "session_id string, employee_id string, summary_text string, summarized_through_turn long, updated_at string"
    old = spark.createDataFrame([("a", "e", "old", 1, "2024-01-01"), ("a", None, "older", 0, "2023-01-01"), ("b", "f", "b", 2, "2024-01-01")], kind)
    new = spark.createDataFrame([("a", None, "first", 5, "2024-02-01"), ("a", None, None, 7, "2024-02-02"), ("a", None, None, 6, "2024-02-02")], kind)
    got = sorted(tuple(r) for r in S.upsert_summaries(old, new).collect())
    assert got == [("a", "e", "old", 7, "2024-02-02"), ("b", "f", "b", 2, "2024-01-01")]
    turns = spark.createDataFrame([("a", i, "user", "x") for i in range(30)], "session_id string, turn_index long, role string, content string")
    assert [tuple(r) for r in S.due_summaries(turns, old).collect()] == [("a", 30, 1, 10)]
    sessions = spark.createDataFrame([("a", "e")], "session_id string, employee_id string")
    assert S.context(turns, old, sessions).count() == 1


def test_several_events_of_a_ticket_make_one_update(spark):
    tickets = U.file_tickets(spark.createDataFrame([], "ticket_id string, parties_involved string, status string, escalated boolean, trigger_rule string, sla_deadline timestamp, redacted_summary string"), spark.createDataFrame([("1", ["x"]), ("2", ["y"])], "ticket_id string, parties_involved array<string>"))
    day = lambda d: datetime.datetime(2024, 1, d)
    events = spark.createDataFrame([("1", "first", day(1), "a"), ("1", "second", day(2), "b"), ("1", "second", day(2), "b")], "ticket_id string, rule string, deadline timestamp, summary string")
    rows = sorted((r["ticket_id"], r["status"], r["trigger_rule"]) for r in U.escalate_tickets(tickets, events).collect())
    assert rows == [("1", "escalated", "second"), ("2", "open", None)]


def test_usage_goes_to_the_last_turn_that_started(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    starts = spark.createDataFrame([("s", 0, at(1)), ("s", 1, at(5)), ("s", 2, at(5)), ("t", 0, at(3))], "session_id string, turn_index int, started_at timestamp")
    rows = spark.createDataFrame([("s", at(0), 9, 9, 9), ("s", at(1), 1, 0, 1), ("s", at(4), 2, 0, 2), ("s", at(5), 4, 0, None), ("s", at(9), 8, 0, 8), ("u", at(1), 7, 7, 7)], "session_id string, created_at timestamp, prompt_tokens int, completion_tokens int, total_tokens int")
    got = {(r["session_id"], r["turn_index"]): (r["prompt_tokens"], r["total_tokens"]) for r in U.turn_usage(starts, rows).collect()}
    assert got == {("s", 0): (3, 3), ("s", 1): (0, 0), ("s", 2): (12, 8), ("t", 0): (0, 0)}
    for seconds in (1, 60, 240, 10**6):
        assert {(r["session_id"], r["turn_index"]): (r["prompt_tokens"], r["total_tokens"]) for r in U.turn_usage(starts, rows, seconds).collect()} == got


def test_usage_of_one_long_session(spark):
    """Spans without a turn's start, and rows before the first, in a session that holds all rows."""
    second = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + c)
    starts = spark.range(50).select(F.lit("s").alias("session_id"), F.col("id").alias("turn_index"), second(F.col("id") * F.col("id") * 97 + 500).alias("started_at"))
    rows = spark.range(30_000).select(F.lit("s").alias("session_id"), second(F.col("id") * 9).alias("created_at"), *(F.col("id").alias(c) for c in U.COUNTS))
    got = {r["turn_index"]: r["total_tokens"] for r in U.turn_usage(starts, rows).collect()}
    want = dict.fromkeys(range(50), 0)
    for i in range(30_000):
        turn = max((k for k in range(50) if k * k * 97 + 500 <= i * 9), default=None)
        if turn is not None:
            want[turn] += i
    assert got == want
