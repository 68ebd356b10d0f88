"""Registered queries over conversations and events: sessions, usage and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sessions as S
from ..operators import telemetry, usage as U
from ..sources.store import Store, shared_folder
from .common import USAGE_SQL, table, turns, usage

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TURNS = "(select conv_id as session_id, turn as turn_index, role, text as content from conversations)"


@query(f"select session_id, turn_index, role, content from (select *, row_number() over (partition by session_id order by turn_index desc) as k from {_TURNS}) where k <= 4")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_turns(turns(spark, sf_dir), 4)


@query(f"select session_id, string_agg(content, chr(10) order by turn_index) as text from {_TURNS} where role = 'user' group by session_id")
def user_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.user_text(turns(spark, sf_dir))


@query(f"select session_id, string_agg(role || ': ' || content, chr(10) order by turn_index) as history from {_TURNS} group by session_id")
def history_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history(turns(spark, sf_dir)).select("session_id", T.history_block(F.col("turns")).alias("history"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier summaries of every third session, by an employee that ten sessions share."""
    found = table(spark, sf_dir, "conversations").select("conv_id").distinct().filter("conv_id % 3 = 0")
    n = F.col("conv_id")
    day = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((n % 28).cast("int"))).alias("updated_at")
    return found.select(n.alias("session_id"), F.concat(F.lit("e"), F.floor(n / 10)).alias("employee_id"), F.concat(F.lit("summary "), n).alias("summary_text"), (n % 2).alias("summarized_through_turn"), day)


_SUMMARIES = """(select distinct conv_id as session_id, 'e' || (conv_id // 10) as employee_id, 'summary ' || conv_id as summary_text, conv_id % 2 as summarized_through_turn, conv_id % 28 as age from conversations where conv_id % 3 = 0)"""
_DUE = f"""due as (select t.session_id, t.total, coalesce(s.summarized_through_turn, 0) as through, t.total - 4 as watermark from (select session_id, count(*) as total from {_TURNS} group by session_id) t left join {_SUMMARIES} s using (session_id)
  where t.total > 4 and t.total - 4 - coalesce(s.summarized_through_turn, 0) >= 2)"""


@query(f"with {_DUE} select * from due")
def due_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.due_summaries(turns(spark, sf_dir), _summaries(spark, sf_dir), 4, 2)


@query(f"with {_DUE} select t.session_id, t.turn_index, t.content from {_TURNS} t join due d using (session_id) where t.turn_index >= d.through and t.turn_index < d.watermark")
def evicted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return S.evicted_turns(t, S.due_summaries(t, _summaries(spark, sf_dir), 4, 2)).select("session_id", "turn_index", "content")


@query(f"""with {_DUE}, n as (select session_id, cast(null as varchar) as employee_id, case when session_id % 2 = 0 then 'new ' || session_id end as summary_text, watermark from due)
select coalesce(o.session_id, n.session_id) as session_id, coalesce(n.employee_id, o.employee_id) as employee_id, coalesce(n.summary_text, o.summary_text) as summary_text, coalesce(n.watermark, o.summarized_through_turn) as summarized_through_turn
from {_SUMMARIES} o full outer join n on o.session_id = n.session_id""")
def upsert_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due sessions get a summary; a null one keeps the old text, and the watermark moves on."""
    old = _summaries(spark, sf_dir)
    due = S.due_summaries(turns(spark, sf_dir), old, 4, 2)
    text = F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("new "), F.col("session_id")))
    new = due.select("session_id", F.lit(None).cast("string").alias("employee_id"), text.alias("summary_text"), F.col("watermark").alias("summarized_through_turn"), F.lit("2024-03-01").cast("timestamp").alias("updated_at"))
    return S.upsert_summaries(_with_earlier(old), _with_earlier(new)).drop("updated_at")


def _with_earlier(summaries: DataFrame) -> DataFrame:
    """Each row twice, once as an earlier one of the same session that does not count."""
    earlier = summaries.withColumns({"updated_at": F.col("updated_at") - F.expr("interval 1 day"), "summary_text": F.lit("earlier"), "employee_id": F.lit("nobody"), "summarized_through_turn": F.lit(0).cast("long")})
    return summaries.unionByName(earlier)


@query(ORACLE_SQL["upsert_summaries"])
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a store: the old summaries are one version, the new ones the next, each session more than once in either."""
    old = _summaries(spark, sf_dir)
    due = S.due_summaries(turns(spark, sf_dir), old, 4, 2)
    text = F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("new "), F.col("session_id")))
    new = due.select("session_id", F.lit(None).cast("string").alias("employee_id"), text.alias("summary_text"), F.col("watermark").alias("summarized_through_turn"), F.lit("2024-03-01").cast("timestamp").alias("updated_at"))
    store = Store(spark, shared_folder(spark, "store"))
    store.transaction().upsert("summaries", "session_id", _with_earlier(old), ["updated_at"]).commit()
    store.transaction().upsert("summaries", "session_id", _with_earlier(new).select(old.columns), ["updated_at"], keep=["employee_id", "summary_text"]).commit()
    return store.read("summaries").drop("updated_at")


@query(f"""with sessions as (select session_id, 'e' || (session_id // 10) as employee_id from (select distinct session_id from {_TURNS} union select distinct session_id + 1000000 from {_TURNS})),
recent as (select session_id, string_agg(role || ': ' || content, chr(10) order by turn_index) as shown from (select *, row_number() over (partition by session_id order by turn_index desc) as k from {_TURNS}) where k <= 4 group by session_id),
latest as (select * from (select *, row_number() over (partition by employee_id order by age desc, session_id) as k from {_SUMMARIES}) where k = 1),
told as (select s.session_id, r.shown, coalesce(o.summary_text, case when r.shown is null then l.summary_text end) as summary from sessions s left join recent r using (session_id) left join {_SUMMARIES} o on o.session_id = s.session_id left join latest l on l.employee_id = 'e' || ((s.session_id % 1000000) // 10))
select session_id, concat_ws(chr(10), 'assistant: [Summary of earlier conversation: ' || summary || ']', shown) as context from told where summary is not null or shown is not null""")
def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session, and one without turns for each, that may begin with its employee's summary."""
    t = turns(spark, sf_dir)
    ids = t.select("session_id").distinct()
    both = ids.unionByName(ids.select((F.col("session_id") + 1000000).alias("session_id")))
    people = both.select("session_id", F.concat(F.lit("e"), F.floor(F.col("session_id") % 1000000 / 10)).alias("employee_id"))
    out = S.context(t, _summaries(spark, sf_dir), people, 4)
    return out.filter(F.size("turns") > 0).select("session_id", T.history_block(F.col("turns")).alias("context"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that a turn's length gives, since no text has the phrases."""
    n = F.length("content")
    signal = F.struct((n % 11 == 0).alias("cancel"), (n % 3 == 0).alias("file"), (n % 2 == 0).alias("complaint"), (n % 5 == 0).alias("form"))
    return turns(spark, sf_dir).select("session_id", "turn_index", signal.alias("signal"))


@query(f"""with recursive t as (select session_id, turn_index, length(content) as n, row_number() over (partition by session_id order by turn_index) as k from {_TURNS}),
w as (
  select session_id, cast(-1 as bigint) as turn_index, cast(0 as bigint) as k, 'normal' as state, 0 as misses, '' as action from (select distinct session_id from t)
  union all
  select t.session_id, t.turn_index, t.k,
    case when w.state = 'awaiting_consent' then case when n % 11 = 0 then 'normal' when n % 3 = 0 then 'awaiting_form' else 'normal' end
      when w.state = 'awaiting_form' then case when n % 11 = 0 or n % 5 = 0 or w.misses >= 1 then 'normal' else 'awaiting_form' end when n % 2 = 0 then 'awaiting_consent' else 'normal' end,
    case when w.state = 'awaiting_form' and n % 11 <> 0 and n % 5 <> 0 and w.misses < 1 then w.misses + 1 else 0 end,
    case when w.state = 'awaiting_consent' then case when n % 11 = 0 then 'cancelled' when n % 3 = 0 then 'form_required' else 'escalated' end
      when w.state = 'awaiting_form' then case when n % 11 = 0 then 'cancelled' when n % 5 = 0 then 'filed' when w.misses >= 1 then 'fail_safe' else 'reminded' end when n % 2 = 0 then 'consent_asked' else 'answered' end
  from w join t on t.session_id = w.session_id and t.k = w.k + 1
)
select session_id, turn_index, state, misses, action from w where k > 0""")
def session_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_flow(_signals(spark, sf_dir))


@query(ORACLE_SQL["session_flow"])
def session_flow_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by composing chunks of three turns."""
    return S.scan_flow(_signals(spark, sf_dir), chunk=3)


@query(f"""with old as (select session_id, max(turn_index) as m from {_TURNS} where turn_index < 3 group by session_id), n as (select session_id, turn_index as seq, content from {_TURNS} where turn_index >= 3)
select session_id, turn_index, content from {_TURNS} where turn_index < 3
union all select n.session_id, coalesce(o.m, -1) + row_number() over (partition by n.session_id order by n.seq) as turn_index, n.content from n left join old o using (session_id)""")
def append_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns appended to the first three of each session."""
    t = turns(spark, sf_dir)
    new = t.filter("turn_index >= 3").select("session_id", F.col("turn_index").alias("created_at"), "content")
    return S.append_turns(t.filter("turn_index < 3").select("session_id", "turn_index", "content"), new).select("session_id", "turn_index", "content")


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_per_key(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


_STATE = "case event_id % 3 when 0 then 'normal' when 1 then 'awaiting_consent' else 'awaiting_form' end"


def _state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    state = F.when(n % 3 == 0, S.NORMAL).when(n % 3 == 1, S.CONSENT).otherwise(S.FORM)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), state.alias("state"), F.lit(0).cast("long").alias("miss_count"), n.alias("updated_at"))


@query(f"""select session_id, state from (select user_id as session_id, {_STATE} as state, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1 and state <> 'normal'""")
def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.current_states(_state_log(spark, sf_dir)).select("session_id", "state")


@query(f"""with s as (select session_id, state from (select user_id as session_id, {_STATE} as state, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1 and state <> 'normal'),
m as (select user_id as session_id, count(*) as n from events where value < 10 group by user_id) select s.session_id, s.state, coalesce(m.n, 0) as miss_count from s left join m using (session_id)""")
def form_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = table(spark, sf_dir, "events").filter("value < 10").select(F.col("user_id").alias("session_id"))
    return S.record_misses(S.current_states(_state_log(spark, sf_dir)), missed)


_SUMS = "count(*) as requests, cast(coalesce(sum(prompt_tokens), 0) as bigint) as prompt_tokens, cast(coalesce(sum(completion_tokens), 0) as bigint) as completion_tokens, cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens"


@query(f"select session_id, {_SUMS} from {USAGE_SQL} u where created_at >= timestamp '2024-01-10' and (prompt_tokens <> 0 or completion_tokens <> 0 or total_tokens <> 0) group by session_id")
def usage_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.summary(U.recordable(usage(spark, sf_dir)), F.lit("2024-01-10").cast("timestamp"), by=["session_id"])


@query(f"select {_SUMS} from {USAGE_SQL} u where created_at >= timestamp '2024-01-20 00:00:00'")
def usage_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of an hour of the events' own month."""
    return U.today(usage(spark, sf_dir), F.lit("2024-01-20 15:00:00").cast("timestamp"))


@query(f"select {_SUMS} from {USAGE_SQL} u where created_at >= timestamp '2030-01-01'")
def usage_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row at all: sums are 0, not null."""
    return U.summary(usage(spark, sf_dir), F.lit("2030-01-01").cast("timestamp"))


@query(f"""with s as (select user_id as session_id, event_id as turn_index, ts as started_at, lead(ts) over (partition by user_id order by ts, event_id) as ends from events where event_type = 'view')
select s.session_id, s.turn_index, cast(coalesce(sum(u.prompt_tokens), 0) as bigint) as prompt_tokens, cast(coalesce(sum(u.completion_tokens), 0) as bigint) as completion_tokens, cast(coalesce(sum(u.total_tokens), 0) as bigint) as total_tokens
from s left join {USAGE_SQL} u on u.session_id = s.session_id and u.created_at >= s.started_at and (s.ends is null or u.created_at < s.ends) group by s.session_id, s.turn_index""")
def turn_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as turn starts: what was used until the next."""
    starts = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_index"), F.col("ts").alias("started_at"))
    return U.turn_usage(starts, usage(spark, sf_dir))


@query("""select event_id, event_type as status, 'k' as dropped, case when json_extract_string(props, '$.k') is not null then 1 else 0 end as seen from events""")
def telemetry_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of an event: its type may go out, what is in its props may not."""
    props = F.from_json("props", "map<string,string>")
    tags = F.map_concat(props, F.create_map(F.lit("status"), F.col("event_type")))
    kept = telemetry.allowed_tags(tags)
    rows = table(spark, sf_dir, "events").select("event_id", kept.alias("kept"), F.map_keys(F.map_filter(tags, lambda k, v: ~F.map_contains_key(kept, k))).alias("dropped"))
    return rows.select("event_id", F.col("kept")["status"].alias("status"), F.array_join("dropped", ",").alias("dropped"), F.size("dropped").alias("seen"))


@query("""select event_id, round(value, 6) as latency_ms, cast(case when event_id % 2 = 0 then 1 else 0 end as double) as action_count, 2 as kept from events""")
def telemetry_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that are numbers or truth values of allowed keys stay."""
    n = F.col("event_id")
    given = F.create_map(F.lit("latency_ms"), F.col("value").cast("string"), F.lit("action_count"), (n % 2 == 0).cast("string"), F.lit("total_tokens"), F.lit("many"), F.lit("user_id"), n.cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", telemetry.allowed_metrics(given).alias("m"))
    return rows.select("event_id", F.round(F.col("m")["latency_ms"], 6).alias("latency_ms"), F.col("m")["action_count"].alias("action_count"), F.size("m").alias("kept"))


@query("""select user_id, count(*) as tickets, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as escalated from events group by user_id""")
def ticket_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tickets; purchases have an escalation event."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    empty = e.limit(0).select(n.alias("ticket_id"), "user_id", F.lit("").alias("parties_involved"), F.lit("").alias("status"), F.lit(False).alias("escalated"), F.lit("").alias("trigger_rule"), F.col("ts").alias("sla_deadline"), F.lit("").alias("redacted_summary"))
    tickets = U.file_tickets(empty, e.select(n.alias("ticket_id"), "user_id", F.array("event_type").alias("parties_involved")))
    events = e.filter("event_type = 'purchase'").select(n.alias("ticket_id"), F.lit("danger_scan").alias("rule"), F.col("ts").alias("deadline"), F.lit("").alias("summary"))
    done = U.escalate_tickets(tickets, events)
    return done.groupBy("user_id").agg(F.count("*").alias("tickets"), F.sum(F.when(F.col("escalated") & (F.col("status") == "escalated"), 1).otherwise(0)).alias("escalated"))


@query("""select event_id, floor(value * 1000) / 1000.0 as latency_ms, case when event_type = 'error' then 'error' end as status, case when event_type = 'error' then 'ValueError' end as error_type from events""")
def turn_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns that took their value in milliseconds."""
    ended = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000).cast("long"))
    t = telemetry.trace(F.col("ts"), ended, F.when(F.col("event_type") == "error", "ValueError"))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", "t.latency_ms", "t.status", "t.error_type")


@query("""select cast(event_id as varchar) as ticket_id, user_id, event_type as kind from events where event_id = (select min(event_id) from events where event_type = 'purchase')""")
def ticket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase looked up in two tables of different layouts; the first that has it answers."""
    e = table(spark, sf_dir, "events")
    wanted = e.filter("event_type = 'purchase'").agg(F.min("event_id")).first()[0]
    errors = e.filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("ticket_id"), "user_id", F.col("event_type").alias("kind"))
    others = e.filter("event_type <> 'error'").select(F.col("event_id").cast("string").alias("id"), "user_id", F.col("event_type").alias("kind"))
    return U.find_tickets([errors, others], F.lit(str(wanted)))


@query(f"select session_id, count(*) as turns from {_TURNS} where session_id not in (select session_id from {_SUMMARIES}) group by session_id")
def unsummarized_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have no summary: what is left when those with one are deleted."""
    from ..operators.ingest import delete_documents

    left = delete_documents(turns(spark, sf_dir), _summaries(spark, sf_dir), "session_id")
    return left.groupBy("session_id").agg(F.count("*").alias("turns"))


@query("""select event_id, case when event_id % 5 = 0 or event_id % 3 = 0 then 0 else event_id end as prompt_tokens, case when event_id % 5 = 0 then 0 else event_id % 7 end as completion_tokens, case when event_id % 5 = 0 then 0 else event_id + event_id % 7 end as total_tokens from events""")
def reported_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a model reports them: a fifth has none at all, a third lacks one."""
    n = F.col("event_id")
    given = F.struct(F.when(n % 3 != 0, n).alias("prompt_tokens"), (n % 7).alias("completion_tokens"), (n + n % 7).alias("total_tokens"))
    return table(spark, sf_dir, "events").withColumn("usage", F.when(n % 5 != 0, given)).select("event_id", *U.counts_of(F.col("usage")))


@query("""select user_id, count(*) as events, max(ts) filter (event_type = 'purchase') as deadline from events group by user_id having count(*) filter (event_type = 'purchase') > 0""")
def repeated_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket for each user, and an event for every purchase: each ticket is updated once, by the latest."""
    e = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string")
    empty = e.limit(0).select(key.alias("ticket_id"), "user_id", F.lit(0).cast("long").alias("events"), F.lit("").alias("parties_involved"), F.lit("").alias("status"), F.lit(False).alias("escalated"), F.lit("").alias("trigger_rule"), F.col("ts").alias("sla_deadline"), F.lit("").alias("redacted_summary"))
    new = e.groupBy("user_id").agg(F.count("*").alias("events")).select(key.alias("ticket_id"), "user_id", "events", F.array(F.lit("x")).alias("parties_involved"))
    events = e.filter("event_type = 'purchase'").select(key.alias("ticket_id"), F.lit("danger_scan").alias("rule"), F.col("ts").alias("deadline"), F.lit("").alias("summary"))
    done = U.escalate_tickets(U.file_tickets(empty, new), events)
    return done.filter("escalated").select("user_id", "events", F.col("sla_deadline").cast("timestamp_ntz").alias("deadline"))
