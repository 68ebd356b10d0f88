"""Registered queries over the tools as SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tools
from .common import PROBES_SQL, probes, table
from .document_queries import _ESCALATION_SQL, _RE

QUERIES, ORACLE_SQL = {}, {}
_CATEGORY = ["leave", "benefits", "payroll", "conduct", "complaints"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _registered(spark: SparkSession, sf_dir: str) -> None:
    """Events as tickets, embeddings as the knowledge base of five categories, pages as web results of questions that their number gives."""
    n = F.col("event_id")
    table(spark, sf_dir, "events").select(n.cast("string").alias("ticket_id"), F.col("event_type").alias("status"), (n % 3 == 0).alias("escalated")).createOrReplaceTempView("tessera_tickets")
    v = F.col("vec_id")
    category = F.element_at(F.array(*map(F.lit, _CATEGORY)), (F.col("label") % 5 + 1).cast("int"))
    table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), v).alias("chunk_id"), category.alias("category"), F.concat(F.lit("text "), v).alias("text"), "embedding").createOrReplaceTempView("tessera_vectors")
    p = F.col("page_id")
    table(spark, sf_dir, "pages").select(F.concat(F.lit("q"), p % 7).alias("question"), p.cast("int").alias("rank"), "url", F.lit("t").alias("title"), F.lit("c").alias("content")).createOrReplaceTempView("tessera_web")
    tools.register(spark, "tessera_vectors", "tessera_tickets", "tessera_web", ["example.com", "example.net"], floor=0.05)


@query("""select cast(a.id as varchar) as asked, e.event_type as status, e.event_id % 3 = 0 as escalated, case when e.event_id is null then 'no ticket found with that id' end as error
  from (select distinct conv_id * 97 as id from conversations) a left join events e on e.event_id = a.id""")
def tool_ticket_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets asked for by number, some of which there are not."""
    _registered(spark, sf_dir)
    table(spark, sf_dir, "conversations").select((F.col("conv_id") * 97).cast("string").alias("id")).distinct().createOrReplaceTempView("tessera_asked")
    return spark.sql("select a.id as asked, s.status, s.escalated, s.error from tessera_asked a, lateral get_ticket_status(a.id) s")


@query("""with v as (select 'c' || vec_id as chunk_id, label % 5 as k, list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)) as s from embeddings),
all_of as (select 'any' as asked, chunk_id, s from v order by s desc, chunk_id limit 8), some_of as (select 'payroll' as asked, chunk_id, s from v where k = 2 order by s desc, chunk_id limit 8)
select asked, chunk_id, round(s, 6) as similarity, cast(null as varchar) as error from (select * from all_of union all select * from some_of) where s >= 0.05 union all select 'labor_law', null, null, 'unknown category'""")
def tool_search_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge base searched with vector 0: over all categories, in one, and in one that a search may not name."""
    _registered(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()
    question = "array(" + ", ".join(f"{float(x)!r}d" for x in (asked["embedding"] if asked else [])) + ")"
    one = lambda name, category: f"select '{name}' as asked, chunk_id, round(similarity, 6) as similarity, error from search_kb({question}{category})"
    return spark.sql(" union all ".join((one("any", ""), one("payroll", ", 'payroll'"), one("labor_law", ", 'labor_law'"))))


@query("""with w as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from pages where page_id % 7 = 3)
select cast(page_id as integer) as rank, url from w where host = 'example.com' or ends_with(host, '.example.com') or host = 'example.net' or ends_with(host, '.example.net') order by rank, url limit 5""")
def tool_search_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    _registered(spark, sf_dir)
    return spark.sql("select rank, url from search_web('q3')")


@query(f"""with e as (select e.*, concat_ws(', ', case when category not in ('harassment', 'discrimination', 'safety', 'legal', 'payroll', 'benefits', 'workplace_conflict', 'policy_violation', 'other') then 'category' end,
  case when severity not in ('low', 'medium', 'high', 'critical') then 'severity' end, case when length(text) < 10 then 'description' end) as wrong from {_ESCALATION_SQL} e)
select id, case when wrong = '' then 't' || id end as ticket_id, case when wrong = '' then rule is not null end as escalated, case when wrong = '' then rule end as trigger_rule, case when wrong = '' then coalesce(rule = 'danger_scan', false) end as danger_flag,
  case when wrong <> '' then 'could not file complaint, invalid fields: ' || wrong end as error from e""")
def tool_file_complaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probe and turn as the description of a complaint."""
    _registered(spark, sf_dir)
    probes(spark, sf_dir).createOrReplaceTempView("tessera_probes")
    return spark.sql("select p.id, f.ticket_id, f.escalated, f.trigger_rule, f.danger_flag, f.error from tessera_probes p, lateral file_complaint(p.category, p.severity, p.text, ticket_id => concat('t', p.id)) f")


@query(f"""with t as (select conv_id as session_id, turn as turn_index, role, text, conv_id + turn as k, ['payroll', 'safety', 'nothing'][(conv_id + turn) % 3 + 1] as category from conversations),
s as (select *, string_agg(case when role = 'user' then text end, chr(10)) over (partition by session_id order by turn_index rows unbounded preceding) as message from t)
select s.session_id, s.turn_index, case k % 4 when 0 then 'file_complaint' when 1 then 'get_ticket_status' when 2 then 'fly' end as tool, sha256(coalesce(message, '')) as message_sha256,
  case k % 4 when 2 then 'unknown tool: fly' when 1 then case when e.event_id is null then 'no ticket found with that id' end else case when category = 'nothing' or length(text) < 10 then 'could not file complaint, invalid fields: ' || concat_ws(', ', case when category = 'nothing' then 'category' end, case when length(text) < 10 then 'description' end) end end as error,
  case when k % 4 = 0 and category <> 'nothing' and length(text) >= 10 then coalesce(category = 'safety' or regexp_matches(message, '{_RE["danger"]}') or regexp_matches(message, '{_RE["retaliation"]}'), false) end as escalated,
  case when k % 4 = 1 then e.event_type end as status from s left join events e on k % 4 = 1 and e.event_id = session_id * 97 where k % 4 <> 3""")
def tool_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that call a tool, by the table function, and their results in one batch."""
    _registered(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn")
    k = (c + t) % 4
    tool = F.when(k == 0, "file_complaint").when(k == 1, "get_ticket_status").when(k == 2, "fly")
    category = F.element_at(F.array(*map(F.lit, ("payroll", "safety", "nothing"))), ((c + t) % 3 + 1).cast("int"))
    args = F.when(k == 0, F.create_map(F.lit("category"), category, F.lit("severity"), F.lit("low"), F.lit("description"), F.col("text"))).when(k == 1, F.create_map(F.lit("ticket_id"), (c * 97).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    turns = table(spark, sf_dir, "conversations").select(c.alias("session_id"), t.alias("turn_index"), "role", F.col("text").alias("content"), tool.alias("tool"), args.alias("args"))
    turns.createOrReplaceTempView("tessera_turns")
    calls = spark.sql("select * from tool_calls(TABLE(tessera_turns))")
    none = spark.createDataFrame([], "question string, vector array<double>")
    result = tools.run_calls(calls, spark.table("tessera_tickets"), spark.table("tessera_vectors"), none)
    out = calls.join(result.drop("tool"), ["session_id", "turn_index"])
    field = lambda name: F.get_json_object("result", f"$.{name}")
    return out.select("session_id", "turn_index", "tool", F.sha2("message", 256).alias("message_sha256"), field("error").alias("error"), F.when(F.col("tool") == "file_complaint", field("escalated").cast("boolean")).alias("escalated"), field("status").alias("status"))
