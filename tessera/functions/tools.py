"""The four tools as SQL functions, and tool calls of a dialogue in one batch.

``register`` defines SQL functions, so that Catalyst sees their bodies and plans them with the query that calls them:

* ``ticket_errors(category, severity, description)``: what is wrong with a ticket, an empty array if nothing is;
* ``file_complaint(category, severity, description, parties, incident_date, desired_outcome, message, ticket_id)``: one row, the ticket and what the rules decide, or
  an error; ``message`` is all that the user said, by default the description, and the id is a new one unless given;
* ``get_ticket_status(ticket_id)``: the ticket's row, or one with an error;
* ``search_kb(question, category)``: the nearest rows to a question vector over the floor, best first; an unknown category gives one row with an error;
* ``search_web(question)``: results of allowed hosts, five at most.

The table function ``tool_calls(TABLE(turns))`` gives each call the whole text that the user had said by then; it states itself how its input is partitioned and ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import MapType, StringType, StructType

from ..operators.rules import MANDATORY, SEVERITIES, TICKET_CATEGORIES, escalation, ticket_errors
from ..operators.vector import FLOOR, TOP_K, batch_top_k
from .patterns import DANGER, RETALIATION, _any

# The categories that a search may name, what a tool needs, and whose results count.
SEARCH_CATEGORIES = ["leave", "benefits", "payroll", "conduct", "complaints", "onboarding"]
REQUIRED = {"search_kb": ["question"], "search_web": ["question"], "file_complaint": ["category", "severity", "description"], "get_ticket_status": ["ticket_id"]}
WEB_RESULTS = 5
NOT_FOUND, UNKNOWN_CATEGORY = "no ticket found with that id", "unknown category"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: list[str]) -> str:
    return ", ".join(map(_text, values))


def register(spark: SparkSession, vectors: str, tickets: str, web_results: str, domains: list[str], k: int = TOP_K, floor: float = FLOOR, vector_col: str = "embedding") -> None:
    """Defines the functions for this session over tables or views by name: ``vectors`` (chunk_id, category, text and the vector), ``tickets`` (ticket_id, status and
    escalated) and ``web_results`` (question, rank, url, title, content)."""
    define = lambda body: spark.sql(f"create or replace temporary function {body}")
    # A function's body may not call another SQL function on what comes from outside, so both texts are used twice.
    wrong = f"""array_compact(array(if(coalesce({{0}}category in ({_listed(TICKET_CATEGORIES)}), false), null, 'category'), if(coalesce({{0}}severity in ({_listed(SEVERITIES)}), false), null, 'severity'),
      if(coalesce(length({{0}}description) >= 10, false), null, 'description')))"""
    rule = f"""case when {{0}}message rlike {_text(_any(DANGER)).replace("{", "{{").replace("}", "}}")} then 'danger_scan' when {{0}}category in ({_listed(MANDATORY)}) then 'mandatory_category'
      when {{0}}message rlike {_text(_any(RETALIATION)).replace("{", "{{").replace("}", "}}")} then 'retaliation_floor' when {{0}}severity in ('high', 'critical') then 'severity_escalation' end"""
    define(f"ticket_errors(category string, severity string, description string) returns array<string> return {wrong.format('ticket_errors.')}")
    define(f"escalation_rule(message string, category string, severity string) returns string return {rule.format('escalation_rule.')}")
    given = "select file_complaint.category, file_complaint.severity, file_complaint.description, file_complaint.parties, file_complaint.incident_date, file_complaint.desired_outcome, coalesce(file_complaint.message, file_complaint.description) as message, file_complaint.ticket_id as id"
    define(f"""file_complaint(category string, severity string, description string, parties array<string> default array(), incident_date string default null, desired_outcome string default null, message string default null, ticket_id string default uuid())
      returns table (ticket_id string, status string, category string, severity string, description string, parties_involved string, incident_date string, desired_outcome string, escalated boolean, trigger_rule string, danger_flag boolean, error string) return
      select if(wrong = '', id, null), if(wrong = '', 'open', null), category, severity, description, to_json(parties), incident_date, desired_outcome, if(wrong = '', rule is not null, null), if(wrong = '', rule, null), if(wrong = '', coalesce(rule = 'danger_scan', false), null),
        if(wrong = '', null, concat('could not file complaint, invalid fields: ', wrong)) from (select *, array_join({wrong.format("g.")}, ', ') as wrong, {rule.format("g.")} as rule from ({given}) g)""")
    define(f"""get_ticket_status(ticket_id string) returns table (ticket_id string, status string, escalated boolean, error string) return
      select a.id, t.status, t.escalated, if(t.ticket_id is null, '{NOT_FOUND}', null) from (select get_ticket_status.ticket_id as id) a left join {tickets} t on t.ticket_id = a.id""")
    size = lambda v: f"sqrt(aggregate({v}, 0d, (s, x) -> s + cast(x as double) * x))"
    product = f"aggregate(zip_with(v.{vector_col}, search_kb.question, (x, y) -> cast(x as double) * y), 0d, (s, x) -> s + x)"
    both = f"{size(f'v.{vector_col}')} * {size('search_kb.question')}"
    define(f"""search_kb(question array<double>, category string default null) returns table (chunk_id string, category string, text string, similarity double, error string) return
      select * from (select * from (select v.chunk_id, v.category, v.text, if({both} < double('inf'), coalesce(try_divide({product}, {both}), if({product} is null, null, 0d)), null) as similarity, cast(null as string) as error
        from {vectors} v where search_kb.category is null or v.category = search_kb.category order by similarity desc, chunk_id limit {k}) where similarity >= {floor}
      union all select null, search_kb.category, null, null, '{UNKNOWN_CATEGORY}' where search_kb.category not in ({_listed(SEARCH_CATEGORIES)})) order by similarity desc, chunk_id""")
    host = "lower(parse_url(w.url, 'HOST'))"
    allowed = " or ".join(f"{host} = {_text(d)} or endswith({host}, {_text('.' + d)})" for d in domains)
    define(f"""search_web(question string) returns table (rank int, url string, title string, content string) return
      select w.rank, w.url, w.title, w.content from {web_results} w where w.question = search_web.question and ({allowed}) order by w.rank, w.url limit {WEB_RESULTS}""")
    spark.udtf.register("tool_calls", ToolCalls)


@udtf
class ToolCalls:
    """Turns (session_id, turn_index, role, content, tool, args) in, the calls among them out, with ``message``: what the user has said so far, a line each turn.

    Holds one session's text at a time, and nothing but it.
    """

    def __init__(self):
        self.said = []

    @staticmethod
    def analyze(turns: AnalyzeArgument) -> AnalyzeResult:
        if not turns.isTable:
            raise ValueError("tool_calls takes a table")
        missing = {"session_id", "turn_index", "role", "content", "tool", "args"} - set(turns.dataType.names)
        if missing:
            raise ValueError(f"tool_calls needs the columns {', '.join(sorted(missing))}")
        kept = [turns.dataType[c] for c in ("session_id", "turn_index", "tool", "args")]
        if kept[3].dataType != MapType(StringType(), StringType()):
            raise ValueError("args is to be a map of strings")
        return AnalyzeResult(schema=StructType(kept).add("message", "string"), partitionBy=[PartitioningColumn("session_id")], orderBy=[OrderingColumn("turn_index")])

    def eval(self, row) -> Iterator[tuple]:
        if row["role"] == "user":
            self.said.append(row["content"] or "")
        if row["tool"] is not None:
            yield row["session_id"], row["turn_index"], row["tool"], row["args"], "\n".join(self.said)


def call_errors(tool: Column, args: Column) -> Column:
    """What keeps a call from being made: an unknown tool or a required argument that is missing; null if nothing does."""
    known = F.create_map(*(x for name, needed in REQUIRED.items() for x in (F.lit(name), F.array(*map(F.lit, needed)))))
    missing = F.filter(F.coalesce(known[tool], F.array().cast("array<string>")), lambda n: F.coalesce(args[n], F.lit("")) == "")
    return F.when(tool.isNull() | known[tool].isNull(), F.concat(F.lit("unknown tool: "), F.coalesce(tool, F.lit("")))).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))


def run_calls(calls: DataFrame, tickets: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = TOP_K, floor: float = FLOOR) -> DataFrame:
    """(session_id, turn_index, tool, result) of ``tool_calls``, the results as JSON or an error object; ``questions`` (question, vector) has the vectors of the questions asked.

    Calls of a kind are answered together: tickets by a join, questions by batch retrieval. A web search is external: its result names the question.
    """
    calls = calls.withColumn("error", call_errors(F.col("tool"), F.col("args")))
    arg = lambda n: F.col("args")[n]
    failed = lambda text: F.to_json(F.struct(text.alias("error")))
    keys, done = ["session_id", "turn_index", "tool"], []
    fine = calls.filter("error is null")
    done.append(calls.filter("error is not null").select(*keys, failed(F.col("error")).alias("result")))

    wrong = F.array_join(ticket_errors(arg("category"), arg("severity"), arg("description")), ", ")
    ruled = escalation(F.col("message"), arg("category"), arg("severity"))
    number = F.sha2(F.concat_ws("/", F.col("session_id").cast("string"), F.col("turn_index").cast("string")), 256)
    filed = F.to_json(F.struct(number.alias("ticket_id"), ruled["escalate"].alias("escalated"), ruled["danger"].alias("danger_flag")))
    complaint = F.when(wrong == "", filed).otherwise(failed(F.concat(F.lit("could not file complaint, invalid fields: "), wrong)))
    done.append(fine.filter("tool = 'file_complaint'").select(*keys, complaint.alias("result")))

    asked = fine.filter("tool = 'get_ticket_status'").withColumn("_id", arg("ticket_id"))
    known = tickets.select(F.col("ticket_id").cast("string").alias("_id"), F.to_json(F.struct("*")).alias("_ticket"))
    done.append(asked.join(known, "_id", "left").select(*keys, F.coalesce("_ticket", failed(F.lit(NOT_FOUND))).alias("result")))

    search = fine.filter("tool = 'search_kb'").select(*keys, arg("question").alias("question"), arg("category").alias("_category"))
    listed = F.col("_category").isNull() | F.col("_category").isin(SEARCH_CATEGORIES)
    pairs = search.filter(listed).select("question", F.coalesce("_category", F.lit("")).alias("_wanted")).distinct().join(questions, "question")
    queries = pairs.select(F.to_json(F.struct("question", "_wanted")).alias("query_id"), F.col("vector").alias("query"), F.nullif("_wanted", F.lit("")).alias("_wanted"))
    found = batch_top_k(vectors, queries, k, id_col="chunk_id", columns=[], match=("_wanted", "category"))
    counts = found.filter(F.col("similarity") >= floor).groupBy("query_id").agg(F.count("*").alias("_n"))
    search = search.withColumn("query_id", F.to_json(F.struct("question", F.coalesce("_category", F.lit("")).alias("_wanted")))).join(counts, "query_id", "left")
    n = F.coalesce("_n", F.lit(0))
    answer = F.when(listed, F.to_json(F.struct((n == 0).alias("insufficient_context"), n.alias("chunks_found")))).otherwise(failed(F.lit(UNKNOWN_CATEGORY)))
    done.append(search.select(*keys, answer.alias("result")))
    done.append(fine.filter("tool = 'search_web'").select(*keys, F.to_json(F.struct(arg("question").alias("question"))).alias("result")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
