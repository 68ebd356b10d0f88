"""Tools called from SQL: the four signatures, their error rows, and a dialogue's calls in one batch."""

import json

import pytest
from pyspark.errors import AnalysisException

from tessera.functions import tools as T
from tessera.operators import rules as R

CHUNKS = [("a", "leave", "annual", [1.0, 0.0]), ("b", "leave", "sick", [0.8, 0.6]), ("c", "payroll", "slip", [1.0, 0.1]), ("d", "payroll", "other", [0.0, 1.0]), ("e", "leave", "odd", [float("nan"), 1.0])]
TICKETS = [("t1", "open", False), ("t2", "escalated", True)]
WEB = [("q", 2, "https://www.dole.example/a", "A", "x"), ("q", 1, "https://other.example/", "B", "y"), ("q", 3, "https://dole.example", None, None), ("q", 4, "https://notdole.example", "C", "z")]


@pytest.fixture(scope="module")
def tools(spark):
    spark.createDataFrame(CHUNKS, "chunk_id string, category string, text string, embedding array<double>").createOrReplaceTempView("tool_vectors")
    spark.createDataFrame(TICKETS, "ticket_id string, status string, escalated boolean").createOrReplaceTempView("tool_tickets")
    spark.createDataFrame(WEB, "question string, rank int, url string, title string, content string").createOrReplaceTempView("tool_web")
    T.register(spark, "tool_vectors", "tool_tickets", "tool_web", ["dole.example"], k=3)
    return spark


def rows(spark, sql):
    return [tuple(r) for r in spark.sql(sql).collect()]


def test_ticket_status(tools):
    assert rows(tools, "select * from get_ticket_status('t2')") == [("t2", "escalated", True, None)]
    assert rows(tools, "select * from get_ticket_status('none')") == [("none", None, None, T.NOT_FOUND)]
    assert rows(tools, "select * from get_ticket_status(null)")[0][3] == T.NOT_FOUND
    asked = "values ('t1'), ('x'), ('t2') as a(id)"
    assert sorted(rows(tools, f"select s.ticket_id, s.status, s.error from {asked}, lateral get_ticket_status(a.id) s")) == [("t1", "open", None), ("t2", "escalated", None), ("x", None, T.NOT_FOUND)]


def test_search(tools):
    assert [r[0] for r in rows(tools, "select * from search_kb(array(1d, 0d))")] == ["a", "c", "b"]
    assert [r[0] for r in rows(tools, "select * from search_kb(array(1d, 0d), 'leave')")] == ["a", "b"]
    assert rows(tools, "select chunk_id, error from search_kb(array(1d, 0d), 'labor_law')") == [(None, T.UNKNOWN_CATEGORY)]
    assert rows(tools, "select * from search_kb(array(-1d, 0d))") == [] and rows(tools, "select * from search_kb(array(1d))") == []
    assert [r[:2] for r in rows(tools, "select * from search_web('q')")] == [(2, "https://www.dole.example/a"), (3, "https://dole.example")]
    assert rows(tools, "select * from search_web('else')") == []


def test_complaints(tools):
    ok = rows(tools, "select ticket_id, status, escalated, trigger_rule, danger_flag, error, parties_involved from file_complaint('payroll', 'low', 'The payslip is late', array('Ana'), ticket_id => 't9')")
    assert ok == [("t9", "open", False, None, False, None, '["Ana"]')]
    bad = rows(tools, "select ticket_id, escalated, error from file_complaint('pay', null, 'short')")
    assert bad == [(None, None, "could not file complaint, invalid fields: category, severity, description")]
    danger = rows(tools, "select trigger_rule, danger_flag from file_complaint('payroll', 'low', 'The payslip is late', message => 'he has a knife')")
    assert danger == [("danger_scan", True)]
    first, second = (rows(tools, "select ticket_id from file_complaint('payroll', 'low', 'The payslip is late')")[0][0] for _ in range(2))
    assert first != second and len(first) == 36
    with pytest.raises(AnalysisException):
        tools.sql("select * from file_complaint('payroll')")


def test_sql_rules_are_those_of_the_columns(tools):
    from pyspark.sql import functions as F

    from tessera.plans.common import PROBES

    p = tools.createDataFrame(PROBES, "id long, text string, category string, severity string")
    got = p.select(F.expr("ticket_errors(category, severity, text)").alias("e"), F.expr("escalation_rule(text, category, severity)").alias("r"), R.ticket_errors(F.col("category"), F.col("severity"), F.col("text")).alias("we"), R.escalation(F.col("text"), F.col("category"), F.col("severity"))["rule"].alias("wr"))
    for r in got.collect():
        assert r["e"] == r["we"] and r["r"] == r["wr"]


TURNS = [
    (1, 0, "user", "He has a knife", None, None), (1, 1, "assistant", "Oh", "file_complaint", {"category": "payroll", "severity": "low", "description": "The payslip is late"}), (1, 2, "user", "And now?", "get_ticket_status", {"ticket_id": "t1"}),
    (2, 0, "user", None, "get_ticket_status", {"ticket_id": "zz"}), (2, 1, "user", "x", "search_kb", {"question": "q", "category": "leave"}), (2, 2, "user", "x", "search_kb", {"question": "q", "category": "zoo"}), (2, 3, "user", "x", "search_kb", {"question": "q"}), (2, 4, "user", "x", "search_kb", {"question": "unheard"}),
    (3, 0, "user", "x", "fly", {}), (3, 1, "user", "x", "file_complaint", {"category": "payroll"}), (3, 2, "user", "x", "search_web", {"question": "w"}), (3, 3, "user", "x", "file_complaint", {"category": "pay", "severity": "low", "description": "short"}), (4, 0, "user", "no call", None, None),
]


def test_calls_of_a_dialogue(tools):
    kind = "session_id long, turn_index long, role string, content string, tool string, args map<string,string>"
    tools.createDataFrame(TURNS, kind).repartition(5).createOrReplaceTempView("tool_turns")
    calls = tools.sql("select * from tool_calls(TABLE(tool_turns))")
    said = {(r["session_id"], r["turn_index"]): r["message"] for r in calls.collect()}
    assert said[1, 1] == "He has a knife" and said[1, 2] == "He has a knife\nAnd now?" and said[2, 1] == "\nx" and len(said) == 11
    questions = tools.createDataFrame([("q", [1.0, 0.0])], "question string, vector array<double>")
    out = T.run_calls(calls, tools.table("tool_tickets"), tools.table("tool_vectors"), questions)
    got = {(r["session_id"], r["turn_index"]): json.loads(r["result"]) for r in out.collect()}
    assert got.keys() == said.keys()
    assert got[1, 1]["escalated"] and got[1, 1]["danger_flag"] and len(got[1, 1]["ticket_id"]) == 64
    assert got[1, 2] == {"ticket_id": "t1", "status": "open", "escalated": False} and got[2, 0] == {"error": T.NOT_FOUND}
    assert got[2, 1] == {"insufficient_context": False, "chunks_found": 2} and got[2, 2] == {"error": T.UNKNOWN_CATEGORY} and got[2, 3]["chunks_found"] == 3
    assert got[2, 4] == {"insufficient_context": True, "chunks_found": 0}
    assert got[3, 0] == {"error": "unknown tool: fly"} and got[3, 1] == {"error": "missing: severity, description"} and got[3, 2] == {"question": "w"}
    assert got[3, 3]["error"].endswith("category, description")


@pytest.mark.parametrize("columns", ["session_id, turn_index, role, content, tool", "session_id, turn_index, role, content, tool, 'x' as args"])
def test_a_wrong_table_is_refused_by_analysis(tools, columns):
    kind = "session_id long, turn_index long, role string, content string, tool string, args map<string,string>"
    tools.createDataFrame(TURNS, kind).createOrReplaceTempView("tool_turns")
    tools.sql(f"select {columns} from tool_turns").createOrReplaceTempView("tool_wrong")
    with pytest.raises(AnalysisException):
        tools.sql("select * from tool_calls(TABLE(tool_wrong))")
