"""Ordered decision rules: escalation, verdict and routing policies, each one CASE whose first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import danger_signal

# The enumerations and thresholds of the rules.
SEVERITIES = ["low", "medium", "high", "critical"]
MANDATORY = ["harassment", "discrimination", "safety", "legal"]
TICKET_CATEGORIES = ["harassment", "discrimination", "safety", "legal", "payroll", "benefits", "workplace_conflict", "policy_violation", "other"]
VERDICT_ORDER = ["jailbreak", "injection", "toxicity", "off_topic"]
CONFIDENCE = 0.6
SLA_HOURS = 24


def at_least(severity: Column, floor: str) -> Column:
    """The severity, raised to ``floor`` where it is lower."""
    order = F.array(*map(F.lit, SEVERITIES))
    return F.element_at(order, F.greatest(F.array_position(order, severity), F.lit(SEVERITIES.index(floor) + 1)).cast("int"))


def decision(escalate: bool, rule: str | None, severity: Column, danger: bool = False) -> Column:
    return F.struct(F.lit(escalate).alias("escalate"), F.lit(rule).cast("string").alias("rule"), severity.alias("severity"), F.lit(danger).alias("danger"))


def escalation(text: Column, category: Column, severity: Column) -> Column:
    """struct(escalate, rule, severity, danger): danger, then mandatory category, then retaliation, then severity, else none."""
    signal = F.coalesce(danger_signal(text), F.lit(""))
    return (
        F.when(signal == "danger", decision(True, "danger_scan", F.lit("critical"), True))
        .when(category.isin(MANDATORY), decision(True, "mandatory_category", at_least(severity, "high")))
        .when(signal == "retaliation", decision(True, "retaliation_floor", at_least(severity, "high")))
        .when(severity.isin("high", "critical"), decision(True, "severity_escalation", severity))
        .otherwise(decision(False, None, severity))
    )


def fail_safe() -> Column:
    return decision(True, "parse_failure", F.lit("high"))


def direct_request(text: Column) -> Column:
    """An escalation asked for at the consent gate: the rules over an ``other`` ticket of medium severity, else by request."""
    ruled = escalation(text, F.lit("other"), F.lit("medium"))
    return F.when(ruled["escalate"], ruled).otherwise(decision(True, "employee_requested", F.lit("high")))


def escalation_event(ticket_id: Column, category: Column, ruled: Column, now: Column) -> Column:
    """struct(ticket_id, rule, severity, deadline, summary) of an escalating decision, null otherwise. The summary has enumerations only."""
    summary = F.concat_ws(
        "; ", F.concat(F.lit("category="), category), F.concat(F.lit("severity="), ruled["severity"]),
        F.concat(F.lit("trigger="), ruled["rule"]), F.when(ruled["danger"], F.lit("danger_flag=true")),
    )
    event = F.struct(ticket_id.alias("ticket_id"), ruled["rule"].alias("rule"), ruled["severity"].alias("severity"), (now + F.expr(f"INTERVAL {SLA_HOURS} HOURS")).alias("deadline"), summary.alias("summary"))
    return F.when(ruled["escalate"] & ruled["rule"].isNotNull(), event)


def verdict_block(verdict: Column, floor: float = CONFIDENCE) -> Column:
    """The violation for which a verdict (struct of flags and confidence) blocks, or null: none without a verdict or under the floor."""
    first = F.coalesce(*(F.when(verdict[v], F.lit(v)) for v in VERDICT_ORDER))
    return F.when(verdict.isNotNull() & (verdict["confidence"] >= floor), first)


def route_policy(intent: Column, confidence: Column, question: Column, default_question: str = "Could you say more about what you need?", floor: float = CONFIDENCE) -> Column:
    """struct(intent, confidence, question): a missing or weak classification without a question becomes ambiguous and asks."""
    missing = intent.isNull()
    weak = missing | ((confidence < floor) & (F.coalesce(question, F.lit("")) == ""))
    return F.struct(
        F.when(weak, F.lit("ambiguous")).otherwise(intent).alias("intent"),
        F.when(missing, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(weak, F.lit(default_question)).otherwise(question).alias("question"),
    )


def needs_clarification(intent: Column, confidence: Column, floor: float = CONFIDENCE) -> Column:
    return (intent == "ambiguous") | (confidence < floor)


def turn_route(block_reason: Column, flow_state: Column, intent: Column, confidence: Column, has_ticket: Column, floor: float = CONFIDENCE) -> Column:
    """Where a turn goes: blocked, an open flow, a question back, a decline, the consent gate or the tool loop."""
    return (
        F.when(block_reason.isNotNull(), "blocked")
        .when(F.coalesce(flow_state, F.lit("normal")) != "normal", "flow")
        .when(needs_clarification(intent, confidence, floor), "clarify")
        .when(intent == "out_of_scope", "decline")
        .when((intent == "complaint") & ~has_ticket, "consent_gate")
        .otherwise("tool_loop")
    )


def ticket_errors(category: Column, severity: Column, description: Column) -> Column:
    """What is wrong with a ticket; empty if nothing is."""
    return F.array_compact(F.array(
        F.when(category.isNull() | ~category.isin(TICKET_CATEGORIES), "category"),
        F.when(severity.isNull() | ~severity.isin(SEVERITIES), "severity"),
        F.when(description.isNull() | (F.length(description) < 10), "description"),
    ))


def actions(ticket_id: Column, escalated: Column, rule: Column, form_required: Column) -> Column:
    """The actions of a turn as rows: a filed complaint, a required form."""
    filed = F.struct(F.lit("complaint_filed").alias("action"), ticket_id.alias("ticket_id"), F.coalesce(escalated, F.lit(False)).alias("escalated"), rule.alias("rule"))
    form = F.struct(F.lit("form_required").alias("action"), F.lit(None).cast("string").alias("ticket_id"), F.lit(False).alias("escalated"), F.lit(None).cast("string").alias("rule"))
    return F.array_compact(F.array(F.when(ticket_id.isNotNull(), filed), F.when(form_required, form)))
