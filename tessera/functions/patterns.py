"""Pattern predicates: prompt injection, abuse, danger and retaliation, personal data, replies of a dialogue.

Java's \\b and \\w are written with (?U), so that a letter beyond ASCII counts as one; (?iu) folds case for all letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and word lists that decide the results.
INJECTION = [
    r"ignore (all |any )?(previous|prior|above|earlier) instructions",
    r"disregard (your |the )?(system )?prompt",
    r"\byou are now\b",
    r"new instructions\s*:",
    r"(reveal|print|show|output) (your |the )?(system )?prompt",
]
ABUSE = ["fuck", "fucking", "shit", "bitch", "asshole", "bastard", "cunt", "whore", "retard", "retarded"]
DANGER = [
    r"\bweapon\b",
    r"\bgun\b",
    r"\bknife\b",
    r"\bhurt(?:ing)? (?:myself|someone|him|her|them)\b",
    r"\bkill(?:ing)? (?:myself|him|her|them|me)\b",
    r"\bsuicid\w*\b",
    r"\bself[- ]harm\w*\b",
    r"\bassault(?:ed|ing)?\b",
    r"\bthreaten(?:ed|ing)?\s+me\b",
    r"\bafraid for my (?:life|safety)\b",
    r"\bnot safe (?:here|at work|going back)\b",
    r"\bmight (?:hit|hurt|attack) me\b",
    r"\bknows? where i live\b",
]
RETALIATION = [
    r"\bfire(?:d)? (?:me )?for reporting\b",
    r"\bretaliat\w*\b",
    r"\bif i report\b",
    r"\bafraid (?:i'?ll|to) lose my job\b",
    r"\bpunish(?:ed|ing)? me\b",
]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+63|0)9\d{2}[-.\s]?\d{3}[-.\s]?\d{4}"
EMPLOYEE_ID = r"\bEMP-\d{4,6}\b"
TICKET_ID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CONSENT_ESCALATE = [r"^\s*\(?b\)?\b", r"\boption b\b", r"\bescalate\b", r"\bstraight to hr\b", r"\bskip (?:the )?form\b", r"\bjust (?:escalate|get me to hr)\b"]
CONSENT_FILE = [r"^\s*\(?a\)?\b", r"\boption a\b", r"\bfile (?:a |the )?(?:ticket|complaint)\b", r"\bfill (?:out|in) the form\b", r"\bdescribe it\b", r"\buse the form\b"]
CANCEL = [r"\bcancel\b", r"\bnever ?mind\b", r"\bforget it\b"]
INTAKE = ["complaint", "report", "harassment", "discrimination", "unsafe", "grievance"]
PAGE_NUMBER = r"^(page\s+)?\d+(\s+of\s+\d+)?$"

_ANY_CASE = "(?iuU)"
#: Label and pattern, in the order of detection and replacement; only the id is matched in any case.
PERSONAL = [("email", EMAIL), ("phone", r"(?U)" + PHONE), ("employee_id", _ANY_CASE + EMPLOYEE_ID)]


def _any(patterns: list[str]) -> str:
    return _ANY_CASE + "|".join(patterns)


def is_injection(text: Column) -> Column:
    return F.coalesce(text.rlike(_any(INJECTION)), F.lit(False))


def is_abusive(text: Column) -> Column:
    """A listed word at the left edge of a word, so inflected forms count."""
    return F.coalesce(text.rlike(_ANY_CASE + r"\b(?:" + "|".join(ABUSE) + ")"), F.lit(False))


def is_abusive_in_context(text: Column, intent: Column, flagged: Column) -> Column:
    """In a complaint only the given flag counts, since it may quote abuse; elsewhere the list or the flag."""
    flag = F.coalesce(flagged, F.lit(False))
    return F.when(intent == "complaint", flag).otherwise(is_abusive(text) | flag)


def danger_signal(text: Column) -> Column:
    """``danger``, else ``retaliation``, else null."""
    return F.when(text.rlike(_any(DANGER)), "danger").when(text.rlike(_any(RETALIATION)), "retaliation")


def personal_labels(text: Column) -> Column:
    """Labels of the kinds of personal data found, in fixed order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), label) for label, p in PERSONAL)))


def redact(text: Column) -> Column:
    for label, pattern in PERSONAL:
        text = F.regexp_replace(text, pattern, f"[REDACTED_{label.upper()}]")
    return text


def ticket_id(text: Column) -> Column:
    """The first ticket id in a text, or null."""
    return F.nullif(F.regexp_extract(text, "(?i)" + TICKET_ID, 0), F.lit(""))


def consent_choice(text: Column) -> Column:
    """``escalate_now`` before ``file_ticket``; null when neither can be read."""
    return F.when(text.rlike(_any(CONSENT_ESCALATE)), "escalate_now").when(text.rlike(_any(CONSENT_FILE)), "file_ticket")


def is_cancel(text: Column) -> Column:
    return F.coalesce(text.rlike(_any(CANCEL)), F.lit(False))


def intake_pending(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, INTAKE)), lambda term: F.contains(F.lower(text), term))


def is_page_number(text: Column) -> Column:
    return text.rlike("(?i)" + PAGE_NUMBER)


def flagged_block(flagged: Column) -> Column:
    """``injection`` where a classifier's flag is set; null where it is not or is missing."""
    return F.when(flagged, "injection")


def first_block(text: Column, judge_reason: Column) -> Column:
    """The reason of the first check that blocks (injection, abuse, the judge's), or null."""
    return F.coalesce(F.when(is_injection(text), "injection"), F.when(is_abusive(text), "abuse"), judge_reason)
