"""Text functions on columns: normalisation, token estimates, block and sentence packing, previews and formatters.

All are built from Spark expressions, but for Unicode NFKC, which Spark lacks and an Arrow function supplies. Where what has been put out so far decides
what comes next, a fold over an array (``F.aggregate``) finds the borders from sizes alone, and texts are cut and joined once they are known. So
time grows with a text's length, not with its square.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = " \t\n\x0b\x0c\r"
#: The colour of a notice by severity, and of any other.
SEVERITY_COLOURS = {"low": "#6b7280", "medium": "#d97706", "high": "#ea580c", "critical": "#dc2626"}
OTHER_COLOUR = "#6b7280"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` names it in lambdas. The result is copied."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str, width: int = 32) -> Column:
    """An array of what ``step(state, item)``, a struct(state, out), puts out for each item; ``kind`` is its type.

    Items put out are gathered ``width`` at a time, so that none is copied more than some ``width`` times.
    """
    # What the last item gave is put away with the next one, so that ``step`` is evaluated once and nothing gathered passes through ``let``, which copies.
    begin = F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("open"), F.struct(start.alias("state"), F.lit(None).cast(kind).alias("out")).alias("last"), F.lit(True).alias("first"))

    def go(a: Column, x: Column) -> Column:
        over, last = F.size(a["open"]) >= width, F.array(a["last"]["out"])
        full = F.when(over, F.concat(a["full"], F.array(a["open"]))).otherwise(a["full"])
        open_ = F.when(a["first"], a["open"]).when(over, last).otherwise(F.concat(a["open"], last))
        return F.struct(full.alias("full"), open_.alias("open"), step(a["last"]["state"], x).alias("last"), F.lit(False).alias("first"))

    def end(a: Column) -> Column:
        return F.flatten(F.concat(a["full"], F.array(F.when(a["first"], a["open"]).otherwise(F.concat(a["open"], F.array(a["last"]["out"]))))))

    return F.aggregate(items, begin, go, end)


def strip(text: Column) -> Column:
    """All white space off both ends."""
    return F.btrim(text, F.lit(_SPACE))


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_text(text: Column, compose: bool = True) -> Column:
    """Line ends become LF, words broken by a hyphen are joined, page-number lines are blanked, trailing blanks go,
    more than one empty line becomes one; the text ends in one LF. ``compose`` applies NFKC first."""
    text = nfkc(text) if compose else text
    for pattern, by in (
        (r"\r\n?", "\n"),
        (r"(?U)(\w)-\n(\w)", "$1$2"),
        (r"(?imd)^\s*Page \d+( of \d+)?\s*$", ""),
        (r"(?md)[ \t]+$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return F.concat(strip(text), F.lit("\n"))


def tag_source(markdown: Column, name: Column) -> Column:
    """Adds a ``source_file`` key at the end of a document's header; a text without one is returned as it is."""
    at = F.locate("\n---", markdown, 4)
    tagged = F.concat(F.substring(markdown, F.lit(1), at - 1), F.lit("\nsource_file: "), name, F.substr(markdown, at))
    return F.when(at > 0, tagged).otherwise(markdown)


def digest(document: Column, sidecar: Column) -> Column:
    """sha256 of a document's bytes and those of its sidecar, if it has one."""
    return F.sha2(F.concat(document.cast("binary"), F.coalesce(sidecar.cast("binary"), F.lit("").cast("binary"))), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded half to even, one at least."""
    return _tokens(F.length(text))


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda b: b != "")


_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    """Lines of a text, whatever ends them; a line end at the very end opens no further line."""
    plain = F.when(text.rlike("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), F.regexp_replace(text, _LINE_END, "\n")).otherwise(text)
    return F.split(F.when(F.endswith(plain, F.lit("\n")), F.left(plain, F.length(plain) - 1)).otherwise(plain), "\n")


def is_table(block: Column) -> Column:
    """At least two lines, each beginning with a bar."""
    rows = lines(block)
    return (F.size(rows) >= 2) & F.forall(rows, lambda x: F.ltrim(x).startswith("|"))


def sentences(block: Column) -> Column:
    return F.split(block, r"(?<=[.!?])\s+")


def _tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(chars / F.lit(4.0)).cast("int"))


def pack_sentences(block: Column, target: Column | int) -> Column:
    """Sentences packed greedily: a part is closed when the next sentence would take its estimate over ``target``.

    Only the first sentence may begin with white space and only the last end with it, so a part's size is the sum of its sentences' and of the blanks between.
    """
    target = F.lit(target) if isinstance(target, int) else target

    def cut(s: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("size"))

        def step(state: Column, n: Column) -> Column:
            longer = state["size"] + 1 + n
            full = (state["size"] > 0) & (_tokens(longer) > target)
            starts = F.when(full, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
            return F.struct(starts.alias("starts"), (state["at"] + 1).alias("at"), F.when(full | (state["size"] == 0), n).otherwise(longer).alias("size"))

        sizes = F.transform(s, lambda x, i: F.when(i == 0, F.length(strip(x))).otherwise(F.length(x)))

        def part(starts: Column, a: Column, j: Column) -> Column:
            inside = F.slice(s, a + 1, F.coalesce(F.try_element_at(starts, j + 2), F.size(s)) - a)
            return let(inside, lambda p: F.when((j > 0) & (F.size(p) == 1), p[0]).otherwise(strip(F.array_join(p, " "))))

        parts = let(F.aggregate(sizes, start, step, lambda a: a["starts"]), lambda starts: F.transform(starts, lambda a, j: part(starts, a, j)))
        return F.filter(parts, lambda p: p != "")

    return let(sentences(block), cut)


def pack_blocks(parts: Column, target: Column | int, overlap: Column | int) -> Column:
    """Blocks packed greedily by the sum of their estimates; a closed window hands its last blocks, of no more than
    ``overlap`` in all, to the next. Windows are joined by an empty line."""
    target, overlap = (F.lit(x) if isinstance(x, int) else x for x in (target, overlap))

    def windows(blocks_: Column, sizes: Column) -> Column:
        def handed(a: Column, at: Column) -> Column:
            """How many of the blocks from a up to at are handed on, and their estimate."""
            begin = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("over"))

            def back(s: Column, n: Column) -> Column:
                over = s["over"] | (s["n"] + n > overlap)
                return F.struct((s["kept"] + F.when(over, 0).otherwise(1)).alias("kept"), (s["n"] + F.when(over, 0).otherwise(n)).alias("n"), over.alias("over"))

            return F.aggregate(F.reverse(F.slice(sizes, a + 1, at - a)), begin, back)

        def step(s: Column, n: Column) -> Column:
            full = (s["at"] > s["a"]) & (s["n"] + n > target)
            run = F.array(F.struct(s["a"].alias("a"), s["at"].alias("b")))
            state = lambda done, a, n_: F.struct(done.alias("done"), a.alias("a"), (s["at"] + 1).alias("at"), n_.cast("int").alias("n"))
            h = handed(s["a"], s["at"])  # of a few blocks, so it is rather found twice than ``done`` copied
            return F.when(full, state(F.concat(s["done"], run), s["at"] - h["kept"], h["n"] + n)).otherwise(state(s["done"], s["a"], s["n"] + n))

        none = F.array().cast("array<struct<a:int,b:int>>")
        start = F.struct(none.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("at"), F.lit(0).alias("n"))
        last = lambda s: F.when(s["at"] > s["a"], F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["at"].alias("b"))))).otherwise(s["done"])
        return F.transform(F.aggregate(sizes, start, step, last), lambda r: F.array_join(F.slice(blocks_, r["a"] + 1, r["b"] - r["a"]), "\n\n"))

    return let(parts, lambda p: let(F.transform(p, token_estimate), lambda sizes: windows(p, sizes)))


def split_text(text: Column, target: int, overlap: int) -> Column:
    """A section's pieces: blocks over ``target`` are cut at sentences unless they are tables, then all are packed."""
    cut = F.transform(blocks(text), lambda b: F.when(~is_table(b) & (token_estimate(b) > target), pack_sentences(b, target)).otherwise(F.array(b)))
    return pack_blocks(F.flatten(cut), target, overlap)


def preview(text: Column, limit: int = 360) -> Column:
    """White space collapsed; a text of more than ``limit`` characters ends in three dots."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def context_block(chunks: Column) -> Column:
    """Chunks (struct chunk_id, title, section_path, text) as one text, divided by rules."""
    one = lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit(" | "), c["title"], F.lit(" | "), c["section_path"], F.lit("]\n"), c["text"])
    return F.array_join(F.transform(chunks, one), "\n\n---\n\n")


def history_block(turns: Column, empty: str = "(none)") -> Column:
    """Turns (struct role, content) as lines ``role: content``, or a placeholder."""
    shown = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return F.when(F.coalesce(F.size(turns), F.lit(0)) > 0, shown).otherwise(F.lit(empty))


#: Letters whose case folding has two letters, or that have two lower-case forms.
_FOLDED = (("\u0130", "i\u0307"), ("\u1e9e", "ss"), ("\u00df", "ss"), ("\u03c2", "\u03c3"))


def fold_case(text: Column) -> Column:
    """Text for comparison without regard to case: a sharp s is two letters, both sigmas are one, a dotted I keeps its dot. Ligatures stay as they are."""
    for letter, by in _FOLDED:
        text = F.replace(text, F.lit(letter), F.lit(by))
    return F.replace(F.lower(F.upper(text)), F.lit("\u03c2"), F.lit("\u03c3"))


def humanize(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def escape_html(text: Column) -> Column:
    for mark, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


def detail_rows(**fields: Column) -> Column:
    """An HTML table row for every field that has a value, in the order given; names are humanized."""
    rows = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit("<tr><th>"), humanize(F.lit(k)), F.lit("</th><td>"), escape_html(v), F.lit("</td></tr>"))) for k, v in fields.items()]
    return F.concat_ws("", *rows)


def notice_text(ticket: Column, category: Column, severity: Column, trigger: Column, deadline: Column, filed: Column, description: Column, parties: Column, incident: Column, outcome: Column) -> Column:
    """The plain body of an escalation notice; parts without a value (``parties``: an array of names) are left out, times are given as text.
    A null in one of the required fields counts as empty."""
    given = lambda v: v.isNotNull() & (v != "")
    filled = lambda v: F.coalesce(v, F.lit(""))
    field = lambda name, v: F.concat(F.rpad(F.lit(f"{name}:"), 16, " "), filled(v))
    headed = lambda name, v: F.concat(F.lit(f"{name}\n{'-' * len(name)}\n"), filled(v))
    people = F.array_join(parties, ", ")
    facts = [("Ticket ID", ticket), ("Category", humanize(category)), ("Severity", humanize(severity)), ("Trigger", humanize(trigger)), ("SLA deadline", deadline)]
    return F.concat_ws(
        "\n\n",
        F.lit("An HR complaint has been escalated for human review."),
        F.concat_ws("\n", *(field(*f) for f in facts)),
        headed("What happened", description),
        F.when(given(people), headed("People involved", people)),
        F.when(given(incident), field("Incident date", incident)),
        F.when(given(outcome), headed("Desired outcome", outcome)),
        field("Filed at", filed),
    )


def notice_html(ticket: Column, category: Column, severity: Column, trigger: Column, deadline: Column, filed: Column, description: Column, parties: Column, incident: Column, outcome: Column) -> Column:
    """The same notice as an escaped HTML page; the heading has the colour of the severity."""
    colour = F.coalesce(*(F.when(severity == k, v) for k, v in SEVERITY_COLOURS.items()), F.lit(OTHER_COLOUR))
    title = F.concat(F.lit("<h1 style=\"color:"), colour, F.lit("\">HR Escalation: "), escape_html(F.coalesce(humanize(category), F.lit(""))), F.lit("</h1>"))
    rows = detail_rows(ticket_id=ticket, severity=humanize(severity), trigger=humanize(trigger), sla_deadline=deadline, incident_date=incident, people_involved=F.array_join(parties, ", "), what_happened=description, desired_outcome=outcome, filed_at=filed)
    return F.concat(F.lit("<html><body>"), title, F.lit("<table>"), rows, F.lit("</table></body></html>"))


def name_list(text: Column) -> Column:
    """Comma-separated names, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def message_shape(text: Column) -> Column:
    """Characters and words between white space."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.struct(F.length(text).alias("chars"), words.alias("words"))
