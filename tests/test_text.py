"""Text folds by the properties of their results, and the borders of each function."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("r")).first()["r"]


def tokens(s):
    return max(1, round(len(s) / 4))


def tokens(s):
    return max(1, round(len(s) / 4))


@pytest.mark.parametrize(("text", "n"), [("", 1), ("ab", 1), ("a" * 6, 2), ("a" * 10, 2), ("a" * 14, 4), ("é" * 400, 100)])
def test_token_estimate_rounds_half_to_even(spark, text, n):
    assert one(spark, T.token_estimate(F.col("t")), t=text) == n


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .!?\n", max_size=40), min_size=1, max_size=12), st.integers(1, 12))
def test_pack_sentences(spark, texts, target):
    """Parts are runs of sentences in their order; each is as long as it can be, and over the target only if it is one sentence."""
    texts = [t.strip() for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.pack_sentences(F.col("t"), target).alias("r")).collect()
    for r in rows:
        sentences = re.split(r"(?<=[.!?])\s+", texts[r["i"]])
        assert " ".join(r["r"]) == " ".join(sentences).strip()
        ends = [len(" ".join(r["r"][: k + 1])) for k in range(len(r["r"]))]
        borders = [len(" ".join(sentences[: k + 1])) for k in range(len(sentences))]
        assert set(ends) <= set(borders)  # parts end where sentences end
        for end, part, following in zip(ends, r["r"], [*r["r"][1:], None]):
            inside = [b for b in borders if end - len(part) < b < end]
            assert tokens(part) <= target or not inside
            if following is not None:
                longer = next(b for b in borders if b > end)
                assert tokens(" " * (len(part) + longer - end)) > target


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 60), max_size=10), min_size=1, max_size=8), st.integers(1, 20), st.integers(0, 10))
def test_pack_blocks(spark, sizes, target, overlap):
    """Windows are runs of blocks that begin where the overlap of the one before says and end before the block that would not fit."""
    lists = [[f"{k:02d}" + "x" * n for k, n in enumerate(row)] for row in sizes]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, b array<string>").select("i", T.pack_blocks(F.col("b"), target, overlap).alias("r")).collect()
    for r in rows:
        n = [tokens(b) for b in lists[r["i"]]]
        runs = [(int(w.split("\n\n")[0][:2]), int(w.split("\n\n")[-1][:2]) + 1, w) for w in r["r"]]
        assert all(w == "\n\n".join(lists[r["i"]][a:b]) for a, b, w in runs)
        assert [b for _, b, _ in runs][-1:] == [len(n)][: len(n)] and (not runs or runs[0][0] == 0)
        for (a, b, _), (c, d, _) in zip(runs, runs[1:]):
            assert a <= c <= b < d and sum(n[a : b + 1]) > target  # the next block did not fit
            assert sum(n[c:b]) <= overlap and (c == a or sum(n[c - 1 : b]) > overlap)  # as much as fits is handed on
        for k, (a, b, _) in enumerate(runs):
            begin = runs[k - 1][1] if k else a  # blocks that were not handed on; the first of them needs no room
            assert sum(n[a:b]) <= target or b == begin + 1


def test_clean_text(spark):
    dirty = "ﬁrst  \r\nline of re-\nport\n\n\n\nPage 3 of 9\nnext\t\n \n"
    assert one(spark, T.clean_text(F.col("t")), t=dirty) == "first\nline of report\n\nnext\n"
    assert one(spark, T.clean_text(F.col("t")), t="") == "\n"
    assert one(spark, T.clean_text(F.col("t")), t=None) is None


def test_tag_source(spark):
    assert one(spark, T.tag_source(F.col("t"), F.lit("a.md")), t="---\nk: v\n---\nbody") == "---\nk: v\nsource_file: a.md\n---\nbody"
    assert one(spark, T.tag_source(F.col("t"), F.lit("a.md")), t="no header") == "no header"


def test_tables_are_told_from_text(spark):
    for text, want in (("| a |\n|---|", True), ("| a |", False), ("| a |\nb", False), ("  | a |\n | b |", True)):
        assert one(spark, T.is_table(F.col("t")), t=text) is want
    table = "\n".join(f"| row {i} | {'x' * 30} |" for i in range(40))
    assert one(spark, T.split_text(F.col("t"), 20, 0), t=table) == [table]


def test_preview_cuts_and_trims(spark):
    assert one(spark, T.preview(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, T.preview(F.col("t")), t="a" * 360) == "a" * 360
    assert one(spark, T.preview(F.col("t")), t="a" * 356 + " " + "b" * 10) == "a" * 356 + "..."


def test_formatters(spark):
    assert one(spark, T.humanize(F.col("t")), t="policy_violation") == "Policy Violation"
    assert one(spark, T.name_list(F.col("t")), t=" Ana , ,Ben,") == ["Ana", "Ben"]
    assert one(spark, T.detail_rows(summary=F.col("t"), other=F.lit(None).cast("string")), t="<b>&") == "<tr><th>Summary</th><td>&lt;b&gt;&amp;</td></tr>"
    empty = F.lit(None).cast("array<struct<role:string,content:string>>")
    assert one(spark, T.history_block(empty), t="x") == "(none)"


def notice(spark, of, **changes):
    fields = {"ticket": "t1", "category": "policy_violation", "severity": "high", "trigger": "danger_scan", "deadline": "2024-01-02", "filed": "2024-01-01", "description": "a < b", "parties": ["Ana", "Bo"], "incident": "May", "outcome": "rest"} | changes
    schema = ", ".join(f"{k} {'array<string>' if k == 'parties' else 'string'}" for k in fields)
    return spark.createDataFrame([tuple(fields.values())], schema).select(of(**{k: F.col(k) for k in fields})).first()[0]


def test_notice_leaves_out_what_has_no_value(spark):
    whole = notice(spark, T.notice_text)
    assert whole.split("\n\n")[1].splitlines() == ["Ticket ID:      t1", "Category:       Policy Violation", "Severity:       High", "Trigger:        Danger Scan", "SLA deadline:   2024-01-02"]
    assert whole.endswith("\n\nWhat happened\n-------------\na < b\n\nPeople involved\n---------------\nAna, Bo\n\nIncident date:  May\n\nDesired outcome\n---------------\nrest\n\nFiled at:       2024-01-01")
    for parties, rest in (([], ""), (None, None)):
        short = notice(spark, T.notice_text, parties=parties, incident=rest, outcome=rest)
        assert short.endswith("\na < b\n\nFiled at:       2024-01-01")
    assert notice(spark, T.notice_text, description=None) is not None


def test_notice_page_is_escaped(spark):
    page = notice(spark, T.notice_html, category="<x>")
    assert "a &lt; b" in page and "&lt;x&gt;" in page and "<x>" not in page and "#ea580c" in page
    bare = notice(spark, T.notice_html, severity="unknown", parties=None, incident=None, outcome=None, category=None)
    assert "#6b7280" in bare and "People Involved" not in bare


def test_case_is_folded_as_by_definition(spark):
    """Two texts are the same but for case where their full case foldings are; the folded texts themselves may look different."""
    pairs = [("Stra\u00dfe", "STRASSE"), ("stra\u00dfe", "strasse"), ("\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", "\u03a3\u038a\u03a3\u03a5\u03a6\u039f\u03a3"), ("\u0130x", "i\u0307X"), ("\u00c9", "\u00e9"), ("I", "\u0131"), ("e", "\u00e9"), ("abc", "abd"), ("\u01c5", "\u01c6")]
    rows = spark.createDataFrame(pairs, "a string, b string").select((T.fold_case(F.col("a")) == T.fold_case(F.col("b"))).alias("same"), "a", "b").collect()
    for r in rows:
        if (r["a"], r["b"]) != ("I", "\u0131"):  # the dotless i shares its upper-case letter with i
            assert r["same"] == (r["a"].casefold() == r["b"].casefold()), r


def test_lines_end_as_they_do(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", "a", "\n", "a\n\nb", "a\r\r\nb\r", *(f"a{e}b{e}{e}c{e}" for e in ends)]
    got = [r["l"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.lines(F.col("t")).alias("l")).collect()]
    assert got == [t.splitlines() or [""] for t in texts]


def test_time_grows_with_length(spark):
    """Ten times the text may take some twenty times as long, not a hundred."""
    import time

    line = "Some words in a line of text that ends here. And another one follows it!\n\n## Part {}\n\n"
    took = []
    for n in (200, 2000):
        text = "".join(line.format(i % 50) for i in range(n))
        df = spark.createDataFrame([(text,)] * 2, "t string").coalesce(1)
        from tessera.operators.chunking import merge_small, sections

        column = F.size(F.flatten(F.transform(merge_small(sections(F.col("t"), F.lit("x"))), lambda s: T.split_text(s["text"], 60, 20))))
        df.select(column).collect()
        began = time.time()
        df.select(column).collect()
        took.append(time.time() - began)
    assert took[1] < 25 * max(took[0], 0.2)
