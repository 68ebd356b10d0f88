"""Layout reconstruction: positioned lines of pages become Markdown with headings, tables and paragraphs.

Lines are rows (doc, page, text, top, bottom, size, bold, height); windows and groups are per document, but for
counting, so documents are dealt freely over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import is_page_number
from ..functions.text import fold_case, let, strip

MARGIN, REPEATED = 0.10, 0.6
LARGER, LONGEST, DEEPEST = 0.9, 90, 3
GAP = 4.0


def line_size(sizes: Column) -> Column:
    """The mean of the characters' sizes to half points; 0 where none has one."""
    mean = lambda known: F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
    return F.coalesce(F.bround(2 * let(F.filter(sizes, lambda x: x != 0), mean)) / 2, F.lit(0.0))


def line_bold(fonts: Column) -> Column:
    """Whether half of the characters' fonts are bold ones."""
    bold = F.size(F.filter(fonts, lambda f: F.coalesce(F.lower(f).contains("bold"), F.lit(False))))
    return (F.size(fonts) > 0) & (bold * 2 >= F.size(fonts))


def line_rows(chars: DataFrame) -> DataFrame:
    """Lines from characters (doc, page, line, pos, char, top, bottom, size, font, height) that lie in rows of their own: all of them are shuffled. ``lines_of`` is
    for characters that come by the line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda c: c["char"]), "")
    known = F.when(F.col("size") != 0, F.col("size"))
    rows = chars.groupBy("doc", "page", "line").agg(
        strip(text).alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.coalesce(F.bround(2 * F.avg(known)) / 2, F.lit(0.0)).alias("size"),
        (F.count_if(F.lower("font").contains("bold")) * 2 >= F.count("*")).alias("bold"), F.max("height").alias("height"),
    )
    return rows.filter("text <> ''")


def lines_of(lines: DataFrame) -> DataFrame:
    """The same from lines (doc, page, line, chars, sizes, fonts, top, bottom, height) with arrays of their characters in order: each line is made in its row, nothing is shuffled."""
    made = F.struct(strip(F.array_join("chars", "")).alias("text"), "top", "bottom", line_size(F.col("sizes")).alias("size"), line_bold(F.col("fonts")).alias("bold"), "height")
    # A filter of rows would be pushed below the text, which would be made twice.
    return lines.select("doc", "page", "line", F.inline(F.filter(F.array(made), lambda m: m["text"] != "")))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose middle lies in no table's box (doc, page, top, bottom) of their page, give or take one."""
    boxes = tables.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    middle = (F.col("top") + F.col("bottom")) / 2
    return lines.join(boxes, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & middle.between(F.col("_t") - 1, F.col("_b") + 1), "left_anti")


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row is the header, short rows are filled up, blank rows are left out; '' without any."""
    cell = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    full = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""))
    text = F.array_join(F.concat(F.array(line(full[0]), rule), F.transform(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), line)), "\n")
    return F.when(F.size(clean) > 0, text).otherwise(F.lit(""))


def in_margin(share: float = MARGIN) -> Column:
    return (F.col("bottom") <= F.col("height") * share) | (F.col("top") >= F.col("height") * (1 - share))


def repeated_lines(lines: DataFrame, least: Column | int, key: str = "doc") -> DataFrame:
    """(key, folded): lines without regard to case that occur at least so often for their key."""
    least = F.lit(least) if isinstance(least, int) else least
    return lines.groupBy(key, fold_case(F.col("text")).alias("folded")).agg(F.count("*").alias("times")).filter(F.col("times") >= least)


def drop_chrome(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Margin lines that repeat over the pages of a document, or are bare page numbers, go.

    ``pages`` (doc, pages) gives the page counts; without it they are those of the pages that have lines.
    """
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages")) if pages is None else pages
    margin = lines.filter(in_margin())
    counts = margin.groupBy("doc", fold_case(F.col("text")).alias("_folded")).agg(F.count("*").alias("_times"))
    chrome = counts.join(pages, "doc").filter(F.col("_times") >= F.greatest(F.lit(2.0), F.lit(REPEATED) * F.col("pages"))).select("doc", "_folded", F.lit(True).alias("_chrome"))
    marked = lines.withColumn("_folded", fold_case(F.col("text"))).join(chrome, ["doc", "_folded"], "left")
    drop = in_margin() & (F.col("_chrome").isNotNull() | is_page_number(F.col("text")))
    return marked.filter(~drop).drop("_folded", "_chrome")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc, body): the size of most text; of equal ones, the first met."""
    sizes = lines.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "top")).alias("first"))
    best = Window.partitionBy("doc").orderBy(F.desc("n"), "first")
    return sizes.withColumn("k", F.row_number().over(best)).filter("k = 1").select("doc", F.col("size").alias("body"))


def heading_tiers(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc, size, tier): sizes that stand out from the body, largest first, three tiers at most."""
    large = lines.join(body, "doc").filter(F.col("size") >= F.col("body") + LARGER).select("doc", "size").distinct()
    tier = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size")))
    return large.withColumn("tier", F.least(tier, F.lit(DEEPEST)))


def heading_level(text: Column, size: Column, bold: Column, body: Column, tier: Column, deepest: Column) -> Column:
    """A line's level, or null: by its tier, or one below the deepest (null: no tier) for a bold line of body size."""
    run_in = F.least(F.coalesce(deepest, F.lit(1)) + 1, F.lit(DEEPEST))
    level = F.when(tier.isNotNull(), tier).when(bold & (F.abs(size - body) < LARGER), run_in)
    return F.when((F.length(text) > LONGEST) | F.endswith(text, F.lit(".")), F.lit(None)).otherwise(level)


def join_wrapped(texts: Column) -> Column:
    """Lines of a paragraph as one text; a hyphen before a lower-case letter is a broken word."""

    def step(p: Column, t: Column) -> Column:
        broken = F.endswith(p, F.lit("-")) & t.rlike(r"^\p{Ll}")
        return F.when(broken, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), t)).otherwise(strip(F.concat(p, F.lit(" "), t)))

    return F.aggregate(texts, F.lit(""), step)


def paragraphs(items: DataFrame, breaks: Column, order: list, key: str = "doc") -> DataFrame:
    """Numbers islands of rows: ``breaks`` begins a new one; null counts as a break."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("island", F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w))


def render(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc, markdown) from lines and tables (doc, page, top, markdown)."""
    body = body_sizes(lines)
    tiers = heading_tiers(lines, body)
    deepest = tiers.groupBy("doc").agg(F.max("tier").alias("deepest"))
    rows = lines.join(body, "doc").join(tiers, ["doc", "size"], "left").join(deepest, "doc", "left")
    level = heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("body"), F.col("tier"), F.col("deepest"))
    items = rows.select("doc", "page", "top", "bottom", "size", "text", level.alias("level"), F.lit(False).alias("is_table"))
    if tables is not None:
        shown = tables.filter("markdown <> ''")
        items = items.unionByName(shown.select("doc", "page", "top", F.lit(None).cast("double").alias("bottom"), F.lit(None).cast("double").alias("size"), F.col("markdown").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(True).alias("is_table")))
    order = ["page", "top", F.col("is_table"), "text"]
    w = Window.partitionBy("doc").orderBy(*order)
    items = items.withColumn("alone", F.col("is_table") | F.col("level").isNotNull())
    after = F.lag(F.struct("page", "bottom", "alone")).over(w)
    items = items.withColumn("before", after)
    gap = F.col("top") - F.col("before.bottom") > F.greatest(F.lit(GAP), 0.5 * F.col("size"))
    breaks = F.col("alone") | F.col("before").isNull() | F.col("before.alone") | (F.col("before.page") != F.col("page")) | gap
    items = paragraphs(items, breaks, order)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "top", "is_table", "text"))), lambda x: x["text"])
    blocks = items.groupBy("doc", "island").agg(F.first("alone").alias("alone"), F.first("is_table").alias("is_table"), F.first("level").alias("level"), texts.alias("texts"))
    block = F.when(F.col("is_table"), F.col("texts")[0]).when(F.col("alone"), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("texts")[0])).otherwise(join_wrapped(F.col("texts")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("island", block.alias("block")))), lambda x: x["block"])
    return blocks.groupBy("doc").agg(F.concat(F.array_join(F.filter(ordered, lambda b: b != ""), "\n\n"), F.lit("\n")).alias("markdown"))
