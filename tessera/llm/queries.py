"""The registered queries of the training-data operators: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, rest: int):
    """False for a null id: it teaches nothing, but is not of the held-out part either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False)).alias("held_out")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(5, 0), "score", "predicted")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_benchmark

    out = find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items, "contaminated")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeated

    out = remove_repeated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(3, 1), "score", "predicted")


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    out = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_token_files, write_token_files

    root = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, root)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents")).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout has 12 shards by a hash of the source, a hot source included; the new one 16 of near equal bytes."""
    from .sharding import SHARD, SLOT, resharded

    docs = _table(spark, sf_dir, "documents")
    out = resharded(docs, F.coalesce(F.pmod(F.xxhash64("source"), F.lit(12)), F.lit(0)), 16)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col(SHARD).alias("shard"), F.col(SLOT).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits, which takes some million rows, is null here; the operator has it as a decimal."""
    from .whitening import whitened_components

    return whitened_components(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


_SPACED_WORD = r"[^\x20\x09-\x0D]+"


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the crc32 of the id, the words from one place on repeat with a period that the id gives."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", (F.coalesce(h % 10, F.lit(-1)) == 0).alias("chosen"), F.floor(h / 10).cast("long").alias("g"))
    words = F.when(F.col("chosen"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_SPACED_WORD), F.lit(0)))
    sized = chosen.withColumn("words", words).withColumn("n", F.size("words"))
    placed = sized.withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    planted = F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")
    return placed.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs, strongest

    out = periodic_runs(with_planted_tails(_table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


#: A dated block list: (list, kind, pattern, action, day).
URL_ENTRIES = [
    ("ads", "domain", "ads-track.example.com", "add", "2024-02-01"),
    ("ads", "domain", "ads-track.example.com", "remove", "2024-06-01"),
    ("ads", "domain", "ads-track.example.com", "add", "2024-09-15"),
    ("spam", "host", "www.spam-farm.example.org", "add", "2024-03-01"),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-05-01"),
    ("spam", "domain", "spam-farm.example.org", "remove", "2024-11-01"),
    ("gambling", "domain", "casino-win.example.net", "add", "2024-01-10"),
    ("gambling", "domain", "free-bets.example.net", "add", "2024-04-01"),
    ("gambling", "domain", "free-bets.example.net", "remove", "2024-04-01"),
    ("adult", "host", "adult-x.example.com", "add", "2023-12-01"),
    ("adult", "host", "adult-x.example.com", "remove", "2024-08-01"),
    ("pharmacy", "domain", "cheap-pills.example.net", "add", "2024-07-01"),
    ("pharmacy", "prefix", "blog.cheap-pills.example.net/en", "add", "2024-02-15"),
    ("language", "prefix", "tionsh.example.net/de", "add", "2024-03-15"),
    ("language", "prefix", "tionsh.example.net/de/", "remove", "2024-10-01"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch time: day ``page_id mod 366`` of 2024 stands for it. Besides the fixed list, every host whose name has an
    odd length is on a rotating list for 60 days, from a day that its name gives."""
    from .url_filters import evaluate, host_of

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    fixed = spark.sql("select list, kind, pattern, action, cast(at as date) as at from values " + ", ".join(map(str, URL_ENTRIES)) + " as t(list, kind, pattern, action, at)")
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null and length(host) % 2 = 1").distinct()
    begin = F.date_add(F.lit("2024-01-01").cast("date"), (F.length("host") * 37 + F.ascii("host") * 11) % 300)
    states = F.array(F.struct(F.lit("add").alias("action"), begin.alias("at")), F.struct(F.lit("remove").alias("action"), F.date_add(begin, 60).alias("at")))
    rotating = hosts.select(F.lit("rotating").alias("list"), F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.explode(states).alias("s")).select("list", "kind", "pattern", "s.action", "s.at")
    out = evaluate(pages, fixed.unionByName(rotating))
    return out.select("page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "n_entries", F.array_join("lists", ",").alias("lists"), "blocked")


_OP9_SQL = r"""
with pages_at as (
  select page_id, url, date '2024-01-01' + cast(page_id % 366 as integer) as fetched,
    nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')), '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') as segments
  from pages
), fixed(list, kind, key, action, day) as (values {values}
), hosts as (
  select distinct host, date '2024-01-01' + cast((length(host) * 37 + ascii(host) * 11) % 300 as integer) as begin_at from pages_at where length(host) % 2 = 1
), entries as (
  select list, kind, key, action = 'add' as is_on, cast(day as date) as day from fixed
  union all select 'rotating', 'host', host, true, begin_at from hosts
  union all select 'rotating', 'host', host, false, begin_at + 60 from hosts
), states as (
  select list, kind, key, day, bool_or(is_on) as is_on from entries group by all
), changes as (
  select * from (select *, coalesce(lag(is_on) over (partition by list, kind, key order by day), false) as was_on from states) where is_on <> was_on
), active as (
  select * from (select *, lead(day) over (partition by list, kind, key order by day) as valid_to from changes) where is_on
), met as (
  select p.page_id, p.url, p.fetched, a.list from pages_at p join active a on (
    (a.kind = 'host' and a.key = p.host)
    or (a.kind = 'domain' and (a.key = p.host or ends_with(p.host, '.' || a.key)))
    or (a.kind = 'prefix' and starts_with(array_to_string(list_concat([p.host], p.segments), '/') || '/', a.key || '/')))
    and a.day <= p.fetched and (a.valid_to is null or p.fetched < a.valid_to)
), found as (
  select page_id, url, fetched, count(*) as n, string_agg(distinct list, ',' order by list) as lists from met group by all
)
select p.page_id, p.url, p.host, cast(p.fetched as varchar) as fetched, coalesce(f.n, 0) as n_entries, coalesce(f.lists, '') as lists, f.n is not null as blocked
from pages_at p left join found f on p.page_id = f.page_id and p.url = f.url and p.fetched = f.fetched
"""


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD, _WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

_OP2_SQL = f"""
with items as (
  select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("text")}, '{_ITEM_WORD}') as ws from benchmark where item_id is not null
), windows as (
  select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as k from (select item, ws, least(13, len(ws)) as n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) as i from items where len(ws) > 0)
), docs as (
  select doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ITEM_WORD}') as ws from documents
), starts as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as k from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from docs, (select distinct n from windows) where len(ws) >= n)
), met as (
  select s.doc_id, s.i, s.n, w.item from starts s join windows w on s.n = w.n and s.k = w.k
), hits as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as pos from met) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from met) group by doc_id
)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from docs d left join hits using (doc_id) left join found using (doc_id)
"""

_OP3_SQL = f"""
with recursive docs as (
  select doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') as ws from documents
), sets as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from docs where len(ws) > 0)
), sizes as (
  select d.doc_id, count(g) as n from docs d left join sets using (doc_id) group by d.doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)
), reach as (
  select doc_id, doc_id as root from docs union select l.y, r.root from reach r join links l on r.doc_id = l.x
)
select s.doc_id, s.n as n_shingles, min(r.root) as component_id from sizes s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.n
"""

_OP4_SQL = f"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents
), windows as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) as i from docs where len(ws) >= 13)
), least_of as (
  select k, min(doc_id) as least from windows group by k
), gone as (
  select distinct w.doc_id, unnest(generate_series(i, i + 12)) as pos from windows w join least_of l on w.k = l.k where l.least < w.doc_id
), words as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from docs
), kept as (
  select doc_id, string_agg(word, ' ' order by pos) as text from words anti join gone using (doc_id, pos) group by doc_id
), removed as (
  select doc_id, count(*) as n from gone group by doc_id
)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(r.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join removed r using (doc_id) left join kept k using (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op5_byte_level_bpe": op5_byte_level_bpe,
    "op6_token_files": op6_token_files,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_language_id": op8_language_id,
    "op9_url_filters": op9_url_filters,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "op4_substring_dedup": op4_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2_SQL,
    "op3_ngram_jaccard_join": _OP3_SQL,
    "op4_substring_dedup": _OP4_SQL,
    "op9_url_filters": _OP9_SQL.format(values=", ".join(f"('{a}', '{b}', '{c.rstrip('/')}', '{d}', '{e}')" for a, b, c, d, e in URL_ENTRIES)),
}
