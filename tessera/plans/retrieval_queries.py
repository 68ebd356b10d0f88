"""Registered queries over vectors, citations and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grounding, metrics, rules, vector
from ..operators.vector_index import VectorIndex
from ..sources.store import shared_folder
from .common import PROBES_SQL, probes, table
from .document_queries import _EMAIL, _ESCALATION_SQL, _ID, _PHONE, _RE

QUERIES, ORACLE_SQL = {}, {}
_COS = "list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""select * from (select vec_id, label, round({_COS.format(a="embedding", b="(select embedding from embeddings where vec_id = 0)")}, 6) as similarity from embeddings where label = 3 order by {_COS.format(a="embedding", b="(select embedding from embeddings where vec_id = 0)")} desc, vec_id limit 8) where similarity >= 0.05""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight vectors of one label nearest to vector 0, then the floor."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id = 0").select("embedding").first()
    found = vector.top_k(vectors, asked["embedding"] if asked else [], 8, F.col("label") == 3)
    return vector.apply_floor(found, 0.05).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(ORACLE_SQL["vector_topk_filtered"])
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index of cells, built over all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id = 0").select("embedding").first()
    index = VectorIndex.build(vectors, shared_folder(spark, "index"))
    found = index.search(asked["embedding"] if asked else [], 8, F.col("label") == 3)
    return vector.apply_floor(found, 0.05).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


_RANKED = f"""ranked as (
  select q.vec_id as query_id, q.label as query_label, v.vec_id, v.label, row_number() over (partition by q.vec_id order by {_COS.format(a="v.embedding", b="q.embedding")} desc, v.vec_id) as rank,
    {_COS.format(a="v.embedding", b="q.embedding")} as similarity from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)"""


def _retrieved(spark: SparkSession, sf_dir: str, **given) -> tuple[DataFrame, DataFrame]:
    """The eight nearest of every vector whose id is divisible by 50: the stated query set."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    return vector.batch_top_k(vectors, asked, **given), asked


@query(f"with {_RANKED} select query_id, cast(rank as integer) as rank, vec_id, round(similarity, 6) as similarity from ranked where rank <= 8")
def batch_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir)[0].select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with {_RANKED}, firsts as (select query_id, min(case when label = query_label then rank end) as first_rank from ranked where rank <= 8 group by query_id)
select avg(case when first_rank <= 1 then 1.0 else 0.0 end) as hit_rate_at_1, avg(case when first_rank <= 3 then 1.0 else 0.0 end) as hit_rate_at_3, avg(case when first_rank <= 5 then 1.0 else 0.0 end) as hit_rate_at_5,
  avg(case when first_rank <= 8 then 1.0 else 0.0 end) as hit_rate_at_8, round(avg(coalesce(1.0 / first_rank, 0.0)), 9) as mrr, count(*) as questions from firsts""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question is an id with a rank; of rows that share it, each judges its ranks by its own label."""
    found, _ = _retrieved(spark, sf_dir, query_columns=["query_label"])
    ranks = metrics.first_ranks(found.withColumn("hit", F.col("label") == F.col("query_label")))
    return metrics.retrieval_metrics(ranks, 8).withColumn("mrr", F.round("mrr", 9))


@query("""select v.vec_id, i - 1 as position, round(v.e[i] / sqrt(list_dot_product(v.e, v.e)), 6) + 0.0 as component from (select vec_id, cast(embedding as double[]) as e from embeddings) v, unnest(generate_series(1, len(v.e))) as u(i)""")
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector at unit length."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.normalize(F.col("embedding"))).alias("position", "x"))
    return rows.select("vec_id", F.col("position").cast("long").alias("position"), (F.round("x", 6) + 0.0).alias("component"))


_ZERO = """select cast(-1 as bigint) as vec_id, list_transform(embedding, lambda x: cast(0 as double)) as e, 3 as label from embeddings where vec_id = 0 union all select cast(-2 as bigint), list_transform(embedding, lambda x, i: case when i = 2 then cast('nan' as double) else x end), 3 from embeddings where vec_id = 0
  union all select cast(-3 as bigint), list_transform(embedding, lambda x, i: case when i = 2 then cast('inf' as double) else x end), 3 from embeddings where vec_id = 0 union all select vec_id, cast(embedding as double[]), label from embeddings"""


@query(f"""with v as ({_ZERO}), q as (select e from v where vec_id = 0), s as (select vec_id, label, case when len(list_filter(v.e, lambda x: not isfinite(x))) > 0 then null when list_dot_product(v.e, v.e) = 0 then 0.0 else list_cosine_similarity(v.e, q.e) end as s from v, q where label = 3)
select vec_id, round(s, 6) + 0.0 as similarity, round(1 - s, 6) + 0.0 as distance, round(1 - (1 - s), 6) + 0.0 as again from s""")
def similarity_with_zero_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of one label, a zero vector and two with a component that is not finite by similarity to vector 0, and back from the distance."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    first, three = v.filter("vec_id = 0"), F.lit(3).cast(v.schema["label"].dataType).alias("label")
    made = lambda i, change: first.select(F.lit(i).cast("long").alias("vec_id"), F.transform("embedding", change).alias("embedding"), three)
    odd = made(-1, lambda x: F.lit(0.0))
    odd = odd.unionByName(made(-2, lambda x, k: F.when(k == 1, float("nan")).otherwise(x))).unionByName(made(-3, lambda x, k: F.when(k == 1, float("inf")).otherwise(x)))
    asked = first.select(F.lit(-9).cast("long").alias("query_id"), F.col("embedding").alias("query"))
    found = vector.batch_top_k(v.unionByName(odd).filter("label = 3"), asked, 1 << 30)
    distance = 1 - F.col("similarity")
    return found.select("vec_id", (F.round("similarity", 6) + 0.0).alias("similarity"), (F.round(distance, 6) + 0.0).alias("distance"), (F.round(vector.similarity_of(distance), 6) + 0.0).alias("again"))


_HITS = """hits as (select doc_id, 'd' || (doc_id % 7) as doc, 'd' || (doc_id % 5) as expected_doc, lang || ' > Part ' || (doc_id % 3) as path, text, case doc_id % 4 when 0 then null when 1 then '' when 2 then 'PART 1' else 'The' end as section from documents),
judged as (select *, doc = expected_doc and (coalesce(section, '') = '' or contains(lower(path), lower(section)) or contains(lower(text), lower(section))) as hit from hits)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieved chunks, with a document and a section that their number says to expect."""
    n = F.col("doc_id")
    section = F.when(n % 4 == 1, "").when(n % 4 == 2, "PART 1").when(n % 4 == 3, "The")
    path = F.concat(F.col("lang"), F.lit(" > Part "), n % 3)
    hit = metrics.is_hit(F.concat(F.lit("d"), n % 7), path, F.col("text"), F.concat(F.lit("d"), n % 5), section)
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("hit"))


@query(f"with {_HITS} select doc_id, coalesce(hit, false) as hit from judged")
def expected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


@query(f"with {_HITS} select doc_id from judged where not coalesce(hit, false)")
def missed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.misses(_judged(spark, sf_dir).withColumnRenamed("hit", "correct")).select("doc_id")


_CITED_SQL = """cited as (select vec_id, case when vec_id % 6 = 0 then [] when vec_id % 6 = 1 then [vec_id + 1, vec_id + 2] when vec_id % 6 = 2 then [vec_id, -1] else [-vec_id - 1] end as cites,
  [vec_id, vec_id + 1, vec_id + 7] as retrieved, vec_id % 5 = 0 as insufficient from embeddings)"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of answers: none, some of what was retrieved, or invented ones."""
    n = F.col("vec_id")
    ids = F.when(n % 6 == 0, F.array().cast("array<bigint>")).when(n % 6 == 1, F.array(n + 1, n + 2)).when(n % 6 == 2, F.array(n, F.lit(-1).cast("long"))).otherwise(F.array(-n - 1))
    cites = F.transform(ids, lambda i: F.struct(i.alias("chunk_id")))
    return table(spark, sf_dir, "embeddings").select("vec_id", cites.alias("cites"), F.array(n, n + 1, n + 7).alias("retrieved"), (n % 5 == 0).alias("insufficient"))


@query(f"""with {_CITED_SQL}, good as (select *, list_filter(cites, lambda c: list_contains(retrieved, c)) as good from cited)
select vec_id, array_to_string(case when insufficient or (len(cites) > 0 and len(good) = 0) then [] else good end, ',') as citations, insufficient or (len(cites) > 0 and len(good) = 0) as insufficient from good""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grounding.check(F.col("cites"), F.col("retrieved"), F.col("insufficient"))
    rows = _cited(spark, sf_dir).select("vec_id", g.alias("g"))
    return rows.select("vec_id", F.array_join(F.transform("g.citations", lambda c: c["chunk_id"].cast("string")), ",").alias("citations"), "g.insufficient")


@query(f"""with {_CITED_SQL}, good as (select *, list_filter(cites, lambda c: list_contains(retrieved, c)) as good from cited)
select vec_id, case when vec_id % 9 = 0 or (insufficient and len(good) = 0) then 'canned' else 'answer ' || vec_id end as text, vec_id % 9 = 0 or insufficient as insufficient from good""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("vec_id") % 9 != 0, F.concat(F.lit("answer "), F.col("vec_id")))
    a = grounding.accept_answer(answer, F.col("cites"), F.col("retrieved"), F.col("insufficient"), "canned")
    return _cited(spark, sf_dir).select("vec_id", a.alias("a")).select("vec_id", "a.text", "a.insufficient")


@query(f"with {_CITED_SQL} select vec_id, unnest(list_filter(cites, lambda c: list_contains(retrieved, c))) as chunk_id from cited")
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cited(spark, sf_dir)
    cites = rows.select(F.col("vec_id").alias("answer_id"), F.explode("cites.chunk_id").alias("chunk_id"))
    kept = grounding.verify_rows(cites, rows.select(F.col("vec_id").alias("answer_id"), F.explode("retrieved").alias("chunk_id")))
    return kept.select(F.col("answer_id").alias("vec_id"), "chunk_id")


@query("""with r as (select page_id // 10 as query_id, page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, row_number() over (partition by page_id // 10, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|[.])example[.](org|net)$') order by page_id % 10, url) as k from pages)
select query_id, page_id, url from r where regexp_matches(host, '(^|[.])example[.](org|net)$') and k <= 3""")
def allowed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web results, ten a query: three of the allowed hosts stay."""
    results = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("query_id"), (F.col("page_id") % 10).alias("rank"), "page_id", "url")
    return grounding.allowed_results(results, ["example.org", "example.net"], 3).select("query_id", "page_id", "url")


@query("""select page_id, case when page_id % 7 = 0 then 'no result' else 'answer' end as text, case when page_id % 7 = 0 then 'none' else 'web' end as source, case when page_id % 7 = 0 then 0 else 1 end as cited,
  case when page_id % 7 = 0 then null else substr(html, 1, 300) end as snippet from pages""")
def web_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = F.array(F.struct(F.col("url"), F.lit("").alias("title"), F.col("html").alias("content")))
    a = grounding.shape_web_answer(F.lit("answer"), results, F.col("page_id") % 7 == 0, "no result")
    rows = table(spark, sf_dir, "pages").select("page_id", a.alias("a"))
    return rows.select("page_id", "a.text", "a.source", F.size("a.web_citations").alias("cited"), F.try_element_at(F.col("a.web_citations"), F.lit(1))["snippet"].alias("snippet"))


@query(f"""with {_RANKED}, kept as (select query_id, count(*) filter (rank <= 8 and similarity >= 0.3) as n from ranked group by query_id)
select query_id, case when n = 0 then 'canned' else 'answer' end as text, n = 0 or query_id % 3 = 0 as insufficient, case when n = 0 or query_id % 3 = 0 then 0 else cast(n as integer) end as chunks from kept""")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, asked = _retrieved(spark, sf_dir)
    kept = vector.apply_floor(found, 0.3).groupBy("query_id").agg(F.collect_list("vec_id").alias("chunks"))
    rows = asked.select("query_id").join(kept, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<bigint>")))
    answer = F.struct(F.lit("answer").alias("text"), (F.col("query_id") % 3 == 0).alias("insufficient"))
    return rows.select("query_id", vector.answer_gate(F.col("chunks"), answer, "canned").alias("g")).select("query_id", "g.text", "g.insufficient", F.size("g.chunks").alias("chunks"))


@query(f"""with {_RANKED} select query_id, sha256(string_agg('[' || vec_id || ' | label | ' || label || ']' || chr(10) || 'text ' || vec_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as context_sha256 from ranked where rank <= 8 group by query_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _retrieved(spark, sf_dir)
    one = F.struct("rank", F.col("vec_id").cast("string").alias("chunk_id"), F.lit("label").alias("title"), F.col("label").cast("string").alias("section_path"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"))
    return found.groupBy("query_id").agg(F.sha2(T.context_block(F.array_sort(F.collect_list(one))), 256).alias("context_sha256"))


@query("""with r as (select l.doc_id, case when l.toxic = 1 then 'toxic' else d.lang end as category, (length(d.text) % 2 = 0) = (l.quality = 1) as correct from labels l join documents d using (doc_id))
select category, count(*) as total, cast(sum(case when correct then 1 else 0 end) as bigint) as correct, round(sum(case when correct then 1 else 0 end) / count(*), 9) as rate, grouping(category) = 1 as overall from r group by grouping sets ((category), ())""")
def grouped_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a rule (an even length) agrees with the quality label, by group and over all."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang")).alias("category"), ((F.length("text") % 2 == 0) == (F.col("quality") == 1)).alias("correct"))
    return metrics.correctness(rows).withColumn("rate", F.round("rate", 9))


@query(f"""with e as (select id, rule is not null as flag, rule, id % 2 = 1 as expected_flag, case when id % 2 = 1 then case when id % 3 = 0 then 'mandatory_category' else 'danger_scan' end end as expected_rule from {_ESCALATION_SQL})
select id, flag, rule, flag = expected_flag and rule is not distinct from expected_rule as correct from e""")
def escalation_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.escalation(F.col("text"), F.col("category"), F.col("severity"))
    odd = F.col("id") % 2 == 1
    expected = F.when(odd, F.when(F.col("id") % 3 == 0, "mandatory_category").otherwise("danger_scan"))
    rows = probes(spark, sf_dir).select("id", d.alias("d"), expected.alias("expected"), odd.alias("odd")).select("id", F.col("d.escalate").alias("flag"), "d.rule", "odd", "expected")
    return rows.select("id", "flag", "rule", metrics.escalation_correct(F.col("odd"), F.col("expected"), F.col("flag"), F.col("rule")).alias("correct"))


@query(f"""with p as (select id, case id % 5 when 0 then 'injection' when 1 then 'toxicity' when 2 then 'pii' when 3 then 'complaint_exempt' else 'off_topic' end as category, regexp_matches(text, '{_RE["injection"]}') or regexp_matches(text, '{_RE["abuse"]}') as blocked, id > 12 as expected_blocked,
  concat_ws(',', case when regexp_matches(text, '{_EMAIL}') then 'email' end, case when regexp_matches(text, '{_PHONE}') then 'phone' end, case when regexp_matches(text, '{_ID}') then 'employee_id' end) as found, case when id in (15, 12) then 'email,phone,employee_id' else '' end as expected from {PROBES_SQL})
select coalesce(avg(case when category in ('injection', 'toxicity') then case when blocked = expected_blocked then 1.0 else 0.0 end end), 0) as block_rate, coalesce(avg(case when category = 'pii' then case when found = expected then 1.0 else 0.0 end end), 0) as pii_rate,
  coalesce(avg(case when category = 'complaint_exempt' then case when blocked = expected_blocked then 1.0 else 0.0 end end), 0) as exempt_rate, coalesce(avg(case when category = 'off_topic' then case when blocked then 1.0 else 0.0 end end), 0) as off_topic_rate from p""")
def guardrail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import patterns as P

    t, n = F.col("text"), F.col("id")
    category = F.when(n % 5 == 0, "injection").when(n % 5 == 1, "toxicity").when(n % 5 == 2, "pii").when(n % 5 == 3, "complaint_exempt").otherwise("off_topic")
    expected = F.when(n.isin(15, 12), F.array(F.lit("phone"), F.lit("employee_id"), F.lit("email"))).otherwise(F.array().cast("array<string>"))
    return metrics.guardrail_metrics(probes(spark, sf_dir).select(category.alias("category"), (P.is_injection(t) | P.is_abusive(t)).alias("blocked"), (n > 12).alias("expected_blocked"), P.personal_labels(t).alias("labels"), expected.alias("expected_labels")))
