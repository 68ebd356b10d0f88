"""The corpus pipeline: five training-data operators, each on all that the one before kept.

Documents that are toxic go; of each group of near-duplicates the document with the smallest id stays; word windows that
a smaller id holds are cut out; documents contaminated by the benchmark go; what is left is encoded to token ids and decoded again.

Edge cases
----------
* null, empty or blank texts are neither toxic, near-duplicates nor contaminated: they stay and encode to no ids;
* a null id: the row is judged by its own text where a stage needs no other rows (toxicity, benchmark) and is left as it is by the others;
* repeated ids: rows are told apart by themselves. Of near-duplicate rows with words one stays, and all rows without words; rows with one id and
  different texts all stay, and no row of an id loses windows to another of the same id;
* a text that loses all words stays as an empty one, and so does its row;
* texts of any length are taken whole; empty tables give empty results, and without labels or items nothing goes for their sake;
* extra columns of documents pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score stays below the operator's threshold."""
    from tessera.llm.toxicity import keep_clean

    return keep_clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows, that of the smallest id; rows without an id."""
    from tessera.llm.jaccard import keep_one

    return keep_one(docs)


def cut_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; n_chars, where there is one, follows the text."""
    from tessera.llm.substring import cut_repeated

    out = cut_repeated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds item windows for less than a twentieth of its words."""
    from tessera.llm.decontamination import keep_clean

    return keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row, no other column; ids as little-endian unsigned 32-bit integers, a null
    text as an empty one."""
    import public_tokenizers

    from tessera.llm.bpe import encode

    out = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_windows),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode_tokens),
]

#: The first stage scores with a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
