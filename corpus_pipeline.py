"""The corpus pipeline: stages that each apply one operator of tallymark.llm to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, language_id, mixing, ngram_join, substring_dedup
from tallymark.llm.common import materialize, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Predictions less sure than this are rejected.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and whose predicted language is sure enough; missing languages are filled in.

    Where no row is labelled nothing can be predicted: then all rows with a letter stay as they are.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    rows = language_id.predict_language(docs, keep=list(COLUMNS), model=model)
    kept = rows.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each component of the Jaccard join; rows without a doc_id stay."""
    gone = ngram_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier string of 100 bytes repeats; texts of which nothing is left go."""
    rows = substring_dedup.remove_repeats(docs, texts=True, keep=("lang", "source"))
    return rows.where("n_removed = 0 OR n_removed < n_bytes").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    rows = mixing.mix(mixing.sized_documents(docs, "text", "lang", "source", "n_chars"), spread=("text_hash",))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of the text decoded from the ids) of each row."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("bpe_words", tokens),
]
#: Stages are iterative or learned; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
