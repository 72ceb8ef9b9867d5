"""The corpus pipeline: documents through five operators of lodeseek.llm, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; run()
writes each stage's result to the shared folder and reads it back as the next one's docs. All
stages but the last return the columns of documents. No stage has SQL: quality rules and language
models are learned, and SQL can't express them; tests hold the stages against brute force.

Rows with nulls, empty or very long texts, repeated rows and empty tables have the results that
the operators' own modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import byte_bpe, language_id, mixing, near_dedup, quality_rules
from lodeseek.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep. The list is learned from those of docs that labels covers."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return quality_rules.judge(docs, "text", COLUMNS, rules).where("kept").select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told (not `und`) with a score of MIN_SCORE or more; a null lang becomes the predicted one."""
    model = language_id.learn(docs, "doc_id", "text", "lang")
    told = language_id.predict(docs, "doc_id", "text", model, tuple(COLUMNS[1:]))
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return near_dedup.deduplicated(docs, "doc_id", "text").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each epoch."""
    return mixing.mixed(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token ids, and whether they decode to the text."""
    path, pattern = byte_bpe.default_vocabulary()
    marked = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).alias("row"), "text")
    coded = byte_bpe.encode(marked, "row", "text", byte_bpe.load(spark, path), pattern, as_array=True)
    return coded.select("row.doc_id", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("row.digest")).alias("decodes"))


STAGES = [
    ("quality rules", quality),
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("byte-level BPE", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
