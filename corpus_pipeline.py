"""A training corpus in five stages, each over all rows that the one before kept.

language_id drops what has no language, line_dedup rewrites texts without frequent lines,
near_dedup keeps one document of each group, decontaminate drops documents that hold a
benchmark window, bpe encodes and decodes what is left.

Defined results: null and empty texts have no language and go in the first stage. Repeated rows
of one id count as one document of line_dedup, stay or go together in near_dedup (the smallest
id of a group stays), and are judged one by one by the others. Rows without an id stay in
near_dedup, as none stands for them. Ties of languages go to the first in name order. An empty
table goes through to an empty result, and an empty benchmark drops nothing. All stages but the
last return exactly the columns of documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm import bpe, decontaminate, language, line_dedup, simhash
from fascicle.llm.common import documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language with a posterior of one half, go."""
    return language.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; n_chars, where there is one, follows the new text. No document goes."""
    out = line_dedup.drop_frequent_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    return simhash.keep_representatives(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of token ids and of the decoded bytes."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_stage),
    ("bpe", encode),
]

#: Language ID and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
