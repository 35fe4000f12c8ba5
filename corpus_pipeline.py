"""From raw documents to token ids: five stages over the ``documents`` table.

Each stage is one operator of ``larder.llm`` and works on all that its
predecessor kept.  ``run`` writes each stage's result as Parquet in the shared
folder and reads it again, so a lost executor costs one stage at most.

All stages but the last return rows of their input as they are, with all columns
whatever their names.  A null text is empty; texts of any length are read whole;
an empty table stays empty.  Rows that repeat each other stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import bpe, decontaminate, exact_dedup, quality, simhash
from larder.llm.common import stored

RANK_FILE = "byte_bpe_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from the labels of ``sf_dir``.

    Empty texts are scored like others.  Without labels for any row, all stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id; a null id is the largest."""
    return exact_dedup.one_of_each(docs)


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, Jaccard 0.8): the smallest id.

    Texts without words are near-duplicates of each other.  Rows of one id stay or go together.
    """
    return simhash.one_of_each(docs, groups=simhash.near_groups)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its budget of edits; rows of one id stay or go together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each row left; an empty text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", distinct),
    ("simhash", not_near),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]

#: SQL has no word for fingerprints, edit distance or merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
