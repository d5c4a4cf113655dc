"""Corpus pipeline: documents in, packed training windows out. Each stage is written and read again.

Rows without text count as empty texts in every stage. All stages but the last return the columns of their
input, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import exact_dedup, packing, quality, simhash, toxicity
from quarrylens.llm.common import read, unused, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below the threshold (operator 1).

    Null and empty texts have no window and stay. Null and repeated ids are judged by their texts alone."""
    score = unused("score", docs.columns)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents ranked above the quantile cut (operator 5).

    Null and empty texts are judged by their zero features, all alike. Null and repeated ids are judged by their texts alone."""
    score = unused("score", docs.columns)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score).where(F.col(score) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 4): the longest original, then the smallest id, null last.

    Null and empty texts are one group. Of rows equal in text and id one stays."""
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id (operator 6).

    Null and empty texts have one fingerprint and are linked like any other. Rows with null or repeated ids are told
    apart by their texts; of rows equal in both one stays."""
    return simhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens (operator 3); of the columns only doc_id is left.

    Null and empty texts are the end id alone. Null and repeated ids are packed row by row."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifiers, fingerprints and tokens cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
