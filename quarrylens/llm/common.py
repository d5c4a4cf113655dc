"""Shared pieces of the training-data operators: tables, batches and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.shared import shared_dir, written

__all__ = ["ASCII_SPACE", "fold", "labelled_texts", "read", "sampled_labels", "shared_dir", "small_batches", "tasks_for", "unused", "written"]

#: ASCII white space of the word contract, [\x20\x09-\x0D], as a Java and Python regex class.
ASCII_SPACE = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, a setting of the session from then on. Spark also ends a batch at
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), so very long texts come a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sampled_labels(labels: DataFrame, label: str, in_training: Column, each: int | None) -> DataFrame:
    """At most ``each`` labelled ids of each class of the training fold, chosen by hash: a bounded table. All with None."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & in_training).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    if each is None:
        return rows
    pick = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return pick(0).unionByName(pick(1))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, each: int | None = None) -> DataFrame:
    """(doc_id, text, label) of the sampled ids, or of all, one row for each: of an id that several rows have, the first text in order."""
    ids = sampled_labels(labels, label, in_training, each)
    ids = ids if each is None else F.broadcast(ids)  # at most 2 x each rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first of its lengthened forms that is no column yet (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
