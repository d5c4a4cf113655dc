from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarrylens.llm import exact_dedup, quality, simhash, toxicity

from ..conftest import SF

SF01 = SF.replace("0.001", "0.01")


def test_each_stage_against_its_operator(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    order = [name for name, _ in cp.STAGES]
    assert order == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = cp.toxicity_stage(spark, docs, SF01)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(toxicity.scored(docs, toxicity.train(docs, labels)).where("score < 0.3"))
    kept = cp.quality_stage(spark, docs, SF01)
    assert kept.columns == docs.columns and ids(kept) == ids(quality.scored(docs, quality.train(docs, labels)).where("score >= 0.5"))
    kept = cp.exact_dedup_stage(spark, docs, SF01)
    assert kept.columns == docs.columns and ids(kept) == ids(exact_dedup.exact_groups(docs).where("kept"))
    near = cp.near_dedup_stage(spark, docs, SF01)
    assert near.columns == docs.columns and ids(near) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_run(spark):
    out = cp.run(spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()


def test_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    none = lambda kind: F.lit(None).cast(kind)
    odd = docs.limit(2).select(none("long").alias("doc_id"), none("string").alias("text"), "lang", "source", "n_chars").unionByName(docs.limit(1).withColumn("text", F.lit("")))
    odd = odd.unionByName(docs.limit(1).withColumns({"text": F.repeat(F.lit("a plain word "), F.lit(60_000)), "doc_id": none("long")}))
    odd = docs.limit(20).unionByName(odd).withColumns({"score": F.lit("s"), "__score": F.lit(1), "h": F.lit(2), "row_a": F.lit(3), "fp": F.lit(4), "a.b": F.lit(5)})
    for _, stage in cp.STAGES:
        kept = stage(spark, odd, SF01)
        assert stage is cp.packing_stage or kept.columns == odd.columns
        assert kept.where("doc_id IS NULL").count() > 0
        assert stage(spark, odd.limit(0), SF01).count() == 0
    for stage in (cp.toxicity_stage, cp.quality_stage):
        assert {(r["score"], r["__score"]) for r in stage(spark, odd, SF01).collect()} == {("s", 1)}  # the input's own columns are untouched


def test_near_duplicates_with_null_and_repeated_ids(spark):
    t, u = ("the quick brown fox jumps over lazy dogs near %s of a river bank today " % x * 9 for x in ("mill", "ford"))
    rows = [(3, t), (7, t), (None, t), (5, u), (None, u.upper()), (None, "quite another text about ships and sails"), (5, "the second text of one id, on trains"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in cp.near_dedup_stage(spark, docs, SF01).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(3, t), (5, u), rows[5], rows[6], next(k for k in kept if not k[1])]))
    again = cp.near_dedup_stage(spark, docs.unionByName(docs), SF01)
    assert again.count() == len(kept)  # repeated rows are one document
