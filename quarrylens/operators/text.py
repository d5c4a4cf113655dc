"""Token-set similarity join of two tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are left out when claims are compared; results depend on this very list.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "to", "and", "or", "for", "with", "that", "this", "it", "be", "by", "at", "as", "from", "no", "not"]


def tokens(text: Column) -> Column:
    """Distinct words of more than two letters or digits, lower case, without stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def match_claims(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", threshold: float = 0.4) -> DataFrame:
    """Best partner of each left text by Jaccard similarity of tokens, if at least the threshold, ties by id; a pair is
    ``mutual`` when each is the other's best.

    Pairs meet on a token, counts of shared tokens come from the join. Of each set only its rarest tokens are
    posted: two sets with similarity t share one of the |set| - ceil(t |set|) + 1 rarest of either, so frequent words make
    no pairs and none is lost. Texts with the same set of tokens are one row in all this, that with the smallest id,
    which is also the one that ties prefer.
    """
    mine = left.select(F.col(left_id).alias("__id"), F.array_sort(tokens(F.col(text))).alias("a")).where(F.size("a") > 0)
    a = mine.groupBy("a").agg(F.min("__id").alias("left_id"))
    b = right.select(F.col(right_id).alias("__id"), F.array_sort(tokens(F.col(text))).alias("b")).where(F.size("b") > 0)
    b = b.groupBy("b").agg(F.min("__id").alias("right_id"))
    words = a.select(F.explode("a").alias("w")).unionByName(b.select(F.explode("b").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))

    def posted(side: DataFrame, key: str, tokens_: str) -> DataFrame:
        rows = side.select(key, F.size(tokens_).alias("n"), F.explode(tokens_).alias("w")).join(words, "w")
        order = Window.partitionBy(key).orderBy("df", "w")
        kept = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
        return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= kept).select(key, "w")

    pairs = posted(a, "left_id", "a").join(posted(b, "right_id", "b"), "w").select("left_id", "right_id").distinct()
    shared = F.size(F.array_intersect("a", "b"))
    scored = pairs.join(a, "left_id").join(b, "right_id").withColumn("similarity", shared / (F.size("a") + F.size("b") - shared)).where(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")
    best = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), other))
    both = scored.withColumns({"kl": best("left_id", "right_id"), "kr": best("right_id", "left_id")})
    found = both.where("kl = 1").select("left_id", "right_id", "similarity", (F.col("kr") == 1).alias("mutual"))
    all_left = mine.join(a, "a").select(F.col("__id"), "left_id")
    return all_left.join(found, "left_id").select(F.col("__id").alias("left_id"), "right_id", "similarity", (F.col("mutual") & (F.col("__id") == F.col("left_id"))).alias("mutual"))


def claim_status(left: DataFrame, right: DataFrame, matches: DataFrame, left_id: str, right_id: str, verdict: str) -> DataFrame:
    """(left_id, right_id, status): agreement or conflict of matched claims by the column ``verdict``, else only-left or only-right.
    A draft (or no verdict) takes no position, so it is in conflict with none."""
    a = left.select(F.col(left_id).alias("left_id"), F.col(verdict).alias("va"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(verdict).alias("vb"))
    pairs = matches.select("left_id", "right_id").join(a, "left_id", "right").join(b, "right_id", "full")
    status = F.when(F.col("left_id").isNull(), "only-right").when(F.col("right_id").isNull(), "only-left").when((F.col("va") != F.col("vb")) & (F.col("va") != "draft") & (F.col("vb") != "draft"), "conflict").otherwise("agreement")
    return pairs.select("left_id", "right_id", status.alias("status"))
