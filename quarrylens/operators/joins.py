"""Attribute joins, membership joins and the alignment of groups by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_double

GEOMETRY = ("geometry", "geom", "wkb_geometry")


def attribute_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Equi-join; the right columns are named r_<name>, the right geometry is dropped."""
    if not left_key or not right_key or how not in ("left", "inner"):
        raise ValueError("a join needs both keys and is left or inner")
    renamed = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns if c not in GEOMETRY])
    return left.join(renamed, F.col(left_key) == F.col(f"r_{right_key}"), how)


def with_membership(df: DataFrame, ids: DataFrame, field: str, flag: str) -> DataFrame:
    """A boolean column: whether the id, as text, is in the table ``ids``."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__in", F.lit(True))
    return df.join(wanted, F.col(field).cast("string") == F.col("__id"), "left").withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__id", "__in")


def materialise_selected(df: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    wanted = ids.select(F.col(ids.columns[0]).alias(field)).distinct()
    return df.join(wanted, field)


def tagged(groups: list[DataFrame], key: str, value: str | None) -> DataFrame:
    """The groups under one another with their number, the key as text and the value as double; null keys are dropped."""
    rows = [g.select(F.lit(i).alias("operand"), F.col(key).cast("string").alias("key"), (as_double(g, value) if value else F.lit(None).cast("double")).alias("value")) for i, g in enumerate(groups)]
    return reduce(DataFrame.unionByName, rows).where("key IS NOT NULL")


def align(groups: list[DataFrame], key: str, value: str, fn: str = "sum") -> DataFrame:
    """One row per key of any group: present_<i>, value_<i>, and for two groups delta. One shuffle for all groups."""
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[fn]
    cells = []
    for i in range(len(groups)):
        mine = F.col("operand") == i
        cells += [F.max(mine).alias(f"present_{i}"), agg(F.when(mine, F.col("value"))).alias(f"value_{i}")]
    out = tagged(groups, key, value).groupBy("key").agg(*cells)
    return out.withColumn("delta", F.col("value_1") - F.col("value_0")) if len(groups) == 2 else out


def aligned_page(groups: list[DataFrame], key: str, value: str, fn: str = "sum", most: int = 250) -> DataFrame:
    """The first rows of the alignment by key, with the total number of keys."""
    all_keys = align(groups, key, value, fn)
    return all_keys.orderBy("key").limit(most).crossJoin(F.broadcast(all_keys.agg(F.count("*").alias("total_keys"))))


def overlaps(groups: list[DataFrame], key: str) -> DataFrame:
    """(a, b, shared): keys that two groups share, for every pair."""
    flags = tagged(groups, key, None).groupBy("key").agg(*[F.max(F.col("operand") == i).alias(f"p{i}") for i in range(len(groups))])
    pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    counts = flags.agg(*[F.count_if(F.col(f"p{i}") & F.col(f"p{j}")).alias(f"n{i}_{j}") for i, j in pairs])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"n{i}_{j}").alias("shared")) for i, j in pairs])))


def difference(a: DataFrame, b: DataFrame, key: str, value: str, fn: str = "sum") -> DataFrame:
    """Keys of both groups with b - a, where both have a value."""
    return align([a, b], key, value, fn).where("present_0 AND present_1 AND delta IS NOT NULL").select("key", "value_0", "value_1", "delta")


def with_column_mean(df: DataFrame, field: str, out: str) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.avg(as_double(df, field)).alias(out))))
