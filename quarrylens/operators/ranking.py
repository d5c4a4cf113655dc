"""Ranks, row numbers and running sums over whole tables without a window in one task.

A few boundaries of the order column cut the rows into buckets; each bucket is windowed by itself, and the
totals of the buckets before it (a handful of rows) are added.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_double, as_timestamp, kind_of
from quarrylens.sources.shared import written


def sortable(df: DataFrame, field: str) -> Column | None:
    """The column as a double that keeps its order: numbers as they are, times in microseconds; None for texts."""
    kind = kind_of(df, field).simpleString()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(as_timestamp(df, field).cast("timestamp")).cast("double")
    return None if kind == "string" else as_double(df, field)


def _along(df: DataFrame, field: str, descending: bool) -> Column | None:
    key = sortable(df, field)
    return -key if descending and key is not None else key


#: Rows of one bucket, and how many buckets literal boundaries serve; beyond them buckets are range partitions.
ROWS_PER_BUCKET, MOST_EDGES = 1_000_000, 64
#: Buckets whose offsets are broadcast (some 24 bytes each), and buckets of one group of the prefix scan.
BROADCAST_BUCKETS, FAN = 100_000, 1024


def with_bucket(df: DataFrame, order: Column | None, by: Column, row_id: list[str], rows_per_bucket: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``__bucket``: 0, 1, ... in the order of ``order``, nulls after all others, and how many buckets there are. Their number
    follows the number of rows, so a window over one stays small. ``by`` is the sort expression of the windows; ``order`` is the
    same as a number, None for a text.

    Numbers with up to some dozen buckets have approximate quantiles as boundaries, and equal values share a bucket.
    Beyond, for texts, and where nulls or one value alone are more than a bucket (it then stands at several quantiles), the
    table is range-partitioned by the sort expression itself and the row id, so even equal values are spread, and written
    once: every reader sees the same partitions. Both give the same results."""
    per = rows_per_bucket or ROWS_PER_BUCKET
    if order is None:
        rows, known, edges = df.count(), 0, None
    else:
        points = [i / MOST_EDGES for i in range(1, MOST_EDGES)]
        rows, known, edges = df.agg(F.count("*"), F.count(order), F.percentile_approx(order, points, 2000)).first()
    most = max(Counter(edges or []).values(), default=0)
    if order is None or rows > per * MOST_EDGES or rows - known > per or (most > 1 and most * known > per * MOST_EDGES):
        n = max(1, -(-rows // per))
        return written(df.repartitionByRange(n, by, *row_id).withColumn("__bucket", F.spark_partition_id()), "ranged"), n
    edges = sorted(set(edges or []))
    inside = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < order)) if edges else F.lit(0)
    return df.withColumn("__bucket", F.when(order.isNull(), len(edges) + 1).otherwise(inside).cast("int")), len(edges) + 2


def add_offsets(df: DataFrame, buckets: int, partition: list[str], amount: Column, out: str) -> DataFrame:
    """Adds to ``out`` the sum of ``amount`` over the earlier buckets (of the same partition). The totals have one
    row for each bucket and partition, and are summed up in two steps: within groups of ``FAN`` buckets, and over the groups."""
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.col("__bucket") / FAN)
    totals = df.groupBy(*partition, "__bucket").agg(F.sum(amount).alias("__amount")).withColumn("__group", group)
    totals = totals.withColumn("__offset", F.sum("__amount").over(earlier(*partition, "__group").orderBy("__bucket")))
    if buckets > FAN:
        groups = totals.groupBy(*partition, "__group").agg(F.sum("__amount").alias("__amount"))
        groups = groups.withColumn("__above", F.sum("__amount").over(earlier(*partition).orderBy("__group")))
        renamed = groups.select(*[F.col(p).alias(f"__p_{p}") for p in partition], F.col("__group").alias("__g"), "__above")
        totals = totals.join(renamed, (F.col("__group") == F.col("__g")) & _all(F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in partition))
        totals = totals.withColumn("__offset", F.coalesce("__offset", F.lit(0)) + F.coalesce("__above", F.lit(0))).drop("__g", *[f"__p_{p}" for p in partition])
    offsets = totals.select(*[F.col(p).alias(f"__p_{p}") for p in partition], F.col("__bucket").alias("__b"), "__offset")
    if not partition and buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    joined = df.join(offsets, (F.col("__bucket") == F.col("__b")) & _all(F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in partition), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("__offset", F.lit(0))).drop("__offset", "__b", *[f"__p_{p}" for p in partition])


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _direction(field: str, descending: bool) -> Column:
    return F.col(field).desc_nulls_last() if descending else F.col(field).asc_nulls_last()


def running_sum(df: DataFrame, amount: Column, order: str, row_id: list[str], out: str, descending: bool = True, partition: list[str] | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """Running sum in the order of a column, nulls last, ties by the row id."""
    rows, buckets = with_bucket(df.withColumn("__value", amount), _along(df, order, descending), _direction(order, descending), row_id, rows_per_bucket)
    window = Window.partitionBy(*(partition or []), "__bucket").orderBy(_direction(order, descending), *row_id).rowsBetween(Window.unboundedPreceding, 0)
    return add_offsets(rows.withColumn(out, F.sum("__value").over(window)), buckets, partition or [], F.col("__value"), out).drop("__value", "__bucket")


def row_number(df: DataFrame, order: str, row_id: list[str], out: str = "__row_id", descending: bool = False) -> DataFrame:
    """1, 2, ... over the whole table in the order of a column, ties by the row id."""
    return running_sum(df, F.lit(1).cast("long"), order, row_id, out, descending)


def rank(df: DataFrame, field: str, out: str, descending: bool = True, rows_per_bucket: int | None = None) -> DataFrame:
    """RANK over the whole table, nulls last and tied with each other. Ranks are found on the distinct values with
    their counts, so heavy ties are one row each, and joined back. Values with more rows than a bucket (rows / bucket of them at
    most, broadcast) are dealt over several salts in that join."""
    per = rows_per_bucket or ROWS_PER_BUCKET
    values = df.groupBy(F.col(field).alias("__v")).agg(F.count("*").alias("__n"))
    parts = F.ceil(F.col("__n") / per).cast("int")
    hot = values.where(F.col("__n") > per).select(F.col("__v").alias("__h"), parts.alias("__parts"))
    values, buckets = with_bucket(values, _along(values, "__v", descending), _direction("__v", descending), ["__v"], rows_per_bucket)
    window = Window.partitionBy("__bucket").orderBy(_direction("__v", descending)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = add_offsets(values.withColumn(out, F.coalesce(F.sum("__n").over(window), F.lit(0)) + 1), buckets, [], F.col("__n"), out)
    ranked = ranked.select("__v", out, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__s"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = df.join(F.broadcast(hot), F.col(field).eqNullSafe(F.col("__h")), "left").withColumn("__salt", salt).drop("__h", "__parts")
    return dealt.join(ranked, F.col(field).eqNullSafe(F.col("__v")) & (F.col("__salt") == F.col("__s"))).drop("__v", "__s", "__salt")


def percent_rank(df: DataFrame, field: str, out: str, descending: bool = False) -> DataFrame:
    """(rank - 1) / (rows - 1); 0 in a table of one row."""
    n = df.agg(F.count("*").alias("__rows"))
    ranked = rank(df, field, out, descending).crossJoin(F.broadcast(n))
    return ranked.withColumn(out, F.coalesce(F.try_divide((F.col(out) - 1).cast("double"), (F.col("__rows") - 1).cast("double")), F.lit(0.0))).drop("__rows")


def over_all(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Aggregates of the whole table beside every row: one small row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggregates.items()])))
