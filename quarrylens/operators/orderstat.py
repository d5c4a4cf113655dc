"""Exact order statistics and distinct counts, of whole tables or of groups, without a group in one buffer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.sources.shared import written


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row for each combination of the keys; null is a value."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


#: A bucket with at most so many rows is settled by its values at once; more are told apart by their next bits first.
BUCKET = 500_000
#: Bits of a round, and (group, column, bucket) targets that are broadcast; more are joined by a shuffle.
STEP, TARGETS = 16, 100_000


def with_sort_keys(df: DataFrame, keep: list[str], values: list[Column]) -> tuple[DataFrame, list[str]]:
    """``keep`` and for each value, a double, a long of the same order: sign, exponent and fraction as IEEE 754 has them, by
    arithmetic, in steps so that nothing is computed twice. Zeros are one value; NaN is above all numbers, as in every
    sort of Spark; null stays null."""
    n = range(len(values))
    out = df.select(*keep, *[v.cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    for step in (
        "abs(__v{i}) AS __a{i}",
        "greatest(least(floor(log2(__a{i})), 1023), -1022) AS __r{i}",
        "__a{i} / pow(2.0D, __r{i}) AS __p{i}",  # between 1 and 2, or the logarithm was off by a hair
        "__r{i} + CASE WHEN __p{i} >= 2 THEN 1 WHEN __p{i} < 1 AND __r{i} > -1022 THEN -1 ELSE 0 END AS __e{i}",
        f"""CASE WHEN isnan(__v{{i}}) OR __v{{i}} IS NULL THEN NULL WHEN __a{{i}} = 0 THEN 0L WHEN __a{{i}} = double('Infinity') THEN {2047 << 52}L
         WHEN __a{{i}} < {2.0**-1022!r}D THEN CAST(__a{{i}} * {2.0**537!r}D * {2.0**537!r}D AS BIGINT)
         ELSE (__e{{i}} + 1022) * {1 << 52}L + CAST(__a{{i}} / pow(2.0D, __e{{i}}) * {float(1 << 52)!r}D AS BIGINT) END AS __s{{i}}""",
        f"CASE WHEN __v{{i}} IS NULL THEN NULL WHEN isnan(__v{{i}}) THEN {(1 << 63) - 1}L WHEN __v{{i}} < 0 THEN -__s{{i}} ELSE __s{{i}} END AS __key{{i}}",
    ):
        out = out.selectExpr("*", *[step.format(i=i) for i in n])
    return out.select(*keep, *[f"__key{i}" for i in n]), [f"__key{i}" for i in n]


def from_sort_key(key: Column) -> Column:
    size = F.abs(key)
    e, fraction = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    a = F.when(e == 0, fraction * 2.0**-537 * 2.0**-537).when(e == 2047, F.lit(float("inf"))).otherwise((1 + fraction / float(1 << 52)) * F.pow(F.lit(2.0), e - 1023))
    return F.when(key == (1 << 63) - 1, F.lit(float("nan"))).when(key < 0, -a).otherwise(a)


def many_order_statistics(df: DataFrame, keys: list[str], values: list[Column], points: tuple[float, ...], names: list[str], discrete: bool = False) -> DataFrame:
    """(keys, __column, names): the quantiles at ``points`` of each value (by its number), for each combination of ``keys`` that has
    one; null is a key like any other.

    Radix selection: rows are counted by the leading bits of their values, all columns and points in one scan; running
    counts say which bucket holds a position, and the next scan counts only what falls into such buckets, by the bits that
    follow. Buckets of at most ``BUCKET`` rows are settled by their values, so two scans are usual and four the most. Only
    counts are shuffled; no group's values are held or sorted. Quantiles between two positions are
    interpolated; ``discrete`` ones are the first value that reaches the share."""
    keyed, columns = with_sort_keys(df, keys, values)
    each = F.expr("array(" + ", ".join(f"named_struct('__column', {i}, '__key', {k})" for i, k in enumerate(columns)) + ")")
    rows = keyed.select(*keys, each.alias("__each")).select(*keys, F.inline("__each")).where("__key IS NOT NULL")
    own = [*keys, "__column"]
    renamed = {k: f"__k{i}" for i, k in enumerate(own)}
    targets, shift = None, 64 - STEP
    while True:
        if targets is None:
            counts = rows.groupBy(*own, F.lit(0).alias("__above"), F.shiftright("__key", shift).alias("__bits")).agg(F.count("*").alias("__n"))
        else:
            wanted = targets.select(*[F.col(k).alias(n) for k, n in renamed.items()], F.col("__bits").alias("__above")).distinct()
            wanted = F.broadcast(wanted) if few else wanted
            on = [F.col(k).eqNullSafe(F.col(n)) for k, n in renamed.items()]
            inside = rows.join(wanted, [*on, F.shiftright("__key", before) == F.col("__above")])
            counts = inside.groupBy(*own, "__above", F.shiftright("__key", shift).alias("__bits")).agg(F.count("*").alias("__n"))
        bucket = Window.partitionBy(*own, "__above")
        placed = counts.withColumns({"__upto": F.sum("__n").over(bucket.orderBy("__bits").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(bucket)})
        if targets is None:
            at = lambda p: f"ceil(__all * {p!r}D - 1e-9D) - 1" if discrete else f"(__all - 1) * {p!r}D"
            slot = lambda i, k, p: f"named_struct('__slot', {2 * i + k}, '__at', CAST(greatest({('floor', 'ceil')[k]}({at(p)}), 0) AS BIGINT), '__part', CAST({at(p)} - floor({at(p)}) AS DOUBLE))"
            asked = F.expr("array(" + ", ".join(slot(i, k, float(p)) for i, p in enumerate(points) for k in (0, 1)) + ")")
            found = placed.select(*own, "__bits", "__n", "__upto", F.explode(asked).alias("__asked")).select(*own, "__bits", "__n", "__upto", "__asked.*")
        else:
            slots = targets.select(*[F.col(k).alias(n) for k, n in renamed.items()], F.col("__bits").alias("__a"), "__slot", "__at", "__part")
            on = [F.col(k).eqNullSafe(F.col(n)) for k, n in renamed.items()]
            found = placed.join(F.broadcast(slots) if few else slots, [*on, F.col("__above") == F.col("__a")])
        hit = found.where((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__n")))
        targets = hit.select(*own, "__bits", "__n", (F.col("__at") - F.col("__upto") + F.col("__n")).alias("__at"), "__slot", "__part")
        if shift == 0:
            break
        targets = written(targets, "buckets")
        number, largest = targets.agg(F.count("*"), F.max("__n")).first()
        few, before = number <= TARGETS, shift
        shift = 0 if (largest or 0) <= BUCKET else shift - STEP
    targets = targets.withColumn("__value", from_sort_key(F.col("__bits")))
    slot = lambda i: f"max(CASE WHEN __slot = {i} THEN __value END)"
    part = lambda i: f"max(CASE WHEN __slot = {i} THEN __part END)"
    whole = lambda p: discrete or math.isclose(p, round(p))
    between = lambda i: f"{slot(2 * i)} + ({slot(2 * i + 1)} - {slot(2 * i)}) * {part(2 * i)}"
    return targets.groupBy(*own).agg(*[F.expr(slot(2 * i) if whole(p) else between(i)).alias(n) for i, (p, n) in enumerate(zip(points, names, strict=True))])


def order_statistics(df: DataFrame, keys: list[str], value: Column, points: tuple[float, ...], names: list[str], discrete: bool = False) -> DataFrame:
    """The quantiles of one value, one row for each combination of ``keys`` that has a value; one row without keys, of nulls
    where there is no value."""
    found = many_order_statistics(df, keys, [value], points, names, discrete).drop("__column")
    return found if keys else found.agg(*[F.max(n).alias(n) for n in names])


# --- distinct counts


def unpivoted(df: DataFrame, fields: list[str], more: list[str] | None = None) -> DataFrame:
    """(more, field, value): a row for each field of each row that is not null; values as texts, the two zeros alike."""
    types = dict(df.dtypes)
    text = lambda f: F.when(F.col(f) == 0, "0").otherwise(F.col(f).cast("string")) if types[f] in ("double", "float") else F.hex(f) if types[f] == "binary" else F.col(f).cast("string")
    each = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields])
    return df.select(*(more or []), each.alias("__each")).select(*(more or []), F.inline("__each")).where("value IS NOT NULL")


def many_distinct(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, distinct_count) of all fields in one scan; only different values are shuffled."""
    values = unpivoted(df, fields).groupBy("field", "value").count().groupBy("field").agg(F.count("*").alias("distinct_count"))
    every = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return every.join(F.broadcast(values), "field", "left").select("field", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"))  # a row for each field


def value_numbers(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, number): a dictionary of all values, written once so that the numbers stay as they are."""
    values = unpivoted(df, fields).groupBy("field", "value").count().drop("count")
    return written(values.withColumn("number", F.monotonically_increasing_id()), "value-numbers")


def distinct_bitmaps(df: DataFrame, numbers: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """(by, field, bucket, bits): which values each part of the table has, as Spark's own bitmaps over the dictionary's numbers.
    Bitmaps of further parts can be added as they come, made with the same dictionary; values that it lacks are left out."""
    rows = unpivoted(df, fields, by).groupBy(*by, "field", "value").count().join(numbers, ["field", "value"])
    return rows.groupBy(*by, "field", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def distinct_of_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, distinct_count): exact counts over any union of parts, from their bitmaps alone."""
    merged = bitmaps.groupBy(*keys, "field", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys, "field").agg(F.sum(F.bitmap_count("bits")).alias("distinct_count"))
