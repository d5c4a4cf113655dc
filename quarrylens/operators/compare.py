"""Cohorts, comparison of groups, explanation of a selection, and classes for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_double, as_timestamp
from quarrylens.operators.charts import bin_of, top_and_other
from quarrylens.operators.orderstat import many_order_statistics
from quarrylens.operators.summarise import fields_by_kind

MISSING = "∅ Missing"


def cohort_counts(df: DataFrame, a: Column, b: Column | None = None) -> DataFrame:
    """total, a, b, overlap, a_only, b_only; without b the remainder: rows where a is false, not null."""
    b = ~a if b is None else b
    return df.agg(F.count("*").alias("total"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("overlap"), F.count_if(a & ~F.coalesce(b, F.lit(False))).alias("a_only"), F.count_if(b & ~F.coalesce(a, F.lit(False))).alias("b_only"))


def cohort_numbers(df: DataFrame, a: Column, b: Column, fields: list[str]) -> DataFrame:
    """Counts, missing values, means and effect size (difference of means over the pooled deviation) of each field; one pass."""
    aggs, rows = [], []
    for i, f in enumerate(fields):
        v = as_double(df, f)
        for k, inside in (("a", a), ("b", b)):
            w = F.when(inside, v)
            aggs += [F.count(w).alias(f"n{k}{i}"), (F.count_if(inside) - F.count(w)).alias(f"x{k}{i}"), F.avg(w).alias(f"m{k}{i}"), F.stddev_samp(w).alias(f"s{k}{i}")]
        pooled = F.sqrt((F.col(f"sa{i}") * F.col(f"sa{i}") + F.col(f"sb{i}") * F.col(f"sb{i}")) / 2)
        effect = F.try_divide(F.col(f"ma{i}") - F.col(f"mb{i}"), F.nullif(pooled, F.lit(0.0)))
        rows.append(F.struct(F.lit(f).alias("field"), *[F.col(f"{x}{k}{i}").alias(f"{name}_{k}") for k in "ab" for x, name in (("n", "count"), ("x", "missing"), ("m", "mean"))], effect.alias("effect_size")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def cohort_bins(df: DataFrame, a: Column, b: Column, field: str, bins: int = 8) -> DataFrame:
    """Counts of both cohorts in shared bins over their joint range."""
    v = as_double(df, field)
    rows = df.select(v.alias("v"), F.coalesce(a, F.lit(False)).alias("a"), F.coalesce(b, F.lit(False)).alias("b")).where("v IS NOT NULL AND (a OR b)")
    bounds = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return rows.crossJoin(F.broadcast(bounds)).groupBy(bin_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count_if("a").alias("count_a"), F.count_if("b").alias("count_b"))


def cohort_shares(df: DataFrame, a: Column, b: Column, field: str, most: int = 10) -> DataFrame:
    label = F.coalesce(F.col(field).cast("string"), F.lit(MISSING))
    counts = df.groupBy(label.alias("label")).agg(F.count_if(a).alias("count_a"), F.count_if(b).alias("count_b"))
    sums = counts.agg(F.sum("count_a").alias("__a"), F.sum("count_b").alias("__b"))
    out = counts.crossJoin(F.broadcast(sums)).select("label", "count_a", "count_b", F.try_divide(F.col("count_a"), F.col("__a")).alias("share_a"), F.try_divide(F.col("count_b"), F.col("__b")).alias("share_b"))
    return out.withColumn("share_difference", F.col("share_a") - F.col("share_b")).orderBy(F.desc(F.col("count_a") + F.col("count_b")), "label").limit(most)


def cohort_months(df: DataFrame, a: Column, b: Column, field: str) -> DataFrame:
    month = F.date_trunc("month", as_timestamp(df, field)).cast("date")
    return df.where(month.isNotNull()).groupBy(month.alias("month")).agg(F.count_if(a).alias("count_a"), F.count_if(b).alias("count_b"))


def _operands(groups: list[DataFrame], columns: list[Column]) -> DataFrame:
    out = None
    for i, g in enumerate(groups):
        part = g.select(F.lit(i).alias("operand"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def group_measures(groups: list[DataFrame], field: str) -> DataFrame:
    """denominator, mean, sum and missing values of 2 to 4 groups."""
    if not 2 <= len(groups) <= 4:
        raise ValueError("2 to 4 groups are compared")
    rows = _operands(groups, [as_double(groups[0], field).alias("v")])
    return rows.groupBy("operand").agg(F.count("*").alias("denominator"), F.avg("v").alias("mean"), F.sum("v").alias("total"), (F.count("*") - F.count("v")).alias("missing"))


def group_shares(groups: list[DataFrame], field: str, most: int = 20) -> DataFrame:
    rows = _operands(groups, [F.coalesce(F.col(field).cast("string"), F.lit("Missing")).alias("label")])
    counts = rows.groupBy("operand", "label").agg(F.count("*").alias("count"))
    sums = counts.groupBy("operand").agg(F.sum("count").alias("denominator"))
    order = Window.partitionBy("operand").orderBy(F.desc("count"), "label")
    top = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return top.join(F.broadcast(sums), "operand").select("operand", "label", "count", (F.col("count") / F.col("denominator")).alias("share"))


def group_distribution(groups: list[DataFrame], field: str, bins: int = 10) -> DataFrame:
    """Bins of each group over its own range, with the bin's least and largest value and its share of valid rows."""
    rows = _operands(groups, [as_double(groups[0], field).alias("v")]).where("v IS NOT NULL")
    bounds = rows.groupBy("operand").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("valid"))
    placed = rows.join(F.broadcast(bounds), "operand").withColumn("bin", bin_of(F.col("v"), F.col("low"), F.col("high"), bins))
    return placed.groupBy("operand", "bin", "valid").agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.count("*").alias("count")).select("operand", "bin", "least", "largest", "count", (F.col("count") / F.col("valid")).alias("share"))


def group_months(groups: list[DataFrame], time: str, field: str) -> DataFrame:
    g = groups[0]
    rows = _operands(groups, [F.date_trunc("month", as_timestamp(g, time)).cast("date").alias("month"), as_double(g, field).alias("v")])
    return rows.where("month IS NOT NULL").groupBy("operand", "month").agg(F.count("*").alias("count"), F.sum("v").alias("total"))


def located_records(groups: list[DataFrame], key: str, value: str, x: str, y: str, most: int = 1500) -> DataFrame:
    g = groups[0]
    rows = _operands(groups, [F.col(key).cast("string").alias("key"), as_double(g, value).alias("value"), F.col(x).alias("x"), F.col(y).alias("y")]).where("key IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    near = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(32)))
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("operand", "part").orderBy("key", "value", "x", "y"))).where(F.col("k") <= most)
    return first.withColumn("k", F.row_number().over(Window.partitionBy("operand").orderBy("key", "value", "x", "y"))).where(F.col("k") <= most).drop("k", "part")


def explain_selection(df: DataFrame, selected: Column, numeric: list[str], categorical: list[str], most: int = 8) -> DataFrame:
    """(field, kind, strength): what tells the selected rows apart. Numbers: difference of means over the deviation of
    all; where there is none, 1 if the means differ. Categories: half the sum of share differences over the 8 most common labels."""
    inside = F.coalesce(selected, F.lit(False))
    aggs, rows = [], []
    for i, f in enumerate(numeric):
        v = as_double(df, f)
        aggs += [F.avg(F.when(inside, v)).alias(f"s{i}"), F.avg(F.when(~inside, v)).alias(f"r{i}"), F.stddev_pop(v).alias(f"d{i}")]
        gap = F.abs(F.col(f"s{i}") - F.col(f"r{i}"))
        rows.append(F.struct(F.lit(f).alias("field"), F.lit("numeric").alias("kind"), F.when(F.col(f"d{i}") > 0, gap / F.col(f"d{i}")).otherwise(F.when(gap == 0, 0.0).otherwise(1.0)).alias("strength")))
    out = df.agg(*aggs).select(F.inline(F.array(*rows))) if numeric else None
    if categorical:
        part = _share_gaps(df, inside, categorical).groupBy("field").agg((F.sum("gap") / 2).alias("strength")).select("field", F.lit("categorical").alias("kind"), "strength")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "field string, kind string, strength double")
    return out.where("strength IS NOT NULL").orderBy(F.desc("strength"), "field").limit(most)


def _share_gaps(df: DataFrame, inside: Column, categorical: list[str]) -> DataFrame:
    """(field, label, selected_share, rest_share, gap) of the 8 most common labels of each field; null is a label."""
    labels = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias("label")) for f in categorical])
    counts = df.select(inside.alias("inside"), labels.alias("labels")).select("inside", F.inline("labels")).groupBy("field", "label").agg(F.count_if("inside").alias("s"), F.count_if(~F.col("inside")).alias("r"))
    sums = counts.groupBy("field").agg(F.sum("s").alias("all_s"), F.sum("r").alias("all_r"))
    order = Window.partitionBy("field").orderBy(F.desc(F.col("s") + F.col("r")), "label")
    top = counts.withColumn("k", F.row_number().over(order)).where("k <= 8").join(F.broadcast(sums), "field")
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    shares = top.select("field", "label", share("s", "all_s").alias("selected_share"), share("r", "all_r").alias("rest_share"))
    return shares.withColumn("gap", F.abs(F.col("selected_share") - F.col("rest_share")))


def selection_gaps(df: DataFrame, selected: Column, categorical: list[str], most: int = 3) -> DataFrame:
    """(field, place, label, selected_share, rest_share, gap): the labels behind an explained selection, of each field those whose
    shares differ most, ties by label."""
    order = Window.partitionBy("field").orderBy(F.desc("gap"), "label")
    gaps = _share_gaps(df, F.coalesce(selected, F.lit(False)), categorical)
    return gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("field", "place", "label", "selected_share", "rest_share", "gap")


def explain_any(df: DataFrame, selected: Column, fields: list[str] | None = None, most: int = 8) -> DataFrame:
    """``explain_selection`` over all fields, told apart by the four-fifths rule: at most 24 numeric and 5 categorical ones."""
    numeric, categorical = fields_by_kind(df, fields)
    return explain_selection(df, selected, numeric[:24], categorical[:5], most)


def equal_breaks(df: DataFrame, field: str, classes: int) -> list[float]:
    """Inner breaks of equal intervals; one value gives itself, no value none."""
    k = max(2, min(9, classes))
    low, high = df.agg(F.min(as_double(df, field)), F.max(as_double(df, field))).first()
    if low is None:
        return []
    return [low] if low == high else [low + (high - low) * i / k for i in range(1, k)]


def quantile_breaks_of(df: DataFrame, fields: list[str], classes: int) -> list[list[float]]:
    """For each field its values at the inner quantiles, each one of the table's own; repeats are dropped. All in the same scans."""
    k = max(2, min(9, classes))
    names = [f"q{i}" for i in range(1, k)]
    found = many_order_statistics(df, [], [as_double(df, f) for f in fields], tuple(i / k for i in range(1, k)), names, discrete=True)
    rows = {r["__column"]: [r[n] for n in names] for r in found.collect()}  # one row for each field
    return [sorted({x for x in rows.get(i, []) if x is not None}) for i in range(len(fields))]


def quantile_breaks(df: DataFrame, field: str, classes: int) -> list[float]:
    return quantile_breaks_of(df, [field], classes)[0]


def class_of(value: Column, breaks: list[float]) -> Column:
    """The number of breaks not above the value; null for null."""
    if not breaks:
        return F.when(value.isNotNull(), F.lit(0))
    return F.when(value.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(breaks)]), lambda b: b <= value)))


def bivariate(df: DataFrame, x: str, y: str, classes: int = 3) -> DataFrame:
    breaks = quantile_breaks_of(df, [x, y], classes)
    a, b = class_of(as_double(df, x), breaks[0]), class_of(as_double(df, y), breaks[1])
    return df.withColumn("bivariate_class", b * classes + a)


def category_classes(df: DataFrame, field: str, most: int = 8) -> DataFrame:
    return top_and_other(df, field, most, "Other", "No data")


def linear_scale(df: DataFrame, field: str, low: float, high: float, out: str) -> DataFrame:
    """The column mapped linearly from its range to low..high; the middle where the range is a point."""
    v = as_double(df, field)
    bounds = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    scaled = F.coalesce(F.lit(low) + F.try_divide(v - F.col("__lo"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))) * (high - low), F.when(v.isNotNull(), F.lit((low + high) / 2)))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, scaled).drop("__lo", "__hi")


def extrusion(df: DataFrame, field: str, factor: float, out: str = "height") -> DataFrame:
    return df.withColumn(out, F.greatest(F.lit(0.0), F.coalesce(as_double(df, field) * factor, F.lit(0.0))))
