"""Grouped summaries, order statistics, KPIs and field summaries."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_double, as_timestamp
from quarrylens.operators.filters import context
from quarrylens.operators.orderstat import beside, many_distinct, many_order_statistics, order_statistics


def measure(df: DataFrame, fn: str, field: str | None = None) -> Column:
    if fn == "count":
        return F.count("*") if field is None else F.count(field)
    if field is None:
        raise ValueError(f"{fn} needs a field")
    if fn == "count_distinct":
        return F.count_distinct(field)
    if fn in ("min", "max"):
        return getattr(F, fn)(field)
    return {"sum": F.sum, "avg": F.avg, "median": F.median}[fn](as_double(df, field))


def summarise(df: DataFrame, keys: list[str], measures: list[dict]) -> DataFrame:
    """Measures {fn, field, alias} for each combination of the keys, or one row without keys."""
    if not measures:
        raise ValueError("no measures")
    aliases = [m.get("alias") or ("row_count" if m["fn"] == "count" and not m.get("field") else re.sub(r"\W+", "_", f"{m['fn']}_{m.get('field')}")) for m in measures]
    if len(set(aliases)) < len(aliases):
        raise ValueError("two measures have the same alias")
    # medians, and distinct counts beyond the first, are grouped by themselves: one pass for all would expand every row or hold a group's values
    plain, apart = [], []
    for m, a in zip(measures, aliases, strict=True):
        one = measure(df, m["fn"], m.get("field"))
        if m["fn"] == "median" or (m["fn"] == "count_distinct" and any(n["fn"] == "count_distinct" for n, _, _ in plain)):
            apart.append((m, a, one))
        else:
            plain.append((m, a, one))
    out = df.groupBy(*keys).agg(F.count("*").alias("__rows"), *[c.alias(a) for _, a, c in plain])
    medians = [(m, a) for m, a, _ in apart if m["fn"] == "median"]
    if medians:  # all in the same scans
        found = many_order_statistics(df, keys, [as_double(df, m["field"]) for m, _ in medians], (0.5,), ["__q"])
        out = beside(out, found.groupBy(*keys).agg(*[F.max(F.when(F.col("__column") == i, F.col("__q"))).alias(a) for i, (_, a) in enumerate(medians)]), keys)
    for m, a, c in apart:
        if m["fn"] != "median":
            out = beside(out, df.groupBy(*keys).agg(c.alias(a)), keys)
    return out.select(*keys, *aliases)


def filtered_measures(df: DataFrame, keys: list[str], specs: list[dict], fn: str, field: str | None) -> DataFrame:
    """Count and value in context beside the totals, in one pass."""
    value = as_double(df, field) if field else F.lit(1)
    agg = {"count": lambda c: F.count(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn]
    inside = context(df, specs)
    return df.groupBy(*keys).agg(F.count("*").alias("total_count"), agg(value).alias("total_value"), F.count_if(inside).alias("count"), agg(F.when(inside, value)).alias("value"))


def kpi(df: DataFrame, fn: str, field: str | None, specs: list[dict], compare: str = "none", cohort: list[dict] | None = None) -> DataFrame:
    """value, active_rows, total_value, total_rows, comparison, delta = (v - c) / abs(c), note; one scan."""
    value = as_double(df, field) if field else F.lit(1)
    agg = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn]
    active = context(df, specs)
    note, other = None, None
    if compare == "total":
        other = F.lit(True)
    elif compare == "cohort":
        other = context(df, cohort or [])
    elif compare == "previous-period":
        bounded = next((s for s in specs if s["type"] == "temporal" and s.get("min") and s.get("max")), None)
        if bounded is None:
            note = "needs a bounded time filter"
        else:
            start, end = datetime.fromisoformat(str(bounded["min"])), datetime.fromisoformat(str(bounded["max"]))
            moved = bounded | {"min": start - (end - start + timedelta(milliseconds=1)), "max": start - timedelta(milliseconds=1)}
            other = context(df, [moved if s is bounded else s for s in specs])
    aggs = [agg(F.when(active, value)).alias("value"), F.count_if(active).alias("active_rows"), agg(value).alias("total_value"), F.count("*").alias("total_rows")]
    aggs.append((agg(F.when(other, value)) if other is not None else F.lit(None)).cast("double").alias("comparison"))
    out = df.agg(*aggs).withColumns({"value": F.col("value").cast("double"), "total_value": F.col("total_value").cast("double")})
    return out.withColumns({"delta": F.try_divide(F.col("value") - F.col("comparison"), F.abs("comparison")), "note": F.when(F.col("comparison") == 0, "baseline is zero").otherwise(F.lit(note))})


def quantiles(df: DataFrame, field: str, points: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), exact: bool = True) -> DataFrame:
    names = [f"q{round(100 * p)}" for p in points]
    if exact:
        return order_statistics(df, [], as_double(df, field), points, names)
    return df.agg(F.percentile_approx(as_double(df, field), F.array(*map(F.lit, points))).alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def distinct_counts(df: DataFrame, fields: list[str], approximate: bool = False) -> DataFrame:
    """Distinct counts of all fields in one scan, exact unless asked otherwise."""
    if not approximate:
        return many_distinct(df, fields)
    return df.agg(*[F.approx_count_distinct(f).alias(f"d{i}") for i, f in enumerate(fields)]).select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d{i}").alias("distinct_count")) for i, f in enumerate(fields)])))


def moments(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    a, b = as_double(df, x), as_double(df, y)
    return df.groupBy(*(keys or [])).agg(F.stddev_pop(a).alias("stddev_pop"), F.stddev_samp(a).alias("stddev_samp"), F.corr(a, b).alias("corr"))


def ids_per_group(df: DataFrame, key: str, row_id: str, most: int = 200) -> DataFrame:
    """The smallest ``most`` ids of each group, joined by U+001F, and the group's size. The bounded list is
    kept in two steps, so no task holds all ids of a large group."""
    part = df.select(key, F.col(row_id).cast("string").alias("id"), F.pmod(F.xxhash64(row_id), F.lit(64)).alias("part"))
    from pyspark.sql import Window

    near = part.withColumn("k", F.row_number().over(Window.partitionBy(key, "part").orderBy("id"))).where(F.col("k") <= most)
    lists = near.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))
    sizes = df.groupBy(key).agg(F.count("*").alias("count"))
    return sizes.join(lists, sizes[key].eqNullSafe(lists[key])).select(sizes[key], "count", F.array_join("ids", "\x1f").alias("ids"))


def date_range(df: DataFrame, field: str) -> DataFrame:
    """First and last date and their number; no row where nothing is a date."""
    day = as_timestamp(df, field).cast("date")
    return df.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count(day).alias("dated_rows")).where("dated_rows > 0")


def fields_by_kind(df: DataFrame, fields: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) of the fields, by default all: numeric where at least four fifths of the values that are not null are
    numbers, whatever the column's type; fields without values are neither. One pass for all."""
    names = df.columns if fields is None else fields
    if not names:
        return [], []
    row = df.agg(*[c for f in names for c in (F.count(as_double(df, f)), F.count(F.col(f"`{f}`")))]).first()
    numbers, present = row[0::2], row[1::2]
    numeric = [f for f, n, all_ in zip(names, numbers, present, strict=True) if all_ and n >= 0.8 * all_]
    return numeric, [f for f, all_ in zip(names, present, strict=True) if all_ and f not in numeric]


def chosen_field_summary(df: DataFrame, selected: Column, active: Column, fields: list[str] | None = None) -> DataFrame:
    """``field_summary`` of the fields that count as numeric: the first five of the table, or of at most eight that are asked for."""
    numeric, _ = fields_by_kind(df, None if fields is None else fields[:8])
    return field_summary(df, numeric if fields is not None else numeric[:5], selected, active)


def field_summary(df: DataFrame, numeric: list[str], selected: Column, active: Column) -> DataFrame:
    """count, min, max, mean, sum of each field over the scopes selected, active and total; one pass. No field gives no rows."""
    if not numeric:
        return df.sparkSession.createDataFrame([], "field string, scope string, count long, min double, max double, mean double, sum double")
    aggs, rows = [], []
    for f in numeric:
        for scope, inside in (("selected", selected), ("active", active), ("total", F.lit(True))):
            v, name = F.when(inside, as_double(df, f)), f"{f}_{scope}"
            aggs += [fn(v).alias(f"{name}_{k}") for k, fn in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum))]
            rows.append(F.struct(F.lit(f).alias("field"), F.lit(scope).alias("scope"), *[F.col(f"{name}_{k}").alias(a) for k, a in (("n", "count"), ("min", "min"), ("max", "max"), ("mean", "mean"), ("sum", "sum"))]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def category_summary(df: DataFrame, field: str, selected: Column, active: Column, most: int = 6) -> DataFrame:
    label = F.col(field).cast("string")
    counts = df.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count_if(selected).alias("selected"), F.count_if(active).alias("active"), F.count("*").alias("total"))
    return counts.orderBy(F.desc("selected"), F.desc("active"), F.desc("total"), "label").limit(most)
