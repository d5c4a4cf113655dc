"""Declarative filters, search, selections, named criteria and their funnel."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_boolean, as_double, as_timestamp


def predicate(df: DataFrame, spec: dict) -> Column | None:
    """The condition of one filter, or None where it is empty and so does nothing.

    Exclusion keeps rows on which the condition is null."""
    kind, field = spec["type"], spec["field"]
    text = F.col(field).cast("string")
    if kind == "category":
        values, nulls = spec.get("values") or [], spec.get("include_null", False)
        if not values and not nulls:
            return None
        p = text.isin(*map(str, values)) if values else F.lit(False)
        p = p | F.col(field).isNull() if nulls else p
    elif kind in ("range", "temporal"):
        low, high = spec.get("min"), spec.get("max")
        if low is None and high is None and not spec.get("include_null"):
            return None
        value = as_double(df, field) if kind == "range" else as_timestamp(df, field)
        bound = (lambda x: F.lit(float(x))) if kind == "range" else (lambda x: F.lit(str(x)).try_cast("timestamp_ntz"))
        p = F.lit(True)
        p = p & (value >= bound(low)) if low is not None else p
        p = p & (value <= bound(high)) if high is not None else p
        p = value.isNotNull() & p if low is None and high is None else p
        p = p | F.col(field).isNull() if spec.get("include_null") else p
    elif kind == "text":
        query = spec.get("query") or ""
        if not query:
            return None
        fold = (lambda c: c) if spec.get("case_sensitive") else F.lower
        needle = fold(F.lit(query))
        p = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith, "equals": lambda a, b: a == b}[spec.get("operator", "contains")](fold(text), needle)
    elif kind == "boolean":
        p = as_boolean(df, field).eqNullSafe(F.lit(bool(spec["value"])))
    elif kind == "null":
        return F.col(field).isNull() if spec.get("is_null", True) else F.col(field).isNotNull()
    else:
        raise ValueError(f"unknown filter type {kind!r}")
    return ~F.coalesce(p, F.lit(False)) if spec.get("mode") == "exclude" else p


def context(df: DataFrame, specs: list[dict], but: tuple[str, ...] = ()) -> Column:
    """All filters together as one two-valued condition, without those on the fields ``but``."""
    parts = [p for s in specs if s["field"] not in but and (p := predicate(df, s)) is not None]
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def filtered(df: DataFrame, specs: list[dict]) -> DataFrame:
    return df.where(context(df, specs))


def where_sql(df: DataFrame, condition: str | None = None) -> DataFrame:
    return df.where(F.expr(condition or "1=1"))


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the query in any column, as text and without case; % and _ stay wildcards."""
    if not query:
        return df
    hits = [F.coalesce(F.col(c).cast("string").ilike(f"%{query}%"), F.lit(False)) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def select_ids(df: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    """Rows whose id, as text, is in the one-column table ``ids``; of any size."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("__wanted")).distinct()
    return df.join(wanted, F.col(field).cast("string") == F.col("__wanted"), "left_semi")


def select_rows(df: DataFrame, numbers: DataFrame, order: str, row_id: list[str]) -> DataFrame:
    """Rows by their number from 1 in the order of a column, ties by the row id; ``numbers`` is a one-column table of any size."""
    from quarrylens.operators.ranking import row_number

    return select_ids(row_number(df, order, row_id, "__number"), numbers, "__number").drop("__number")


def ordered(df: DataFrame, field: str, row_id: str, descending: bool = False, most: int | None = 5000) -> DataFrame:
    """The first rows in the order of a column, nulls last, ties by the row id; all of them without ``most``."""
    by = F.col(field).desc_nulls_last() if descending else F.col(field).asc_nulls_last()
    rows = df.orderBy(by, row_id)
    return rows if most is None else rows.limit(most)


def criteria(df: DataFrame, conditions: list[dict], outcome: str = "tag") -> DataFrame:
    """Named conditions {label, expression, hard}. Adds ``excluded``, ``excluded_by`` (labels failed, hard
    and soft, joined by " · ", null when none) and ``excluded_count``; ``drop`` also removes hard failures."""
    active = [c for c in conditions if (c.get("expression") or "").strip() and c.get("enabled", True)]
    if not active:
        raise ValueError("no active condition")
    labels = [c.get("label") or c["expression"] for c in active]
    if len(set(labels)) < len(labels):
        raise ValueError("two conditions have the same label")
    passed = [F.coalesce(F.expr(c["expression"]), F.lit(False)) for c in active]
    hard = [p for p, c in zip(passed, active, strict=True) if c.get("hard", True)]
    failed = F.array_compact(F.array(*[F.when(~p, F.lit(label)) for p, label in zip(passed, labels, strict=True)]))
    out = df.withColumn("excluded", ~reduce(lambda a, b: a & b, hard) if hard else F.lit(False)).withColumn("__failed", failed)
    out = out.withColumns({"excluded_by": F.nullif(F.concat_ws(" · ", "__failed"), F.lit("")), "excluded_count": F.size("__failed")}).drop("__failed")
    return out.where(~F.col("excluded")) if outcome == "drop" else out


def funnel(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """A row per condition: removed_alone and, for hard ones in turn, remaining and removed_here; the total in
    every row. One pass over the table. ``warning``: nothing left, or hardly any removed here of many alone."""
    passed = [F.coalesce(F.expr(c["expression"]), F.lit(False)) for c in conditions]
    aggs, upto = [F.count("*").alias("total")], F.lit(True)
    for i, (p, c) in enumerate(zip(passed, conditions, strict=True)):
        aggs.append(F.count_if(~p).alias(f"alone{i}"))
        if c.get("hard", True):
            here = upto & ~p
            upto = upto & p
            aggs += [F.count_if(here).alias(f"here{i}"), F.count_if(upto).alias(f"left{i}")]
    rows = []
    for i, c in enumerate(conditions):
        hard = c.get("hard", True)
        left, here = (F.col(f"left{i}"), F.col(f"here{i}")) if hard else (F.lit(None).cast("long"), F.lit(None).cast("long"))
        warning = F.when(left == 0, "nothing left").when((F.col(f"alone{i}") > 0) & (F.try_divide(here, F.col(f"alone{i}")) < 0.05), "hardly any")
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c.get("label") or c["expression"]).alias("label"), F.lit(hard).alias("hard"), F.col("total"), F.col(f"alone{i}").alias("removed_alone"), here.alias("removed_here"), left.alias("remaining"), warning.alias("warning")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def top_n(df: DataFrame, field: str, n: float, descending: bool = True) -> DataFrame:
    """The first n rows by the field with all ties of the last one; nulls come last. The n-th value is found
    by a bounded sort and the table is then filtered against that one value."""
    k = max(1, math.floor(n))
    order = F.col(field).desc_nulls_last() if descending else F.col(field).asc_nulls_last()
    kth = df.select(field).orderBy(order).limit(k)
    edge = F.min if descending else F.max
    last = kth.agg(edge(field).alias("__edge"), F.count("*").alias("__n"), F.count(field).alias("__valid"))
    v, e = F.col(field), F.col("__edge")
    inside = (v >= e if descending else v <= e) | (F.col("__valid") < F.col("__n"))  # nulls within the first n: all rows tie or precede
    return df.crossJoin(F.broadcast(last)).where(F.coalesce(inside, F.lit(False))).drop("__edge", "__n", "__valid")


def window_frames(df: DataFrame, field: str, days: int | None = None) -> DataFrame:
    """Rows per stepping time window: frame number, start, end (the last day) and count. Default length:
    a tenth of the span in days, 7 to 365."""
    day = as_timestamp(df, field).cast("date")
    low, high = df.agg(F.min(day), F.max(day)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "frame long, start date, end date, n long")
    size = days or min(365, max(7, math.floor((high - low).days / 10 + 0.5)))
    frame = F.floor(F.datediff(day, F.lit(low)) / size).cast("long")
    counts = df.where(day.isNotNull()).groupBy(frame.alias("frame")).agg(F.count("*").alias("n"))
    start = F.date_add(F.lit(low), (F.col("frame") * size).cast("int"))
    return counts.select("frame", start.alias("start"), F.date_add(start, size - 1).alias("end"), "n")


def selection(current: DataFrame, other: DataFrame, mode: str) -> DataFrame:
    """Sets of ids (one column each): replace, add or subtract."""
    a, b = current.distinct(), other.distinct()
    return {"replace": lambda: b, "add": lambda: a.union(b).distinct(), "subtract": lambda: a.join(b, a.columns[0] if a.columns == b.columns else a[0].eqNullSafe(b[0]), "left_anti")}[mode]()


def page(df: DataFrame, specs: list[dict], order: str, descending: bool, row_id: str, size: int, number: int) -> DataFrame:
    """One page of the filtered view with the filtered count in every row; nulls last, ties by row id."""
    view = filtered(df, specs)
    first = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    rows = view.orderBy(first, F.col(row_id).asc_nulls_last()).offset(number * size).limit(size)
    return rows.crossJoin(F.broadcast(view.agg(F.count("*").alias("filtered_count"))))


def record(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field).cast("string") == str(value)).limit(1)
