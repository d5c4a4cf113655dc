"""Profiles of tables and columns, quality signals, and coordinate systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_double, as_timestamp, semantic_type
from quarrylens.operators.charts import bin_of
from quarrylens.operators.orderstat import many_distinct, many_order_statistics


def dataset_profile(df: DataFrame, fields: list[str] | None = None, chunk: int = 12, approximate: bool = False) -> DataFrame:
    """A row per field: semantic_type, rows, nulls, null_share, distinct_count, min, max, mean, stddev, q25, q50, q75,
    first_time, last_time. One aggregate for every ``chunk`` fields, so generated code stays small. Distinct counts and
    quantiles are exact at every size, each found by itself from one column; ``approximate`` ones share the aggregate."""
    names, out = fields or df.columns, None
    kinds = {f: semantic_type(df, f) for f in names}
    numbers = [f for f in names if kinds[f] in ("numeric", "identifier")]
    for at in range(0, len(names), chunk):
        aggs, rows = [F.count("*").alias("rows")], []
        for i, f in enumerate(names[at : at + chunk]):
            v = as_double(df, f) if f in numbers else F.lit(None).cast("double")
            t = as_timestamp(df, f) if kinds[f] == "temporal" else F.lit(None).cast("timestamp_ntz")
            aggs += [F.count(f).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(t).alias(f"t0{i}"), F.max(t).alias(f"t1{i}")]
            rough = [F.lit(None).cast("long").alias("distinct_count"), F.lit(None).cast("array<double>").alias("q")]
            if approximate:
                aggs += [F.approx_count_distinct(f).alias(f"d{i}"), F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}")]
                rough = [F.col(f"d{i}").alias("distinct_count"), F.col(f"q{i}").alias("q")]
            nulls = F.col("rows") - F.col(f"n{i}")
            more = [F.col(f"{c}{i}").alias(n) for c, n in (("lo", "min"), ("hi", "max"), ("m", "mean"), ("s", "stddev"), ("t0", "first_time"), ("t1", "last_time"))]
            rows.append(F.struct(F.lit(f).alias("field"), F.lit(kinds[f]).alias("semantic_type"), F.col("rows"), nulls.alias("nulls"), F.try_divide(nulls.cast("double"), F.col("rows").cast("double")).alias("null_share"), *rough, *more))
        part = df.agg(*aggs).select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    if not approximate:  # one row each, so both joins are of some rows
        out = out.drop("distinct_count", "q").join(F.broadcast(many_distinct(df, names)), "field")
        found = many_order_statistics(df, [], [as_double(df, f) for f in numbers], (0.25, 0.5, 0.75), ["a", "b", "c"]) if numbers else None
        of = F.array(*map(F.lit, numbers))
        out = out.withColumn("q", F.lit(None).cast("array<double>")) if found is None else out.join(F.broadcast(found.select(F.get(of, F.col("__column")).alias("field"), F.array("a", "b", "c").alias("q"))), "field", "left")
    return out.select("field", "semantic_type", "rows", "nulls", "null_share", "distinct_count", "min", "max", "mean", "stddev", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q25", "q50", "q75"))], "first_time", "last_time")


def quality_issues(profile: DataFrame) -> DataFrame:
    """(field, issue, severity): many nulls, an identifier with repeats, a category with many values."""
    valid = F.col("rows") - F.col("nulls")
    issues = F.array_compact(
        F.array(
            F.when(F.col("null_share") >= 0.5, F.struct(F.lit("nulls").alias("issue"), F.lit("warning").alias("severity"))).when(F.col("null_share") >= 0.25, F.struct(F.lit("nulls").alias("issue"), F.lit("info").alias("severity"))),
            F.when((F.col("semantic_type") == "identifier") & (F.col("distinct_count") < valid), F.struct(F.lit("repeated identifier").alias("issue"), F.lit("warning").alias("severity"))),
            F.when((F.col("semantic_type") == "categorical") & (F.col("distinct_count") > 50), F.struct(F.lit("many categories").alias("issue"), F.lit("info").alias("severity"))),
        )
    )
    return profile.select("field", F.inline(issues))


def geometry_issues(df: DataFrame, ring: str) -> DataFrame:
    """(field, issue, severity, rows): rings (open lists of x and y) that are missing or no polygon: fewer than three points, or no area."""
    p = F.col(ring)
    after = lambda i: F.get(p, F.when(i + 1 == F.size(p), F.lit(0)).otherwise(i + 1))
    parts = F.transform(p, lambda q, i: q["x"] * after(i)["y"] - after(i)["x"] * q["y"])
    invalid = (F.size(p) < 3) | (F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) == 0)
    found = df.agg(F.count_if(p.isNull()).alias("missing"), F.count_if(p.isNotNull() & invalid).alias("invalid"))
    row = lambda issue, severity, c: F.struct(F.lit(ring).alias("field"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.col(c).alias("rows"))
    return found.select(F.inline(F.array(row("missing geometry", "info", "missing"), row("invalid geometry", "warning", "invalid")))).where("rows > 0")


def column_profile(df: DataFrame, field: str, bins: int = 12, top: int = 12) -> DataFrame:
    """(kind, label, low, high, count): equal bins where at least four fifths of the values are numbers, else the
    most frequent values."""
    v, text = as_double(df, field), F.col(field).cast("string")
    row = df.agg(F.count(v), F.count(field), F.min(v), F.max(v)).first()
    if row[0] and row[0] >= 0.8 * row[1]:
        low, high = float(row[2]), float(row[3])
        width = (high - low) / bins if high > low else 1.0
        b = bin_of(F.col("__v"), F.lit(low), F.lit(high), bins)
        counts = df.select(v.alias("__v")).where("__v IS NOT NULL").groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
        return counts.select(F.lit("numeric").alias("kind"), F.col("bin").cast("string").alias("label"), (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "count")
    counts = df.where(text.isNotNull()).groupBy(text.alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(top)
    return counts.select(F.lit("categorical").alias("kind"), "label", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "count")


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bounds of the coordinates and a guess of their reference system with how sure it is."""
    out = df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
    within = lambda x0, x1, y0, y1: (F.col("xmin") >= x0) & (F.col("xmax") <= x1) & (F.col("ymin") >= y0) & (F.col("ymax") <= y1)
    crs = F.when(within(-180, 180, -90, 90), 4326).when(within(0, 800_000, 0, 1_400_000), 27700).when(within(-20_037_509, 20_037_509, -20_048_967, 20_048_967), 3857)
    sure = F.when(crs == 4326, "high").when(crs.isNotNull(), "medium").otherwise("unknown")
    return out.withColumns({"crs": crs, "confidence": sure})


def row_id(df: DataFrame, most: int = 8) -> tuple[DataFrame, str, str]:
    """The table, its row id and how good that is: a proven unique column (names that sound like one first), else a
    sequential ``__row_id`` added."""
    import re

    from quarrylens.operators.ranking import row_number

    named = [c for c in df.columns if re.search(r"id|uuid|guid|key|code", c.lower())]
    tried = (named + [c for c in df.columns if c not in named])[:most]
    row = df.agg(F.count("*"), *[x for c in tried for x in (F.count(F.col(f"`{c}`")), F.approx_count_distinct(F.col(f"`{c}`")))]).first()  # one pass for all
    for c, present, different in zip(tried, row[1::2], row[2::2], strict=True):
        if row[0] and present == row[0] and different > 0.8 * row[0]:  # the estimate is off by some per cent; then it is proven
            if df.groupBy(F.col(f"`{c}`")).count().where("count > 1").isEmpty():
                return df, c, "validated-unique"
    return row_number(df, tried[0], df.columns), "__row_id", "materialised"


def cell_column(df: DataFrame, pattern: str = "^[0-9a-f]{15,16}$", sampled: int = 1000) -> str | None:
    """The text column whose sampled values are all cell ids; names that sound like one first, three are tried."""
    import re

    texts = [n for n, t in df.dtypes if t == "string"]
    named = [n for n in texts if re.search("h3|hex|cell|index|quadkey", n.lower())]
    for c in (named + [n for n in texts if n not in named])[:3]:
        row = df.where(F.col(c).isNotNull()).select(c).limit(sampled).agg(F.count("*"), F.count_if(F.col(c).rlike(pattern))).first()
        if row[0] and row[0] == row[1]:
            return c
    return None
