"""Weighted scores with exact contributions, sensitivity, and budget allocation along an order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_double
from quarrylens.operators.ranking import percent_rank, rank, running_sum


def active(criteria: list[dict]) -> list[dict]:
    return [c for c in criteria if c.get("weight", 0)]


def normalised(df: DataFrame, criteria: list[dict], missing: str) -> tuple[DataFrame, list[Column]]:
    """The table with what each norm needs, and the norm of each criterion (min-max, z-score or rank).

    One aggregate serves all criteria. A constant column has no min-max and no z-score (null). Missing
    values: ``zero`` and ``mean`` fill them in before, ``exclude`` leaves the norm null."""
    values = {c["field"]: as_double(df, c["field"]) for c in criteria}
    aggs = [fn(v).alias(f"__{k}_{f}") for f, v in values.items() for k, fn in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    df = df.crossJoin(F.broadcast(df.agg(*aggs)))
    for f, v in values.items():
        fill = {"zero": F.lit(0.0), "mean": F.col(f"__avg_{f}")}.get(missing)
        df = df.withColumn(f"__v_{f}", F.coalesce(v, fill) if fill is not None else v)
    filled = [F.stddev_pop(f"__v_{f}").alias(f"__sd_{f}") for f in values] + [F.avg(f"__v_{f}").alias(f"__mean_{f}") for f in values] + [F.min(f"__v_{f}").alias(f"__lo_{f}") for f in values] + [F.max(f"__v_{f}").alias(f"__hi_{f}") for f in values]
    df = df.crossJoin(F.broadcast(df.agg(*filled)))
    norms = []
    for i, c in enumerate(criteria):
        f, lower = c["field"], c.get("direction", "higher") == "lower"
        v, method = F.col(f"__v_{f}"), c.get("method", "minmax")
        if method == "minmax":
            n = (v - F.col(f"__lo_{f}")) / F.nullif(F.col(f"__hi_{f}") - F.col(f"__lo_{f}"), F.lit(0.0))
            norms.append(1 - n if lower else n)
        elif method == "zscore":
            n = (v - F.col(f"__mean_{f}")) / F.nullif(F.col(f"__sd_{f}"), F.lit(0.0))
            norms.append(-n if lower else n)
        else:
            df = percent_rank(df, f"__v_{f}", f"__rank{i}", descending=lower)
            norms.append(F.when(v.isNotNull(), F.col(f"__rank{i}")))
    return df, norms


def weighted(norms: list[Column], weights: list[float]) -> list[Column]:
    total = sum(map(abs, weights))
    return [F.lit(w / total) * n for w, n in zip(weights, norms, strict=True)]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def score(df: DataFrame, criteria: list[dict], out: str = "score", missing: str = "zero", contributions: bool = False, ranked: bool = False) -> DataFrame:
    """Adds the score, and on request ``<out>_c_<field>`` columns that sum to it and ``<out>_rank``."""
    used, columns = active(criteria), list(df.columns)
    if not used:
        df = df.withColumn(out, F.lit(None).cast("double"))
        return rank(df, out, f"{out}_rank") if ranked else df
    df, norms = normalised(df, used, missing)
    parts = weighted(norms, [c["weight"] for c in used])
    made = {out: _sum(parts)}
    if contributions:
        made |= {f"{out}_c_{re.sub(r'[^A-Za-z0-9]+', '_', c['field'])}": p for c, p in zip(used, parts, strict=True)}
    df = df.withColumns(made).select(*columns, *made)
    return rank(df, out, f"{out}_rank") if ranked else df


def preview(df: DataFrame, criteria: list[dict], k: int, row_id: str, out: str = "score", missing: str = "zero") -> DataFrame:
    """The first k rows by rank with the numbers of all and of scored rows."""
    scored = score(df, criteria, out, missing, ranked=True)
    totals = scored.agg(F.count("*").alias("total_rows"), F.count(out).alias("scored_rows"))
    return scored.orderBy(f"{out}_rank", row_id).limit(k).crossJoin(F.broadcast(totals))


def sensitivity(df: DataFrame, criteria: list[dict], delta: float = 0.25, top: int = 20, missing: str = "zero") -> DataFrame:
    """A row per criterion: its weight raised by ``delta``, the correlation of old and new ranks, how many
    of the first ``top`` rows leave, and the mean absolute change of rank. Needs two active criteria."""
    used = active(criteria)
    if len(used) < 2:
        raise ValueError("sensitivity needs two criteria with a weight")
    df, norms = normalised(df, used, missing)
    weights = [c["weight"] for c in used]
    variants = [weights] + [[max(0.0, w * (1 + delta)) if i == j else w for j, w in enumerate(weights)] for i in range(len(used))]
    df = df.select(*[_sum(weighted(norms, w)).alias(f"s{i}") for i, w in enumerate(variants)])
    for i in range(len(variants)):
        df = rank(df, f"s{i}", f"r{i}")
    df = df.where("s0 IS NOT NULL")
    aggs, rows = [], []
    for i, c in enumerate(used, 1):
        aggs += [F.corr("r0", f"r{i}").alias(f"c{i}"), F.count_if((F.col("r0") <= top) & (F.col(f"r{i}") > top)).alias(f"l{i}"), F.avg(F.abs(F.col("r0") - F.col(f"r{i}"))).alias(f"d{i}")]
        rows.append(F.struct(F.lit(c["field"]).alias("field"), F.col(f"c{i}").alias("rank_correlation"), F.col(f"l{i}").alias("left_top"), F.col(f"d{i}").alias("mean_shift")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def label_column(df: DataFrame, row_id: str, most: int = 8, least: int = 20) -> str:
    """The text column to label rows by: names that sound like one first, then most distinct values (at least ``least``), else the id."""
    texts = [n for n, t in df.dtypes if t == "string"]
    named = [n for n in texts if re.search(r"name|title|label", n.lower())]
    tried = (named + [n for n in texts if n not in named])[:most]
    if not tried:
        return row_id
    counts = df.agg(*[F.approx_count_distinct(n).alias(n) for n in tried]).first().asDict()
    good = [n for n in tried if counts[n] >= least]
    return max(good, key=lambda n: (n in named, counts[n])) if good else row_id


def allocate(df: DataFrame, amount: str, limit: float, order: str, row_id: list[str], mode: str = "flag", descending: bool = True, partition: list[str] | None = None) -> DataFrame:
    """Spend a budget along an order: ``cumulative_<amount>`` and ``<amount>_status`` (within, over);
    ``cut`` keeps what is within, ``scale`` adds ``allocated_<amount>``. What is no number costs nothing."""
    a, cum = F.coalesce(as_double(df, amount), F.lit(0.0)), f"cumulative_{amount}"
    out = running_sum(df, a, order, row_id, cum, descending, partition)
    out = out.withColumn(f"{amount}_status", F.when(F.col(cum) <= limit, "within").otherwise("over"))
    if mode == "cut":
        return out.where(F.col(f"{amount}_status") == "within")
    if mode == "scale":
        return out.withColumn(f"allocated_{amount}", F.least(a, F.greatest(F.lit(0.0), F.lit(float(limit)) - (F.col(cum) - a))))
    return out
