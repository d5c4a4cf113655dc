"""Order statistics, distinct counts and running sums against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import charts, compare, orderstat, ranking, summarise

NAN, INF = float("nan"), float("inf")


def numbers(seed=1, n=3000):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), float(rng.randrange(5)), -rng.random() * 1e-310, 7.25]), rng.choice([1.0, 2.0, None])) for _ in range(n)]
    return out + [("a", INF, 1.0), ("b", -INF, 1.0), ("a", -0.0, 1.0), ("a", None, None), ("c", None, 3.0), ("d", 5e-324, None), ("e", NAN, 1.0), ("e", 1.0, 1.0)]


def quantile(values, p):
    values = sorted(values, key=lambda v: (v != v, v))
    at = (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if at == math.floor(at) or low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("bucket", [1, 40, 500_000])
def test_quantiles_of_groups_and_columns(spark, monkeypatch, bucket):
    """With small buckets every round of bits is taken."""
    monkeypatch.setattr(orderstat, "BUCKET", bucket)
    rows = [r for r in numbers() if r[0] != "e"]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(4)
    points, names = (0.0, 0.25, 0.5, 0.9, 1.0), list("pqrst")
    groups = defaultdict(list)
    for g, v, w in rows:
        for i, x in enumerate((v, w)):
            if x is not None:
                groups[g, i].append(x)
    found = orderstat.many_order_statistics(df, ["g"], [F.col("v"), F.col("w")], points, names).collect()
    got = {(r.g, r["__column"]): [r[n] for n in names] for r in found}
    assert set(got) == set(groups) and len(found) == len(got)
    for k, values in groups.items():
        for p, x in zip(points, got[k], strict=True):
            want = quantile(values, p)
            assert x == want or math.isclose(x, want, rel_tol=1e-12)
    one = orderstat.order_statistics(df, [], F.col("v"), (0.5,), ["m"], discrete=True).collect()
    values = sorted(v for _, v, _ in rows if v is not None)
    assert [r.m for r in one] == [values[math.ceil(len(values) / 2) - 1]]


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame(numbers(), "g string, v double, w double")
    e = orderstat.order_statistics(df.where("g = 'e'"), [], F.col("v"), (0.0, 1.0), ["lo", "hi"]).first()
    assert e.lo == 1.0 and math.isnan(e.hi)
    assert [tuple(r) for r in orderstat.order_statistics(df.limit(0), [], F.col("v"), (0.5,), ["m"]).collect()] == [(None,)]
    assert orderstat.order_statistics(df.where("g = 'c'"), ["g"], F.col("v"), (0.5,), ["m"]).count() == 0
    huge = spark.createDataFrame([(1 << 62,), ((1 << 62) + 4096,), (-(1 << 62),)], "v long")
    assert orderstat.order_statistics(huge, [], F.col("v"), (1.0,), ["m"]).first().m == float((1 << 62) + 4096)


def test_quantiles_shuffle_counts_only(spark):
    """Two rounds of counts: before the result's exchange no value is sorted, and no group is collected."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    found = orderstat.order_statistics(df, [], F.col("v"), (0.5,), ["m"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan and "Cartesian" not in plan
    values = sorted(i * 7919 % 100_003 for i in range(200_000))
    assert found.first().m == (values[99_999] + values[100_000]) / 2


def test_distinct_counts_merge(spark):
    rows = [(i % 3, float(i % 5) if i % 4 else None, f"t{i % 7}" if i % 2 else None, i) for i in range(500)] + [(0, -0.0, "t1", 1), (0, 0.0, "t1", 1), (1, NAN, "", 2), (1, NAN, "", 2)]
    df = spark.createDataFrame(rows, "part long, a double, b string, c long").repartition(3)
    same = lambda v: 0.0 if v == 0 else "nan" if v != v else v
    want = lambda keep, k: len({same(r[k]) for r in rows if keep(r) and r[k] is not None})
    fields = ["a", "b", "c"]
    assert {r.field: r.distinct_count for r in orderstat.many_distinct(df, fields).collect()} == {f: want(lambda r: True, k) for k, f in enumerate(fields, 1)}
    assert {r.field: r.distinct_count for r in summarise.distinct_counts(df.limit(0), fields).collect()} == dict.fromkeys(fields, 0)
    words = orderstat.value_numbers(df, fields)
    parts = orderstat.distinct_bitmaps(df.where("part < 2"), words, fields, ["part"])
    later = parts.unionByName(orderstat.distinct_bitmaps(df.where("part = 2"), words, fields, ["part"]))  # a part that comes later
    assert {(r.part, r.field): r.distinct_count for r in orderstat.distinct_of_bitmaps(later, ["part"]).collect()} == {(p, f): want(lambda r, p=p: r[0] == p, k) for p in range(3) for k, f in enumerate(fields, 1)}
    assert {r.field: r.distinct_count for r in orderstat.distinct_of_bitmaps(later, []).collect()} == {f: want(lambda r: True, k) for k, f in enumerate(fields, 1)}


@pytest.mark.parametrize("value", ["7.0", "CAST(NULL AS DOUBLE)", "'same'", "CASE WHEN id % 10 < 9 THEN 1 ELSE id END"])
def test_one_value_fills_no_bucket(spark, value):
    df = spark.range(2000).select("id", F.expr(value).alias("v"), (F.col("id") % 11).alias("amount"))
    bucketed, buckets = ranking.with_bucket(df, ranking._along(df, "v", False), F.col("v").asc_nulls_last(), ["id"], 100)
    sizes = [r["count"] for r in bucketed.groupBy("__bucket").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 300 and buckets >= len(sizes)


@pytest.mark.parametrize("fan", [2, 1024])
def test_running_sums_over_a_scan_of_buckets(spark, monkeypatch, fan):
    monkeypatch.setattr(ranking, "FAN", fan)
    rng = random.Random(3)
    rows = [(i, rng.choice([1.0, 2.0, None, rng.random()]), rng.choice("xy"), rng.randrange(-5, 50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v double, g string, amount long").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for partition in ([], ["g"]):
        sums, want = defaultdict(int), {}
        for i, _, g, a in order:
            sums[g if partition else ""] += a
            want[i] = sums[g if partition else ""]
        got = ranking.running_sum(df, F.col("amount"), "v", ["id"], "cum", partition=partition, rows_per_bucket=40)
        assert {r.id: r.cum for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranking.running_sum(df.limit(0), F.col("amount"), "v", ["id"], "cum").count() == 0


@pytest.mark.parametrize("per", [50, 10**6])
def test_ranks_of_values_with_many_rows(spark, per):
    """A third of the rows share a value and a third are null; repeated rows keep their number."""
    rng = random.Random(6)
    rows = [(i, [None, 5.0, rng.random() * 9][i % 3]) for i in range(1200)] + [(0, None)] * 5
    df = spark.createDataFrame(rows, "id long, v double").repartition(4)
    for descending in (True, False):
        key = lambda v: (v is None, (-v if descending else v) if v is not None else 0)
        order = sorted(key(v) for _, v in rows)
        first = {}
        for place, k in enumerate(order, 1):
            first.setdefault(k, place)
        got = ranking.rank(df, "v", "r", descending, per)
        assert got.columns == ["id", "v", "r"]
        assert sorted((r.id, r.r) for r in got.collect()) == sorted((i, first[key(v)]) for i, v in rows)
    assert ranking.rank(df.limit(0), "v", "r", True, per).count() == 0


def test_facet_histogram_of_the_largest(spark):
    rows = [(None, 5.0)] * 3 + [("a", float(i)) for i in range(10)] + [("b", float(i)) for i in range(8)] + [(f"c{i}", 1.0) for i in range(20)] + [("a", None)]
    df = spark.createDataFrame(rows, "f string, v double")
    got = charts.histogram(df, "v", [], 4, facet="f", panels=2).collect()
    assert {(r.f, r.bin): r.total_count for r in got} == {("a", 0): 3, ("a", 1): 2, ("a", 2): 2, ("a", 3): 3, ("b", 0): 3, ("b", 1): 2, ("b", 2): 2, ("b", 3): 1}
    assert len({r.f for r in charts.histogram(df, "v", [], 4, facet="f", panels=99).collect()}) == 12


def test_fields_by_kind_and_gaps(spark):
    rows = [(str(i), "x" if i % 4 else str(i), None, "p" if i < 5 else "q", i) for i in range(20)]
    df = spark.createDataFrame(rows, "digits string, mixed string, nothing string, side string, n long")
    assert summarise.fields_by_kind(df) == (["digits", "n"], ["mixed", "side"]) and summarise.fields_by_kind(df, []) == ([], [])
    gaps = compare.selection_gaps(df, F.col("n") < 5, ["side", "nothing"]).collect()
    assert {(r.field, r.place, r.label, r.gap) for r in gaps} == {("side", 1, "p", 1.0), ("side", 2, "q", 1.0), ("nothing", 1, compare.MISSING, 0.0)}
    fields = {r.field: r.strength for r in compare.explain_any(df, F.col("n") < 5).collect()}
    assert fields["side"] == 1.0 and fields["n"] == pytest.approx(10 / math.sqrt(33.25)) and "nothing" not in fields
    assert compare.explain_any(df.select("nothing"), F.lit(True)).count() == 0
    assert {r.field for r in summarise.chosen_field_summary(df, F.lit(True), F.lit(True)).collect()} == {"digits", "n"}
