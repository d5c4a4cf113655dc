"""Cohorts, group comparison, explanation of a selection, and map classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import compare as cp
from quarrylens.operators.filters import context
from quarrylens.queries.inputs import ORDERS_N, POINTS, orders_n, points, rounded, table

N = f"WITH o AS ({ORDERS_N}) "
LARGE = [{"type": "range", "field": "price_n", "min": 100000}]


def membership(spark, sf):
    o = orders_n(spark, sf)
    return o.select("o_orderkey", context(o, LARGE).alias("member"))


def counts(spark, sf):
    return cp.cohort_counts(orders_n(spark, sf), F.col("price_n") > 100000, F.col("o_orderstatus") == "O")


def counts_remainder(spark, sf):
    return cp.cohort_counts(orders_n(spark, sf), F.col("price_n") > 100000)


def _ab():
    return F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"


def numbers(spark, sf):
    return rounded(cp.cohort_numbers(orders_n(spark, sf), *_ab(), ["price_n", "mixed_txt"]), 4)


def bins(spark, sf):
    return cp.cohort_bins(orders_n(spark, sf), *_ab(), "price_n").select(F.col("bin").cast("long").alias("bin"), "count_a", "count_b")


def shares(spark, sf):
    return rounded(cp.cohort_shares(orders_n(spark, sf), *_ab(), "prio_n"), 6)


def months(spark, sf):
    return cp.cohort_months(orders_n(spark, sf), *_ab(), "o_orderdate")


def _groups(spark, sf):
    o = orders_n(spark, sf)
    return [o.where(F.col("o_orderstatus") == x) for x in ("F", "O", "P")]


def measures(spark, sf):
    return rounded(cp.group_measures(_groups(spark, sf), "price_n").withColumn("operand", F.col("operand").cast("long")), 2)


def group_shares(spark, sf):
    return rounded(cp.group_shares(_groups(spark, sf), "prio_n").withColumn("operand", F.col("operand").cast("long")), 6)


def distribution(spark, sf):
    out = cp.group_distribution(_groups(spark, sf), "price_n")
    return rounded(out.withColumns({"operand": F.col("operand").cast("long"), "bin": F.col("bin").cast("long")}), 6)


def group_months(spark, sf):
    return rounded(cp.group_months(_groups(spark, sf), "o_orderdate", "price_n").withColumn("operand", F.col("operand").cast("long")), 2)


def located(spark, sf):
    p = points(spark, sf)
    out = cp.located_records([p.where("v > 5000"), p.where("v < 0")], "pt_id", "v", "x", "y", 60)
    return rounded(out.withColumn("operand", F.col("operand").cast("long")), 4)


def explain(spark, sf):
    o = orders_n(spark, sf)
    return rounded(cp.explain_selection(o, F.col("o_totalprice") > 250000, ["price_n", "o_custkey"], ["prio_n", "o_orderstatus"]), 6)


def equal(spark, sf):
    part = table(spark, sf, "part")
    b = cp.equal_breaks(part, "p_retailprice", 5)
    return spark.range(1).select(*[F.round(F.lit(float(x)), 6).alias(f"b{i}") for i, x in enumerate(b, 1)])


def quantile(spark, sf):
    b = cp.quantile_breaks(table(spark, sf, "part"), "p_retailprice", 4)
    return spark.range(1).select(*[F.lit(float(x)).alias(f"b{i}") for i, x in enumerate(b, 1)])


def classes(spark, sf):
    o = orders_n(spark, sf)
    return o.select("o_orderkey", cp.class_of(F.col("price_n"), [50000, 100000, 200000]).cast("long").alias("class"))


def bivariate(spark, sf):
    out = cp.bivariate(table(spark, sf, "part"), "p_size", "p_retailprice")
    return out.select("p_partkey", F.col("bivariate_class").cast("long").alias("bivariate_class"))


def category_classes(spark, sf):
    return rounded(cp.category_classes(orders_n(spark, sf), "prio_n", 3), 6)


def scale(spark, sf):
    return rounded(cp.linear_scale(orders_n(spark, sf), "price_n", 4, 16, "radius").select("o_orderkey", "radius"), 6)


def extrusion(spark, sf):
    return rounded(cp.extrusion(table(spark, sf, "customer"), "c_acctbal", 0.01).select("c_custkey", "height"), 6)


AB = "o_orderstatus = 'O'", "o_orderstatus = 'F'"
OPS = "CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT)"


def _numbers_sql(field, v):
    a, b = AB
    return f"SELECT '{field}' AS field, count({v}) FILTER ({a}) AS count_a, count(*) FILTER ({a}) - count({v}) FILTER ({a}) AS missing_a, round(avg({v}) FILTER ({a}), 4) AS mean_a, count({v}) FILTER ({b}) AS count_b, count(*) FILTER ({b}) - count({v}) FILTER ({b}) AS missing_b, round(avg({v}) FILTER ({b}), 4) AS mean_b, round((avg({v}) FILTER ({a}) - avg({v}) FILTER ({b})) / sqrt((var_samp({v}) FILTER ({a}) + var_samp({v}) FILTER ({b})) / 2), 4) AS effect_size FROM o"


def _category_gap(field):
    return f"SELECT '{field}' AS field, 'categorical' AS kind, sum(abs(s / CAST(ts AS DOUBLE) - r / CAST(tr AS DOUBLE))) / 2 AS strength FROM (SELECT count(*) FILTER (i) AS s, count(*) FILTER (NOT i) AS r, sum(count(*) FILTER (i)) OVER () AS ts, sum(count(*) FILTER (NOT i)) OVER () AS tr, row_number() OVER (ORDER BY count(*) DESC, coalesce({field}, '∅ Missing')) AS k FROM z GROUP BY coalesce({field}, '∅ Missing')) WHERE k <= 8"


def _number_gap(field, value=None):
    v = value or field
    return f"SELECT '{field}' AS field, 'numeric' AS kind, abs(avg({v}) FILTER (i) - avg({v}) FILTER (NOT i)) / stddev_pop({v}) AS strength FROM z"


QUERIES = {
    "co1_membership": (membership, N + "SELECT o_orderkey, coalesce(price_n >= 100000, FALSE) AS member FROM o"),
    "co2_counts": (counts, N + "SELECT count(*) AS total, count(*) FILTER (price_n > 100000) AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (price_n > 100000 AND o_orderstatus = 'O') AS overlap, count(*) FILTER (price_n > 100000 AND o_orderstatus <> 'O') AS a_only, count(*) FILTER (o_orderstatus = 'O' AND NOT coalesce(price_n > 100000, FALSE)) AS b_only FROM o"),
    "co2_counts_remainder": (counts_remainder, N + "SELECT count(*) AS total, count(*) FILTER (price_n > 100000) AS a, count(*) FILTER (NOT price_n > 100000) AS b, CAST(0 AS BIGINT) AS overlap, count(*) FILTER (price_n > 100000) AS a_only, count(*) FILTER (NOT price_n > 100000) AS b_only FROM o"),
    "co3_numbers": (numbers, N + _numbers_sql("price_n", "price_n") + " UNION ALL " + _numbers_sql("mixed_txt", "TRY_CAST(mixed_txt AS DOUBLE)")),
    "co3_bins": (bins, N + ", r AS (SELECT price_n AS v, o_orderstatus AS s FROM o WHERE price_n IS NOT NULL AND o_orderstatus IN ('O', 'F')), b AS (SELECT min(v) AS lo, max(v) AS hi FROM r) SELECT CAST(least(7, floor((v - lo) / ((hi - lo) / 8))) AS BIGINT) AS bin, count(*) FILTER (s = 'O') AS count_a, count(*) FILTER (s = 'F') AS count_b FROM r, b GROUP BY 1"),
    "co4_shares": (shares, N + ", c AS (SELECT coalesce(prio_n, '∅ Missing') AS label, count(*) FILTER (o_orderstatus = 'O') AS count_a, count(*) FILTER (o_orderstatus = 'F') AS count_b FROM o GROUP BY 1) SELECT label, count_a, count_b, round(count_a / (SELECT sum(count_a) FROM c), 6) AS share_a, round(count_b / (SELECT sum(count_b) FROM c), 6) AS share_b, round(count_a / (SELECT sum(count_a) FROM c) - count_b / (SELECT sum(count_b) FROM c), 6) AS share_difference FROM c ORDER BY count_a + count_b DESC, label LIMIT 10"),
    "co5_months": (months, N + "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) FILTER (o_orderstatus = 'O') AS count_a, count(*) FILTER (o_orderstatus = 'F') AS count_b FROM o GROUP BY 1"),
    "cp1_measures": (measures, N + f"SELECT {OPS} AS operand, count(*) AS denominator, round(avg(price_n), 2) AS mean, round(sum(price_n), 2) AS total, count(*) - count(price_n) AS missing FROM o GROUP BY 1"),
    "cp2_shares": (group_shares, N + f", c AS (SELECT {OPS} AS operand, coalesce(prio_n, 'Missing') AS label, count(*) AS count FROM o GROUP BY 1, 2) SELECT operand, label, count, round(count / sum(count) OVER (PARTITION BY operand), 6) AS share FROM c"),
    "cp3_distribution": (distribution, N + f", r AS (SELECT {OPS} AS operand, price_n AS v FROM o WHERE price_n IS NOT NULL), b AS (SELECT *, min(v) OVER (PARTITION BY operand) AS lo, max(v) OVER (PARTITION BY operand) AS hi, count(*) OVER (PARTITION BY operand) AS valid FROM r) SELECT operand, CAST(least(9, floor((v - lo) / ((hi - lo) / 10))) AS BIGINT) AS bin, round(min(v), 6) AS least, round(max(v), 6) AS largest, count(*) AS count, round(count(*) / max(valid), 6) AS share FROM b GROUP BY 1, 2"),
    "cp4_months": (group_months, N + f"SELECT {OPS} AS operand, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS count, round(sum(price_n), 2) AS total FROM o GROUP BY 1, 2"),
    "cp5_located_records": (located, f"WITH p AS ({POINTS}), g AS (SELECT CAST(0 AS BIGINT) AS operand, CAST(pt_id AS VARCHAR) AS key, v AS value, x, y FROM p WHERE v > 5000 UNION ALL SELECT 1, CAST(pt_id AS VARCHAR), v, x, y FROM p WHERE v < 0) SELECT operand, key, round(value, 4) AS value, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT *, row_number() OVER (PARTITION BY operand ORDER BY key) AS k FROM g) WHERE k <= 60"),
    "ex1_selection_gaps": (
        lambda s, d: rounded(cp.selection_gaps(orders_n(s, d), F.col("o_totalprice") > 250000, ["prio_n", "o_orderstatus"]), 6),
        N + ", z AS (SELECT 'prio_n' AS field, coalesce(prio_n, '∅ Missing') AS label, o_totalprice > 250000 AS i FROM o UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice > 250000 FROM o), c AS (SELECT field, label, count(*) FILTER (i) / sum(count(*) FILTER (i)) OVER (PARTITION BY field) AS a, count(*) FILTER (NOT i) / sum(count(*) FILTER (NOT i)) OVER (PARTITION BY field) AS b FROM z GROUP BY 1, 2) SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY abs(a - b) DESC, label) AS INT) AS place, label, round(a, 6) AS selected_share, round(b, 6) AS rest_share, round(abs(a - b), 6) AS gap FROM c QUALIFY place <= 3",
    ),
    "ex1_explain_any": (
        lambda s, d: rounded(cp.explain_any(orders_n(s, d).select("price_n", "o_custkey", "prio_n", "o_orderstatus", "mixed_txt"), F.col("price_n") > 250000), 6),
        N + ", z AS (SELECT *, coalesce(price_n > 250000, false) AS i FROM o) SELECT field, kind, round(strength, 6) AS strength FROM (" + " UNION ALL ".join([_number_gap("price_n"), _number_gap("o_custkey"), _number_gap("mixed_txt", "TRY_CAST(mixed_txt AS DOUBLE)"), _category_gap("prio_n"), _category_gap("o_orderstatus")]) + ")",
    ),
    "ex1_explain_selection": (explain, N + ", z AS (SELECT *, o_totalprice > 250000 AS i FROM o) SELECT field, kind, round(strength, 6) AS strength FROM (" + " UNION ALL ".join([_number_gap("price_n"), _number_gap("o_custkey"), _category_gap("prio_n"), _category_gap("o_orderstatus")]) + ")"),
    "cls1_equal_breaks": (equal, "SELECT " + ", ".join(f"round(min(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * {i} / 5, 6) AS b{i}" for i in range(1, 5)) + " FROM part"),
    "cls2_quantile_breaks": (quantile, "SELECT " + ", ".join(f"quantile_disc(p_retailprice, {i / 4}) AS b{i}" for i in range(1, 4)) + " FROM part"),
    "cls4_classes": (classes, N + "SELECT o_orderkey, CAST(CASE WHEN price_n IS NULL THEN NULL WHEN price_n >= 200000 THEN 3 WHEN price_n >= 100000 THEN 2 WHEN price_n >= 50000 THEN 1 ELSE 0 END AS BIGINT) AS class FROM o"),
    "cls5_bivariate": (bivariate, "WITH q AS (SELECT quantile_disc(p_size, 1 / 3.0::DOUBLE) AS a1, quantile_disc(p_size, 2 / 3.0::DOUBLE) AS a2, quantile_disc(p_retailprice, 1 / 3.0::DOUBLE) AS b1, quantile_disc(p_retailprice, 2 / 3.0::DOUBLE) AS b2 FROM part) SELECT p_partkey, CAST(3 * (CAST(p_retailprice >= b1 AS INT) + CAST(p_retailprice >= b2 AS INT)) + CAST(p_size >= a1 AS INT) + CAST(p_size >= a2 AS INT) AS BIGINT) AS bivariate_class FROM part, q"),
    "cls6_category_classes": (category_classes, N + ", c AS (SELECT prio_n, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN prio_n IS NULL THEN 1 ELSE 0 END, count(*) DESC, prio_n) AS k FROM o GROUP BY 1), g AS (SELECT CASE WHEN prio_n IS NULL THEN 'No data' WHEN k <= 3 THEN prio_n ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1) SELECT label, count, round(count / (SELECT sum(count) FROM g), 6) AS share FROM g"),
    "cls7_linear_scale": (scale, N + "SELECT o_orderkey, round(4 + (price_n - min(price_n) OVER ()) / (max(price_n) OVER () - min(price_n) OVER ()) * 12, 6) AS radius FROM o"),
    "cls8_extrusion": (extrusion, "SELECT c_custkey, round(greatest(0, coalesce(c_acctbal * 0.01::DOUBLE, 0)), 6) AS height FROM customer"),
}
