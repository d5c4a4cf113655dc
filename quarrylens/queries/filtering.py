"""Filters, search, criteria, funnels, selections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import filters as fl
from quarrylens.operators import joins as jn
from quarrylens.queries.inputs import ORDERS_N, orders_n, rounded, table

N = f"WITH o AS ({ORDERS_N}) "


def _ids(df):
    return df.select("o_orderkey")


def _filter(*specs):
    return lambda spark, sf: _ids(fl.filtered(orders_n(spark, sf), list(specs)))


CONDITIONS = [
    {"label": "large", "expression": "price_n > 100000", "hard": True},
    {"label": "open", "expression": "o_orderstatus = 'O'", "hard": True},
    {"label": "urgent", "expression": "prio_n = '1-URGENT'", "hard": False},
]
TESTS = "SELECT *, coalesce(price_n > 100000, FALSE) AS p1, coalesce(o_orderstatus = 'O', FALSE) AS p2, coalesce(prio_n = '1-URGENT', FALSE) AS p3 FROM o"


def criteria_tag(spark, sf):
    return fl.criteria(orders_n(spark, sf), CONDITIONS).select("o_orderkey", "excluded", "excluded_by", F.col("excluded_count").cast("long").alias("excluded_count"))


def criteria_drop(spark, sf):
    return fl.criteria(orders_n(spark, sf), CONDITIONS, "drop").select("o_orderkey", "excluded_by")


def funnel(spark, sf):
    return fl.funnel(orders_n(spark, sf), CONDITIONS).select(F.col("position").cast("long").alias("position"), "label", "hard", "total", "removed_alone", "removed_here", "remaining")


def top_n(spark, sf):
    return fl.top_n(table(spark, sf, "part"), "p_size", 40).select("p_partkey", "p_size")


def window_frames(spark, sf):
    return fl.window_frames(table(spark, sf, "orders"), "o_orderdate", 90)


def id_selection(spark, sf):
    ids = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return fl.select_ids(table(spark, sf, "orders"), ids, "o_custkey").select("o_orderkey")


def row_numbers(spark, sf):
    numbers = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("n"))
    return fl.select_rows(table(spark, sf, "orders"), numbers, "o_orderdate", ["o_orderkey"]).select("o_orderkey")


def selection_add(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    c = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return fl.selection(o, c, "add")


def selection_subtract(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    c = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return fl.selection(o, c, "subtract")


def page(spark, sf):
    rows = fl.page(orders_n(spark, sf), [{"type": "range", "field": "o_totalprice", "min": 50000}], "price_n", True, "o_orderkey", 25, 3)
    return rounded(rows.select("o_orderkey", "price_n", "filtered_count"))


def record(spark, sf):
    return fl.record(table(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


def join_left(spark, sf):
    keyed = table(spark, sf, "customer").withColumn("k", F.when(F.col("c_custkey") % 3 == 0, 100 + F.col("c_nationkey")).when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey")))
    out = jn.attribute_join(keyed, table(spark, sf, "nation"), "k", "n_nationkey")  # some keys are null, some are no nation's
    return out.select("c_custkey", "r_n_name")


def join_inner(spark, sf):
    out = jn.attribute_join(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "inner")
    return rounded(out.groupBy("r_c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


def membership(spark, sf):
    ids = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return jn.with_membership(table(spark, sf, "orders"), ids, "o_custkey", "rich").groupBy("rich").agg(F.count("*").alias("n"))


def semi_join(spark, sf):
    ids = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return jn.materialise_selected(table(spark, sf, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


def _years(spark, sf):
    """All orders in two groups: those of even and of odd years."""
    o = orders_n(spark, sf)
    return [o.where(F.year("o_orderdate") % 2 == 0), o.where(F.year("o_orderdate") % 2 == 1)]


YEARS = N + ", a AS (SELECT * FROM o WHERE year(o_orderdate) % 2 = 0), b AS (SELECT * FROM o WHERE year(o_orderdate) % 2 = 1), ka AS (SELECT CAST(o_custkey AS VARCHAR) AS key, sum(price_n) AS v FROM a GROUP BY 1), kb AS (SELECT CAST(o_custkey AS VARCHAR) AS key, sum(price_n) AS v FROM b GROUP BY 1) "


def aligned(spark, sf):
    out = jn.align(_years(spark, sf), "o_custkey", "price_n")
    return rounded(out.select("key", F.coalesce("present_0", F.lit(False)).alias("present_0"), F.coalesce("present_1", F.lit(False)).alias("present_1"), "value_0", "value_1", "delta"), 2)


def aligned_page(spark, sf):
    return rounded(jn.aligned_page(_years(spark, sf), "o_custkey", "price_n").select("key", "value_0", "value_1", "total_keys"), 2)


def overlaps(spark, sf):
    return jn.overlaps(_years(spark, sf), "o_custkey").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "shared")


def difference(spark, sf):
    return rounded(jn.difference(*_years(spark, sf), "o_custkey", "price_n"), 2)


def column_mean(spark, sf):
    out = jn.with_column_mean(table(spark, sf, "supplier"), "s_acctbal", "mean")
    return out.select("s_suppkey", (F.col("s_acctbal") > F.col("mean")).alias("above"))


def union_keys(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


def shared_keys(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, sf, "supplier").select("s_nationkey")).agg(F.count("*").alias("shared"))


def remainder(spark, sf):
    rows = orders_n(spark, sf)
    p = F.col("price_n") > 100000
    return rows.where(~p).select("o_orderkey")


QUERIES = {
    "flt1_sql_condition": (lambda s, d: _ids(fl.where_sql(orders_n(s, d), "o_totalprice > 150000 AND o_orderstatus = 'F'")), N + "SELECT o_orderkey FROM o WHERE o_totalprice > 150000 AND o_orderstatus = 'F'"),
    "flt2_category": (_filter({"type": "category", "field": "prio_n", "values": ["1-URGENT", "2-HIGH"], "include_null": True}), N + "SELECT o_orderkey FROM o WHERE prio_n IN ('1-URGENT', '2-HIGH') OR prio_n IS NULL"),
    "flt3_range": (_filter({"type": "range", "field": "mixed_txt", "min": 10, "max": 700}), N + "SELECT o_orderkey FROM o WHERE TRY_CAST(mixed_txt AS DOUBLE) BETWEEN 10 AND 700"),
    "flt4_temporal": (_filter({"type": "temporal", "field": "o_orderdate", "min": "1994-01-01", "max": "1995-06-30"}), N + "SELECT o_orderkey FROM o WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'"),
    "flt5_text": (_filter({"type": "text", "field": "prio_n", "operator": "contains", "query": "High"}), N + "SELECT o_orderkey FROM o WHERE contains(lower(prio_n), 'high')"),
    "flt5_text_ends": (_filter({"type": "text", "field": "o_orderpriority", "operator": "ends_with", "query": "GENT", "case_sensitive": True}), N + "SELECT o_orderkey FROM o WHERE ends_with(o_orderpriority, 'GENT')"),
    "flt6_boolean": (lambda s, d: _ids(fl.filtered(orders_n(s, d).withColumn("flag", F.when(F.col("o_orderkey") % 3 == 0, "yes").when(F.col("o_orderkey") % 3 == 1, "no")), [{"type": "boolean", "field": "flag", "value": True}])), N + "SELECT o_orderkey FROM o WHERE o_orderkey % 3 = 0"),
    "flt7_null": (_filter({"type": "null", "field": "price_n", "is_null": True}), N + "SELECT o_orderkey FROM o WHERE price_n IS NULL"),
    "flt8_exclude": (_filter({"type": "range", "field": "price_n", "min": 50000, "mode": "exclude"}), N + "SELECT o_orderkey FROM o WHERE NOT coalesce(price_n >= 50000, FALSE)"),
    "flt9_search": (lambda s, d: fl.search(table(s, d, "part"), "st").select("p_partkey"), "SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) ILIKE '%st%' OR p_name ILIKE '%st%' OR p_brand ILIKE '%st%' OR p_type ILIKE '%st%'"),
    "flt10_id_selection": (id_selection, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "flt10_row_numbers": (row_numbers, "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k IN (SELECT c_custkey * 3 FROM customer)"),
    "flt11_criteria_tag": (criteria_tag, N + f", t AS ({TESTS}) SELECT o_orderkey, NOT (p1 AND p2) AS excluded, nullif(concat_ws(' · ', CASE WHEN NOT p1 THEN 'large' END, CASE WHEN NOT p2 THEN 'open' END, CASE WHEN NOT p3 THEN 'urgent' END), '') AS excluded_by, CAST(CAST(NOT p1 AS INT) + CAST(NOT p2 AS INT) + CAST(NOT p3 AS INT) AS BIGINT) AS excluded_count FROM t"),
    "flt11_criteria_drop": (criteria_drop, N + f", t AS ({TESTS}) SELECT o_orderkey, CASE WHEN NOT p3 THEN 'urgent' END AS excluded_by FROM t WHERE p1 AND p2"),
    "flt12_funnel": (funnel, N + f", t AS ({TESTS}), a AS (SELECT count(*) AS total, count(*) FILTER (NOT p1) AS r1, count(*) FILTER (NOT p2) AS r2, count(*) FILTER (NOT p3) AS r3, count(*) FILTER (p1) AS k1, count(*) FILTER (p1 AND NOT p2) AS h2, count(*) FILTER (p1 AND p2) AS k2 FROM t) SELECT CAST(0 AS BIGINT) AS position, 'large' AS label, TRUE AS hard, total, r1 AS removed_alone, r1 AS removed_here, k1 AS remaining FROM a UNION ALL SELECT 1, 'open', TRUE, total, r2, h2, k2 FROM a UNION ALL SELECT 2, 'urgent', FALSE, total, r3, NULL, NULL FROM a"),
    "flt13_top_n": (top_n, "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC NULLS LAST) AS r FROM part) WHERE r <= 40"),
    "flt14_window_frames": (window_frames, "WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS low FROM orders), f AS (SELECT CAST(floor(date_diff('day', low, CAST(o_orderdate AS DATE)) / 90.0) AS BIGINT) AS frame, low FROM orders, b) SELECT frame, CAST(low + CAST(frame * 90 AS INT) AS DATE) AS start, CAST(low + CAST(frame * 90 + 89 AS INT) AS DATE) AS \"end\", count(*) AS n FROM f GROUP BY frame, low"),
    "flt15_selection_add": (selection_add, "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "flt15_selection_subtract": (selection_subtract, "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "flt17_page": (page, N + "SELECT o_orderkey, round(price_n, 4) AS price_n, (SELECT count(*) FROM o WHERE o_totalprice >= 50000) AS filtered_count FROM (SELECT * FROM o WHERE o_totalprice >= 50000 ORDER BY price_n DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 75)"),
    "flt18_record": (record, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7"),
    "jn1_left_join": (join_left, "SELECT c_custkey, n_name AS r_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 3 = 1"),
    "jn1_inner_join": (join_inner, "SELECT c_mktsegment AS r_c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "jn6_membership": (membership, "SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS rich, count(*) AS n FROM orders GROUP BY 1"),
    "jn7_materialise_selected": (semi_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "jn8_align": (aligned, YEARS + "SELECT coalesce(ka.key, kb.key) AS key, ka.key IS NOT NULL AS present_0, kb.key IS NOT NULL AS present_1, round(ka.v, 2) AS value_0, round(kb.v, 2) AS value_1, round(kb.v - ka.v, 2) AS delta FROM ka FULL JOIN kb ON ka.key = kb.key"),
    "jn8_aligned_page": (aligned_page, YEARS + ", j AS (SELECT coalesce(ka.key, kb.key) AS key, round(ka.v, 2) AS value_0, round(kb.v, 2) AS value_1 FROM ka FULL JOIN kb ON ka.key = kb.key) SELECT *, (SELECT count(*) FROM j) AS total_keys FROM j ORDER BY key LIMIT 250"),
    "jn9_overlaps": (overlaps, YEARS + "SELECT CAST(0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, count(*) AS shared FROM ka JOIN kb USING (key)"),
    "jn10_difference": (difference, YEARS + "SELECT key, round(ka.v, 2) AS value_0, round(kb.v, 2) AS value_1, round(kb.v - ka.v, 2) AS delta FROM ka JOIN kb USING (key) WHERE kb.v - ka.v IS NOT NULL"),
    "jn11_column_mean": (column_mean, "SELECT s_suppkey, s_acctbal > (SELECT avg(s_acctbal) FROM supplier) AS above FROM supplier"),
    "so1_union_keys": (union_keys, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "so2_shared_keys": (shared_keys, "SELECT count(*) AS shared FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)"),
    "so3_remainder": (remainder, N + "SELECT o_orderkey FROM o WHERE NOT price_n > 100000"),
}
