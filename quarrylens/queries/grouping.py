"""Grouped summaries, KPIs, quantiles and field summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import orderstat as os_
from quarrylens.operators import summarise as sm
from quarrylens.queries.inputs import ORDERS_N, orders_n, rounded, table

MERGED = ["o_custkey", "prio_n", "price_n"]


def merged_distinct(spark, sf):
    """Distinct values by status and over all statuses, the latter from the bitmaps of the former alone."""
    o = orders_n(spark, sf)
    parts = os_.distinct_bitmaps(o, os_.value_numbers(o, MERGED), MERGED, ["o_orderstatus"])
    own, all_ = os_.distinct_of_bitmaps(parts, ["o_orderstatus"]), os_.distinct_of_bitmaps(parts, [])
    return own.unionByName(all_.withColumn("o_orderstatus", F.lit("all")))


def chosen_fields(spark, sf):
    """The numeric ones among fields of which two are texts: one of numbers throughout, one with some that are not."""
    o = orders_n(spark, sf)
    return rounded(sm.chosen_field_summary(o, F.col("o_orderkey") % 10 == 0, F.col("o_orderstatus") == "O", ["cust_txt", "mixed_txt", "prio_n", "price_n"]), 2)


N = f"WITH o AS ({ORDERS_N}) "
PERIOD = {"type": "temporal", "field": "o_orderdate", "min": "1995-01-01 00:00:00", "max": "1995-12-31 23:59:59.999"}
OPEN = {"type": "category", "field": "o_orderstatus", "values": ["O"]}


def summary(spark, sf):
    measures = [{"fn": "count"}, {"fn": "count", "field": "price_n"}, {"fn": "count_distinct", "field": "o_custkey"}, {"fn": "sum", "field": "price_n"}, {"fn": "avg", "field": "mixed_txt"}, {"fn": "median", "field": "price_n"}, {"fn": "min", "field": "o_orderdate"}, {"fn": "max", "field": "prio_n"}]
    return rounded(sm.summarise(orders_n(spark, sf), ["o_orderstatus", "prio_n"], measures), 2)


def summary_all(spark, sf):
    return rounded(sm.summarise(orders_n(spark, sf), [], [{"fn": "count"}, {"fn": "avg", "field": "price_n"}, {"fn": "sum", "field": "mixed_txt"}, {"fn": "min", "field": "o_orderpriority"}]), 3)


def filtered_measures(spark, sf):
    return rounded(sm.filtered_measures(orders_n(spark, sf), ["o_orderpriority"], [OPEN], "sum", "price_n"), 2)


def _kpi(compare, cohort=None):
    return lambda spark, sf: rounded(sm.kpi(orders_n(spark, sf), "sum", "price_n", [PERIOD, OPEN], compare, cohort).drop("note"), 4)


def field_summary(spark, sf):
    o = orders_n(spark, sf)
    return rounded(sm.field_summary(o, ["price_n", "o_custkey"], F.col("o_orderkey") % 10 == 0, F.col("o_orderstatus") == "O"), 2)


def category_summary(spark, sf):
    return sm.category_summary(table(spark, sf, "part"), "p_brand", F.col("p_partkey") % 10 == 0, F.col("p_size") > 20)


K = N + "SELECT round(sum(price_n) FILTER ({a}), 4) AS value, count(*) FILTER ({a}) AS active_rows, round(sum(price_n), 4) AS total_value, count(*) AS total_rows, round({c}, 4) AS comparison, round((sum(price_n) FILTER ({a}) - {c}) / abs({c}), 4) AS delta FROM o"
A = "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31 23:59:59.999' AND o_orderstatus = 'O'"
P = "o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1994-12-31 23:59:59.999' AND o_orderstatus = 'O'"


def _scopes(field, value):
    one = lambda scope, where: f"SELECT '{field}' AS field, '{scope}' AS scope, count({value}) FILTER ({where}) AS count, round(min({value}) FILTER ({where}), 2) AS min, round(max({value}) FILTER ({where}), 2) AS max, round(avg({value}) FILTER ({where}), 2) AS mean, round(sum({value}) FILTER ({where}), 2) AS sum FROM o"
    return " UNION ALL ".join([one("selected", "o_orderkey % 10 = 0"), one("active", "o_orderstatus = 'O'"), one("total", "TRUE")])


QUERIES = {
    "ag1_summarise": (summary, N + "SELECT o_orderstatus, prio_n, count(*) AS row_count, count(price_n) AS count_price_n, count(DISTINCT o_custkey) AS count_distinct_o_custkey, round(sum(price_n), 2) AS sum_price_n, round(avg(TRY_CAST(mixed_txt AS DOUBLE)), 2) AS avg_mixed_txt, round(median(price_n), 2) AS median_price_n, min(o_orderdate) AS min_o_orderdate, max(prio_n) AS max_prio_n FROM o GROUP BY 1, 2"),
    "ag2_summarise_all": (summary_all, N + "SELECT count(*) AS row_count, round(avg(price_n), 3) AS avg_price_n, round(sum(TRY_CAST(mixed_txt AS DOUBLE)), 3) AS sum_mixed_txt, min(o_orderpriority) AS min_o_orderpriority FROM o"),
    "ag4_kpi_total": (_kpi("total"), K.format(a=A, c="sum(price_n)")),
    "ag4_kpi_previous_period": (_kpi("previous-period"), K.format(a=A, c=f"sum(price_n) FILTER ({P})")),
    "ag4_kpi_cohort": (_kpi("cohort", [{"type": "category", "field": "o_orderstatus", "values": ["F"]}]), K.format(a=A, c="sum(price_n) FILTER (o_orderstatus = 'F')")),
    "ag5_field_summary": (field_summary, N + _scopes("price_n", "price_n") + " UNION ALL " + _scopes("o_custkey", "CAST(o_custkey AS DOUBLE)")),
    "ag5_category_summary": (category_summary, "SELECT p_brand AS label, count(*) FILTER (p_partkey % 10 = 0) AS selected, count(*) FILTER (p_size > 20) AS active, count(*) AS total FROM part GROUP BY 1 ORDER BY selected DESC, active DESC, total DESC, label LIMIT 6"),
    "ag6_merged_distinct": (merged_distinct, N + " UNION ALL ".join(f"SELECT {g} AS o_orderstatus, '{f}' AS field, count(DISTINCT {f}) AS distinct_count FROM o {by}" for f in MERGED for g, by in (("o_orderstatus", "GROUP BY 1"), ("'all'", "")))),
    "ag5_chosen_fields": (chosen_fields, N + " UNION ALL ".join(_scopes(f, f"TRY_CAST({f} AS DOUBLE)") for f in ("cust_txt", "mixed_txt", "price_n"))),
    "ag6_distinct_counts": (lambda s, d: sm.distinct_counts(table(s, d, "lineitem"), ["l_partkey", "l_returnflag", "l_shipdate"]), "SELECT 'l_partkey' AS field, count(DISTINCT l_partkey) AS distinct_count FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem"),
    "ag7_quantiles": (lambda s, d: rounded(sm.quantiles(table(s, d, "lineitem"), "l_extendedprice"), 4), "SELECT round(quantile_cont(l_extendedprice, 0), 4) AS q0, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(quantile_cont(l_extendedprice, 1), 4) AS q100 FROM lineitem"),
    "ag8_moments": (lambda s, d: rounded(sm.moments(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 6), "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS stddev_pop, round(stddev_samp(l_quantity), 6) AS stddev_samp, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1"),
    "ag9_ids_per_group": (lambda s, d: sm.ids_per_group(table(s, d, "orders"), "o_orderpriority", "o_orderkey"), "SELECT o_orderpriority, count(*) AS count, array_to_string(list_slice(list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR)), 1, 200), chr(31)) AS ids FROM orders GROUP BY 1"),
    "ag10_filtered_measures": (filtered_measures, N + "SELECT o_orderpriority, count(*) AS total_count, round(sum(price_n), 2) AS total_value, count(*) FILTER (o_orderstatus = 'O') AS count, round(sum(price_n) FILTER (o_orderstatus = 'O'), 2) AS value FROM o GROUP BY 1"),
    "ag11_date_range": (lambda s, d: sm.date_range(table(s, d, "orders"), "o_orderdate"), "SELECT CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date, count(o_orderdate) AS dated_rows FROM orders"),
}
