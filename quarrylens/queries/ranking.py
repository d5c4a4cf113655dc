"""Ranks, running sums, scores, sensitivity, allocation, sorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import charts as ch
from quarrylens.operators import filters as fl
from quarrylens.operators import ranking as rk
from quarrylens.operators import score as sc
from quarrylens.queries.inputs import ORDERS_N, orders_n, rounded, table

N = f"WITH o AS ({ORDERS_N}) "
CRITERIA = [{"field": "price_n", "weight": 2, "method": "minmax"}, {"field": "o_custkey", "weight": 1, "method": "zscore", "direction": "lower"}]
RANKED = [*CRITERIA, {"field": "o_totalprice", "weight": 1, "method": "rank"}]


def row_numbers(spark, sf):
    return rk.row_number(table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", ["l_partkey"], "k", True).select("l_partkey", F.col("k").cast("long").alias("k"))


def ranks(spark, sf):
    return rk.rank(orders_n(spark, sf), "price_n", "r").select("o_orderkey", "r")


def tied_ranks(spark, sf):
    return rk.rank(table(spark, sf, "lineitem"), "l_quantity", "r").groupBy("l_quantity", "r").agg(F.count("*").alias("n"))


def percent_ranks(spark, sf):
    return rounded(rk.percent_rank(orders_n(spark, sf), "price_n", "p").select("o_orderkey", "p"), 8)


def over_all(spark, sf):
    o = orders_n(spark, sf)
    out = rk.over_all(o, lo=F.min("price_n"), hi=F.max("price_n"), mean=F.avg("price_n"), sd=F.stddev_pop("price_n"))
    return rounded(out.select("o_orderkey", ((F.col("price_n") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("share"), ((F.col("price_n") - F.col("mean")) / F.col("sd")).alias("z")), 6)


def running(spark, sf):
    out = rk.running_sum(table(spark, sf, "orders"), F.expr("CAST(round(o_totalprice * 100) AS BIGINT)"), "o_orderdate", ["o_orderkey"], "cum", descending=False)
    return out.select("o_orderkey", "cum")


def running_by(spark, sf):
    out = rk.running_sum(table(spark, sf, "orders"), F.expr("CAST(round(o_totalprice * 100) AS BIGINT)"), "o_totalprice", ["o_orderkey"], "cum", partition=["o_orderstatus"])
    return out.select("o_orderkey", "cum")


def running_one_value(spark, sf):
    """One value and null in the order column, in small buckets: places follow the row id."""
    from quarrylens.operators import ranking

    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, 7.0).alias("v"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ranking.running_sum(o, F.col("cents"), "v", ["o_orderkey"], "cum", rows_per_bucket=500).select("o_orderkey", "cum")


def counted(spark, sf):
    p = table(spark, sf, "part").where("p_size > 40")
    rows = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).crossJoin(F.broadcast(p.agg(F.count("*").alias("total"))))
    return rows.select("p_partkey", "total")


def _score(missing, criteria):
    return lambda spark, sf: rounded(sc.score(orders_n(spark, sf), criteria, missing=missing).select("o_orderkey", "score"), 6)


def contributions(spark, sf):
    return rounded(sc.score(orders_n(spark, sf), CRITERIA, contributions=True).select("o_orderkey", "score", "score_c_price_n", "score_c_o_custkey"), 6)


def score_ranks(spark, sf):
    return sc.score(table(spark, sf, "part"), [{"field": "p_size", "weight": 1}], ranked=True).select("p_partkey", "score_rank")


def preview(spark, sf):
    return rounded(sc.preview(orders_n(spark, sf), CRITERIA, 30, "o_orderkey", missing="exclude").select("o_orderkey", "score", "score_rank", "total_rows", "scored_rows"), 6)


def sensitivity(spark, sf):
    return rounded(sc.sensitivity(table(spark, sf, "part"), [{"field": "p_size", "weight": 2}, {"field": "p_retailprice", "weight": 1}]), 5)


def _allocate(mode, *columns):
    return lambda spark, sf: rounded(sc.allocate(orders_n(spark, sf).withColumn("price_n", F.expr("CAST(floor(price_n) AS DOUBLE)")), "price_n", 3e7, "o_orderdate", ["o_orderkey"], mode, partition=["o_orderstatus"]).select("o_orderkey", *columns), 1)


def text_ranks(spark, sf):
    return rk.rank(table(spark, sf, "documents").select("doc_id", "text"), "text", "r").select("doc_id", "r")


def label(spark, sf):
    c = table(spark, sf, "customer")
    return spark.range(1).select(F.lit(sc.label_column(c, "c_custkey")).alias("label_column"), F.lit(c.count()).cast("long").alias("rows"))


def seeded(spark, sf):
    return ch.sample(table(spark, sf, "events"), "event_id", 1200, 7).select("event_id")


def norm(v, stats):
    return f"({v} - min({v}) OVER ()) / nullif(max({v}) OVER () - min({v}) OVER (), 0)" if stats == "minmax" else f"({v} - avg({v}) OVER ()) / nullif(stddev_pop({v}) OVER (), 0)"


V = {"zero": "coalesce(price_n, 0)", "mean": "coalesce(price_n, m)", "exclude": "price_n"}


def score_sql(missing, ranked=False):
    total = 4.0 if ranked else 3.0
    third = f" + 1 / {total} * percent_rank() OVER (ORDER BY o_totalprice ASC NULLS LAST)" if ranked else ""
    return N + f", v AS (SELECT o_orderkey, o_totalprice, {V[missing]} AS a, CAST(o_custkey AS DOUBLE) AS b FROM o, (SELECT avg(price_n) AS m FROM o)), s AS (SELECT o_orderkey, 2 / {total} * ({norm('a', 'minmax')}) AS ca, 1 / {total} * -({norm('b', 'zscore')}) AS cb{', 1' if False else ''}, 2 / {total} * ({norm('a', 'minmax')}) + 1 / {total} * -({norm('b', 'zscore')}){third} AS score FROM v) "


SENS = "WITH n AS (SELECT (p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) AS a, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part), s AS (SELECT 2 / 3.0::DOUBLE * a + 1 / 3.0::DOUBLE * b AS s0, 2.5 / 3.5::DOUBLE * a + 1 / 3.5::DOUBLE * b AS s1, 2 / 3.25::DOUBLE * a + 1.25 / 3.25::DOUBLE * b AS s2 FROM n), r AS (SELECT rank() OVER (ORDER BY s0 DESC) AS r0, rank() OVER (ORDER BY s1 DESC) AS r1, rank() OVER (ORDER BY s2 DESC) AS r2 FROM s) "
ALLOC = N + ", c AS (SELECT *, coalesce(floor(price_n), 0) AS a, sum(coalesce(floor(price_n), 0)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS cum FROM o) "

QUERIES = {
    "rk1_row_number": (row_numbers, "SELECT l_partkey, row_number() OVER (ORDER BY n DESC, l_partkey) AS k FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)"),
    "rk2_rank": (ranks, N + "SELECT o_orderkey, rank() OVER (ORDER BY price_n DESC NULLS LAST) AS r FROM o"),
    "rk2_rank_ties": (tied_ranks, "SELECT l_quantity, r, count(*) AS n FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) GROUP BY 1, 2"),
    "rk2_rank_texts": (text_ranks, "SELECT doc_id, rank() OVER (ORDER BY text DESC NULLS LAST) AS r FROM documents"),
    "rk3_percent_rank": (percent_ranks, N + "SELECT o_orderkey, round(percent_rank() OVER (ORDER BY price_n ASC NULLS LAST), 8) AS p FROM o"),
    "rk4_over_all": (over_all, N + "SELECT o_orderkey, round((price_n - min(price_n) OVER ()) / (max(price_n) OVER () - min(price_n) OVER ()), 6) AS share, round((price_n - avg(price_n) OVER ()) / stddev_pop(price_n) OVER (), 6) AS z FROM o"),
    "rk5_running_sum": (running, "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM orders"),
    "rk5_running_sum_one_value": (running_one_value, "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey % 3 = 0, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM orders"),
    "rk5_running_sum_by_group": (running_by, "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM orders"),
    "rk6_counted_page": (counted, "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 40) AS total FROM part WHERE p_size > 40 ORDER BY p_retailprice DESC, p_partkey LIMIT 20"),
    "sc1_score_zero": (_score("zero", CRITERIA), score_sql("zero") + "SELECT o_orderkey, round(score, 6) AS score FROM s"),
    "sc1_score_mean": (_score("mean", CRITERIA), score_sql("mean") + "SELECT o_orderkey, round(score, 6) AS score FROM s"),
    "sc1_score_exclude": (_score("exclude", CRITERIA), score_sql("exclude") + "SELECT o_orderkey, round(score, 6) AS score FROM s"),
    "sc1_score_rank_method": (_score("zero", RANKED), score_sql("zero", True) + "SELECT o_orderkey, round(score, 6) AS score FROM s"),
    "sc2_contributions": (contributions, score_sql("zero") + "SELECT o_orderkey, round(score, 6) AS score, round(ca, 6) AS score_c_price_n, round(cb, 6) AS score_c_o_custkey FROM s"),
    "sc3_score_ranks": (score_ranks, "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS score_rank FROM part"),
    "sc3_preview": (preview, score_sql("exclude") + "SELECT o_orderkey, round(score, 6) AS score, r AS score_rank, (SELECT count(*) FROM s) AS total_rows, (SELECT count(score) FROM s) AS scored_rows FROM (SELECT *, rank() OVER (ORDER BY score DESC NULLS LAST) AS r FROM s) ORDER BY r, o_orderkey LIMIT 30"),
    "sc4_sensitivity": (sensitivity, SENS + "SELECT 'p_size' AS field, round(corr(r0, r1), 5) AS rank_correlation, count(*) FILTER (r0 <= 20 AND r1 > 20) AS left_top, round(avg(abs(r0 - r1)), 5) AS mean_shift FROM r UNION ALL SELECT 'p_retailprice', round(corr(r0, r2), 5), count(*) FILTER (r0 <= 20 AND r2 > 20), round(avg(abs(r0 - r2)), 5) FROM r"),
    "sc5_label_column": (label, "SELECT 'c_name' AS label_column, count(*) AS rows FROM customer"),
    "al1_allocate_flag": (_allocate("flag", "cumulative_price_n", "price_n_status"), ALLOC + "SELECT o_orderkey, round(cum, 1) AS cumulative_price_n, CASE WHEN cum <= 3e7 THEN 'within' ELSE 'over' END AS price_n_status FROM c"),
    "al2_allocate_cut": (_allocate("cut", "cumulative_price_n"), ALLOC + "SELECT o_orderkey, round(cum, 1) AS cumulative_price_n FROM c WHERE cum <= 3e7"),
    "al3_allocate_scale": (_allocate("scale", "allocated_price_n"), ALLOC + "SELECT o_orderkey, round(least(a, greatest(0, 3e7 - (cum - a))), 1) AS allocated_price_n FROM c"),
    "st1_sorted_page": (lambda s, d: fl.ordered(orders_n(s, d), "prio_n", "o_orderkey", most=500).select("o_orderkey", "prio_n"), N + "SELECT o_orderkey, prio_n FROM o ORDER BY prio_n ASC NULLS LAST, o_orderkey LIMIT 500"),
    "st2_result_cap": (lambda s, d: fl.ordered(table(s, d, "events"), "ts", "event_id", descending=True).select("event_id", "ts"), "SELECT event_id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 5000"),
    "st3_top_groups": (lambda s, d: ch.top_groups(orders_n(s, d), "prio_n", 4), N + "SELECT prio_n AS label, count(*) AS count FROM o GROUP BY 1 ORDER BY count DESC, label NULLS LAST LIMIT 4"),
    "st4_top_and_other": (lambda s, d: ch.top_and_other(table(s, d, "part"), "p_brand", 5).select("label", "count"), "WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1) SELECT CASE WHEN k <= 5 THEN p_brand ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1"),
    "st5_sample": (seeded, "SELECT event_id FROM events ORDER BY md5(event_id || ':7'), event_id LIMIT 1200"),
}
