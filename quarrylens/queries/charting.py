"""Charts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import charts as ch
from quarrylens.operators import profile as pf
from quarrylens.operators.spatial import box_ring
from quarrylens.queries.inputs import ORDERS_N, POINTS, orders_n, points, rounded, table

N = f"WITH o AS ({ORDERS_N}) "
OPEN = {"type": "category", "field": "o_orderstatus", "values": ["O"]}
URGENT = {"type": "category", "field": "o_orderpriority", "values": ["1-URGENT"]}
LARGE = {"type": "range", "field": "o_totalprice", "min": 100000}


def category(spark, sf):
    return rounded(ch.category_chart(orders_n(spark, sf), "prio_n", [OPEN, {"type": "category", "field": "prio_n", "values": ["2-HIGH"]}], "avg", "price_n"), 3)


def category_ids(spark, sf):
    return ch.category_chart(orders_n(spark, sf), "prio_n", [OPEN], "count", most=3, row_id="o_orderkey").select("label", "total_count", "ids")


def bad_rings(spark, sf):
    """Boxes around the points; those of negative value have no width, every ninth is missing."""
    width = F.when(F.col("v") > 0, 1.0).otherwise(0.0)
    box = points(spark, sf).select("pt_id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + width).alias("xmax"), (F.col("y") + 1).alias("ymax"))
    return pf.geometry_issues(box.select(F.when(F.col("pt_id") % 9 != 0, box_ring()).alias("ring")), "ring")


def histogram(spark, sf):
    return rounded(ch.histogram(orders_n(spark, sf), "price_n", [OPEN, {"type": "range", "field": "price_n", "min": 5}]).select(F.col("bin").cast("long").alias("bin"), "bin_start", "total_count", "count"), 3)


def temporal(spark, sf):
    return rounded(ch.temporal_chart(orders_n(spark, sf), "o_orderdate", [OPEN], "sum", "price_n", "quarter", "prio_n", 2), 2)


def grain(spark, sf):
    o = table(spark, sf, "orders")
    low, high = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    return spark.range(1).select(F.lit(ch.choose_grain(low, high)).alias("grain"))


def buckets(spark, sf):
    return ch.time_buckets(table(spark, sf, "orders"), "o_orderdate", "month")


def facets(spark, sf):
    return rounded(ch.facets(orders_n(spark, sf), "o_orderstatus", "prio_n", [LARGE], "sum", "price_n", 2, 3), 2)


def facet_histogram(spark, sf):
    return ch.histogram(orders_n(spark, sf), "price_n", [LARGE], 6, facet="o_orderstatus").select("o_orderstatus", F.col("bin").cast("long").alias("bin"), "total_count", "count")


def scatter(spark, sf):
    return rounded(ch.scatter(orders_n(spark, sf), "mixed_txt", "price_n", "o_orderkey", [OPEN, LARGE]), 3)


def export(spark, sf):
    return rounded(ch.export_rows(ch.category_chart(orders_n(spark, sf), "o_orderpriority", [OPEN], "count"), "Orders by priority", "count", "status O"), 3)


def profile(spark, sf):
    return rounded(pf.dataset_profile(orders_n(spark, sf), ["o_orderkey", "price_n", "prio_n", "o_orderdate"]), 3)


def issues(spark, sf):
    o = orders_n(spark, sf).select("o_orderkey", F.col("o_custkey").alias("cust_id"), "prio_n", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("sparse"), "cust_txt")
    return pf.quality_issues(pf.dataset_profile(o))


def column(field):
    return lambda spark, sf: rounded(pf.column_profile(orders_n(spark, sf), field), 3)


def computed(spark, sf):
    o = orders_n(spark, sf).withColumn("ratio", F.col("price_n") / (F.col("o_custkey") + 1))
    return rounded(pf.column_profile(o, "ratio", 10, 10), 3)


def extent(spark, sf):
    return rounded(pf.extent(points(spark, sf), "x", "y").withColumn("crs", F.col("crs").cast("long")), 4)


HIST = N + ", b AS (SELECT min(price_n) AS lo, max(price_n) AS hi FROM o), r AS (SELECT least({n} - 1, CAST(floor((price_n - lo) / ((hi - lo) / {n})) AS INT)) AS bin, {facet} AS facet, {ctx} AS inside FROM o, b WHERE price_n IS NOT NULL) "
TOTALS = "count(*) AS total_count, round({t}, {p}) AS total_value, count(*) FILTER ({c}) AS count, round({v}, {p}) AS value"

QUERIES = {
    "ch1_category": (category, N + "SELECT prio_n AS label, count(*) AS total_count, round(coalesce(avg(price_n), 0), 3) AS total_value, count(*) FILTER (o_orderstatus = 'O') AS count, round(coalesce(avg(price_n) FILTER (o_orderstatus = 'O'), 0), 3) AS value FROM o WHERE prio_n IS NOT NULL GROUP BY 1 ORDER BY coalesce(avg(price_n), 0) DESC LIMIT 8"),
    "ch1_category_ids": (category_ids, N + "SELECT prio_n AS label, count(*) AS total_count, array_to_string(list_slice(list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR)), 1, 200), chr(31)) AS ids FROM o WHERE prio_n IS NOT NULL GROUP BY 1 ORDER BY total_count DESC, label LIMIT 3"),
    "pf3_geometry_issues": (bad_rings, f"WITH p AS ({POINTS}) SELECT 'ring' AS field, 'missing geometry' AS issue, 'info' AS severity, count(*) AS rows FROM p WHERE pt_id % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'ring', 'invalid geometry', 'warning', count(*) FROM p WHERE pt_id % 9 <> 0 AND v <= 0 HAVING count(*) > 0"),
    "ch2_histogram": (histogram, HIST.format(n=12, facet="1", ctx="o_orderstatus = 'O'") + "SELECT CAST(i AS BIGINT) AS bin, round(lo + i * ((hi - lo) / 12), 3) AS bin_start, (SELECT count(*) FROM r WHERE bin = i) AS total_count, (SELECT count(*) FROM r WHERE bin = i AND inside) AS count FROM b, range(12) t(i)"),
    "ch3_temporal": (temporal, N + ", t AS (SELECT coalesce(prio_n, 'Missing') AS s, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, s LIMIT 2), r AS (SELECT date_trunc('quarter', o_orderdate) AS bucket, CASE WHEN coalesce(prio_n, 'Missing') IN (SELECT s FROM t) THEN coalesce(prio_n, 'Missing') ELSE 'Other' END AS series, price_n, o_orderstatus = 'O' AS inside FROM o), c AS (SELECT CAST(bucket AS TIMESTAMP) AS bucket, series, count(*) AS total_count, round(sum(price_n), 2) AS total_value, count(*) FILTER (inside) AS count, round(sum(price_n) FILTER (inside), 2) AS value FROM r GROUP BY 1, 2), f AS (SELECT b AS bucket, series FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), INTERVAL 3 MONTH)) AS b), (SELECT DISTINCT series FROM c)) SELECT f.bucket, f.series, coalesce(total_count, 0) AS total_count, total_value, coalesce(count, 0) AS count, value FROM f LEFT JOIN c USING (bucket, series)"),
    "ch4_grain": (grain, "SELECT CASE WHEN s / 2629746.0 <= 60 THEN 'month' WHEN s / 7889238.0 <= 60 THEN 'quarter' ELSE 'year' END AS grain FROM (SELECT epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS s FROM orders)"),
    "ch4_buckets": (buckets, "SELECT CAST(b AS TIMESTAMP) AS bucket, CAST(b + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS TIMESTAMP) AS bucket_end FROM (SELECT unnest(generate_series(CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP), CAST(max(o_orderdate) AS TIMESTAMP), INTERVAL 1 MONTH)) AS b FROM orders)"),
    "ch5_facets": (facets, N + ", t AS (SELECT o_orderstatus AS facet, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, facet LIMIT 2), g AS (SELECT o_orderstatus AS facet, prio_n AS label, count(*) AS total_count, coalesce(sum(price_n), 0) AS total_value, count(*) FILTER (o_totalprice >= 100000) AS count, coalesce(sum(price_n) FILTER (o_totalprice >= 100000), 0) AS value FROM o WHERE prio_n IS NOT NULL AND o_orderstatus IN (SELECT facet FROM t) GROUP BY 1, 2) SELECT facet, label, total_count, round(total_value, 2) AS total_value, count, round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY total_value DESC, total_count DESC, label) AS k FROM g) WHERE k <= 3"),
    "ch5_facet_histogram_top": (
        lambda s, d: ch.histogram(orders_n(s, d), "price_n", [LARGE], 6, facet="prio_n", panels=3).select("prio_n", F.col("bin").cast("long").alias("bin"), "total_count", "count"),
        HIST.format(n=6, facet="prio_n", ctx="o_totalprice >= 100000") + ", f AS (SELECT prio_n AS facet FROM o WHERE prio_n IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT facet AS prio_n, CAST(i AS BIGINT) AS bin, (SELECT count(*) FROM r WHERE bin = i AND r.facet = f.facet) AS total_count, (SELECT count(*) FROM r WHERE bin = i AND r.facet = f.facet AND inside) AS count FROM f, range(6) t(i)",
    ),
    "ch5_facet_histogram": (facet_histogram, HIST.format(n=6, facet="o_orderstatus", ctx="o_totalprice >= 100000") + "SELECT facet AS o_orderstatus, CAST(i AS BIGINT) AS bin, (SELECT count(*) FROM r WHERE bin = i AND r.facet = f.facet) AS total_count, (SELECT count(*) FROM r WHERE bin = i AND r.facet = f.facet AND inside) AS count FROM (SELECT DISTINCT facet FROM r) f, range(6) t(i)"),
    "ch6_scatter": (scatter, N + "SELECT o_orderkey, TRY_CAST(mixed_txt AS DOUBLE) AS x, round(price_n, 3) AS y, o_orderstatus = 'O' AND o_totalprice >= 100000 AS in_context FROM o WHERE TRY_CAST(mixed_txt AS DOUBLE) IS NOT NULL AND price_n IS NOT NULL"),
    "snk6_chart_export": (export, N + "SELECT 'Orders by priority' AS chart_title, 'count' AS aggregation, 'status O' AS filters, o_orderpriority AS label, count(*) AS total_count, CAST(count(*) AS DOUBLE) AS total_value, count(*) FILTER (o_orderstatus = 'O') AS count, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS value FROM o GROUP BY o_orderpriority"),
    "pf2_profile": (profile, N + " ".join(
        (" UNION ALL " if i else "") + f"SELECT '{f}' AS field, '{k}' AS semantic_type, count(*) AS rows, count(*) - count({f}) AS nulls, round((count(*) - count({f})) / count(*), 3) AS null_share, count(DISTINCT {f}) AS distinct_count, round(min({v}), 3) AS min, round(max({v}), 3) AS max, round(avg({v}), 3) AS mean, round(stddev_samp({v}), 3) AS stddev, round(quantile_cont({v}, 0.25), 3) AS q25, round(quantile_cont({v}, 0.5), 3) AS q50, round(quantile_cont({v}, 0.75), 3) AS q75, min({t}) AS first_time, max({t}) AS last_time FROM o"
        for i, (f, k, v, t) in enumerate([("o_orderkey", "identifier", "CAST(o_orderkey AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"), ("price_n", "numeric", "price_n", "CAST(NULL AS TIMESTAMP)"), ("prio_n", "categorical", "CAST(NULL AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"), ("o_orderdate", "temporal", "CAST(NULL AS DOUBLE)", "o_orderdate")])
    )),
    "pf3_quality_issues": (issues, N + "SELECT 'cust_id' AS field, 'repeated identifier' AS issue, 'warning' AS severity FROM o HAVING count(DISTINCT o_custkey) < count(o_custkey) UNION ALL SELECT 'sparse', 'nulls', 'warning' FROM o HAVING count(*) FILTER (o_orderkey % 3 <> 0) >= 0.5 * count(*) UNION ALL SELECT 'cust_txt', 'many categories', 'info' FROM o HAVING count(DISTINCT cust_txt) > 50"),
    "pf4_column_profile_numbers": (column("mixed_txt"), N + ", v AS (SELECT TRY_CAST(mixed_txt AS DOUBLE) AS v FROM o), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT 'numeric' AS kind, CAST(bin AS VARCHAR) AS label, round(lo + bin * ((hi - lo) / 12), 3) AS low, round(lo + (bin + 1) * ((hi - lo) / 12), 3) AS high, count(*) AS count FROM (SELECT least(11, CAST(floor((v - lo) / ((hi - lo) / 12)) AS INT)) AS bin, lo, hi FROM v, b WHERE v IS NOT NULL) GROUP BY bin, lo, hi"),
    "pf4_column_profile_labels": (column("prio_n"), N + "SELECT 'categorical' AS kind, prio_n AS label, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, count(*) AS count FROM o WHERE prio_n IS NOT NULL GROUP BY prio_n ORDER BY count DESC, label LIMIT 12"),
    "pf5_computed_profile": (computed, N + ", v AS (SELECT price_n / (o_custkey + 1) AS v FROM o), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT 'numeric' AS kind, CAST(bin AS VARCHAR) AS label, round(lo + bin * ((hi - lo) / 10), 3) AS low, round(lo + (bin + 1) * ((hi - lo) / 10), 3) AS high, count(*) AS count FROM (SELECT least(9, CAST(floor((v - lo) / ((hi - lo) / 10)) AS INT)) AS bin, lo, hi FROM v, b WHERE v IS NOT NULL) GROUP BY bin, lo, hi"),
    "pf6_extent": (extent, f"SELECT round(min(x), 4) AS xmin, round(min(y), 4) AS ymin, round(max(x), 4) AS xmax, round(max(y), 4) AS ymax, CAST(4326 AS BIGINT) AS crs, 'high' AS confidence FROM ({POINTS})"),
}
