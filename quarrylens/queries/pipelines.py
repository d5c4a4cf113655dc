"""Pipelines, recipes, sweeps, computed fields, scalar functions, events and text matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import events as ev
from quarrylens.operators import filters as fl
from quarrylens.operators import summarise as sm
from quarrylens.operators import text as tx
from quarrylens.operators.joins import attribute_join
from quarrylens.plans import recipes as rc
from quarrylens.queries.inputs import ORDERS_N, orders_n, rounded, table
from quarrylens.queries.tables import folder
from quarrylens.streaming import coalesce as st

N = f"WITH o AS ({ORDERS_N}) "


def _pipeline(spark, sf):
    steps = {
        "joined": rc.Step(lambda o, c: attribute_join(o, c, "o_custkey", "c_custkey", "inner"), ("orders", "customer")),
        "large": rc.Step(lambda df: fl.filtered(df, [{"type": "range", "field": "price_n", "min": 100000}]), ("joined",)),
        "summary": rc.Step(lambda df: sm.summarise(df, ["r_c_mktsegment"], [{"fn": "count"}, {"fn": "sum", "field": "price_n"}]), ("large",)),
    }
    return rc.Pipeline(steps, {"orders": orders_n(spark, sf), "customer": table(spark, sf, "customer")})


def whole(spark, sf):
    return rounded(_pipeline(spark, sf).result(), 2)


def upto(spark, sf):
    return _pipeline(spark, sf).result("large").select("o_orderkey", "r_c_mktsegment")


LARGE = rc.recipe(
    {"least": rc.Blank("number", 0), "field": rc.Blank("field", "price_n"), "status": rc.Blank("choice", "O", ("O", "F", "P"))},
    lambda df, least, field, status: df.where((F.col(field) >= F.lit(least)) & (F.col("o_orderstatus") == F.lit(status))),
)


def recipe(spark, sf):
    return orders_n(spark, sf).transform(LARGE(least=150000, status="F")).select("o_orderkey")


def sweep(spark, sf):
    o = orders_n(spark, sf)
    build = lambda least, field="price_n": LARGE(least=least, field=field)(o).agg(F.count("*").alias("n"))
    out, failed = rc.sweep({"low": {"least": 1000}, "high": {"least": 200000}, "bad": {"least": 1, "field": "no field"}}, build)
    assert list(failed) == ["bad"]
    return out


def compared_variants(spark, sf):
    o = orders_n(spark, sf)
    out, _ = rc.sweep({n: {"least": x} for n, x in (("a", 50000), ("b", 100000), ("c", 150000))}, lambda least: LARGE(least=least)(o).select("price_n"))
    return rounded(out.groupBy("variant_id").agg(F.count("*").alias("rows"), F.avg("price_n").alias("mean")), 3)


def scenario(spark, sf):
    return rc.set_value(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 0, F.col("p_size") > 25)


def attribute(spark, sf):
    return rounded(rc.attribute(table(spark, sf, "part"), "p_retailprice * 2").select("p_partkey", "new_value"), 4)


def computed(spark, sf):
    fields = [("gross", "l_extendedprice * (1 - l_discount)"), ("net", "gross * (1 + l_tax)"), ("band", "CASE WHEN net > 50000 THEN 'high' ELSE 'low' END")]
    return rounded(rc.computed(table(spark, sf, "lineitem"), fields).groupBy("band").agg(F.count("*").alias("n"), F.sum("net").alias("net")), 1)


def scalars(spark, sf):
    o = orders_n(spark, sf)
    return rounded(
        o.select(
            "o_orderkey", F.try_divide(F.col("price_n"), (F.col("o_custkey") % 5).cast("double")).alias("divided"), F.expr("try_mod(CAST(o_custkey AS DOUBLE), CAST(nullif(o_orderkey % 3, 0) AS DOUBLE))").alias("modulo"),
            F.least("price_n", F.lit(100000.0)).alias("low"), F.greatest("price_n", F.lit(100000.0)).alias("high"), F.concat_ws("", F.col("prio_n"), F.lit("/"), F.col("o_orderstatus")).alias("joined"),
            F.sqrt(F.abs(F.coalesce("price_n", F.lit(0.0)))).alias("root"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("floored"), F.pow((F.col("o_custkey") % 10).cast("double"), 2.0).alias("squared"), F.upper("prio_n").alias("upper"), F.nullif("o_orderstatus", F.lit("O")).alias("not_open"),
        ),
        4,
    )


def coalesced(spark, sf):
    return ev.coalesce_events(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", 3600).select("event_id")


def touching(spark, sf):
    e = table(spark, sf, "events").withColumn("used", F.array(F.concat(F.lit("e"), F.col("event_id") % 50)))
    return ev.touching(e, "e7", "event_type", "used").select("event_id")


def stream(spark, sf):
    """Tumbling windows over the events as a stream, run to the end of the input; windows close with the watermark."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    path = folder(spark)
    counts = st.windowed_counts(events, "ts", ["event_type"], "1 day")
    query = counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.parquet(path).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def claims(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select((F.col("doc_id") * 100000 + F.col("pos")).alias("line_id"), "text")
    return rounded(tx.match_claims(table(spark, sf, "benchmark"), lines, "item_id", "line_id").select(F.col("left_id").alias("item_id"), F.col("right_id").alias("line_id"), "similarity"), 6)


def claim_statuses(spark, sf):
    """Claims of the benchmark against lines of the documents; the verdict is the length of a text, or a draft."""
    verdict = lambda key: F.when(F.col(key) % 3 == 0, "draft").when(F.length("text") % 2 == 0, "even").otherwise("odd").alias("verdict")
    left = table(spark, sf, "benchmark").select("item_id", "text", verdict("item_id"))
    right = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select((F.col("doc_id") * 100000 + F.col("pos")).alias("line_id"), "text")
    right = right.select("line_id", "text", verdict("line_id"))
    matches = tx.match_claims(left, right, "item_id", "line_id")
    return tx.claim_status(left, right, matches, "item_id", "line_id", "verdict").groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("left_id").alias("claims"))


def coalesced_stream(spark, sf):
    """The stream form, run to the end of the input; runs close with the watermark."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select("user_id", "event_type", "ts", "event_id")
    path = folder(spark)
    runs = st.coalesce_stream(events, "user_id", "event_type", "ts", 3600)
    query = runs.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.parquet(path).select("user_id", "event_type", F.col("ts").alias("last_ts"), "run_length")


def coalesced_state(spark, sf):
    """The stream that keeps its own state, run to the end of the input: what the watermark has settled by then."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select("event_id", "user_id", "event_type", "ts")
    path = folder(spark)
    settled = st.coalesce_stateful(events, "user_id", "event_type", "ts", "event_id", 3600)
    query = settled.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(settled.schema).parquet(path).select("event_id")


SWEPT = {f"v{i:02d}": {"least": i * 20_000, "status": "OFP"[i % 3]} for i in range(20)}


def swept(spark, sf):
    o = orders_n(spark, sf)
    condition = lambda least, status, field="price_n": (F.col(field) >= least) & (F.col("o_orderstatus") == status)
    out, failed = rc.sweep_measures(o, SWEPT | {"bad": {"least": 1, "status": "O", "field": "no field"}}, condition, [{"fn": "count", "alias": "n"}, {"fn": "sum", "field": "price_n", "alias": "total"}, {"fn": "count_distinct", "field": "o_custkey", "alias": "customers"}])
    assert list(failed) == ["bad"]
    return rounded(out, 2)


TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], w)))"

QUERIES = {
    "pl1_pipeline": (whole, N + "SELECT c_mktsegment AS r_c_mktsegment, count(*) AS row_count, round(sum(price_n), 2) AS sum_price_n FROM o JOIN customer ON o_custkey = c_custkey WHERE price_n >= 100000 GROUP BY 1"),
    "pl2_run_upto": (upto, N + "SELECT o_orderkey, c_mktsegment AS r_c_mktsegment FROM o JOIN customer ON o_custkey = c_custkey WHERE price_n >= 100000"),
    "pl3_recipe": (recipe, N + "SELECT o_orderkey FROM o WHERE price_n >= 150000 AND o_orderstatus = 'F'"),
    "pl4_sweep": (sweep, N + "SELECT 'low' AS variant_id, count(*) AS n FROM o WHERE price_n >= 1000 AND o_orderstatus = 'O' UNION ALL SELECT 'high', count(*) FROM o WHERE price_n >= 200000 AND o_orderstatus = 'O'"),
    "pl4_sweep_one_scan": (swept, N + " UNION ALL ".join(f"SELECT '{n}' AS variant_id, count(*) AS n, round(sum(price_n), 2) AS total, count(DISTINCT o_custkey) AS customers FROM o WHERE price_n >= {v['least']} AND o_orderstatus = '{v['status']}'" for n, v in SWEPT.items())),
    "cp7_variants": (compared_variants, N + " UNION ALL ".join(f"SELECT '{n}' AS variant_id, count(*) AS rows, round(avg(price_n), 3) AS mean FROM o WHERE price_n >= {x} AND o_orderstatus = 'O'" for n, x in (("a", 50000), ("b", 100000), ("c", 150000)))),
    "pl7_scenario_value": (scenario, "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS p_size FROM part"),
    "prj1_attribute": (attribute, "SELECT p_partkey, round(p_retailprice * 2, 4) AS new_value FROM part"),
    "prj2_computed_chain": (computed, "WITH n AS (SELECT l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net FROM lineitem) SELECT CASE WHEN net > 50000 THEN 'high' ELSE 'low' END AS band, count(*) AS n, round(sum(net), 1) AS net FROM n GROUP BY 1"),
    "fn_scalars": (scalars, N + "SELECT o_orderkey, round(price_n / nullif(o_custkey % 5, 0), 4) AS divided, CAST(o_custkey AS DOUBLE) % CAST(nullif(o_orderkey % 3, 0) AS DOUBLE) AS modulo, round(least(price_n, 100000), 4) AS low, round(greatest(price_n, 100000), 4) AS high, concat(prio_n, '/', o_orderstatus) AS joined, round(sqrt(abs(coalesce(price_n, 0))), 4) AS root, floor(o_totalprice / 1000) AS floored, pow(CAST(o_custkey % 10 AS DOUBLE), 2) AS squared, upper(prio_n) AS upper, nullif(o_orderstatus, 'O') AS not_open FROM o"),
    "ev1_coalesce": (coalesced, "SELECT event_id FROM (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE NOT coalesce(nk = event_type AND nt - ts <= INTERVAL 1 HOUR, FALSE)"),
    "ev2_touching": (touching, "SELECT event_id FROM events WHERE event_id % 50 = 7"),
    "ev3_stream_windows": (stream, "SELECT window_start, event_type, n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"),
    "ev1_coalesce_stream": (coalesced_stream, "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g), e AS (SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS run_length FROM r GROUP BY user_id, event_type, run) SELECT * FROM e WHERE last_ts + INTERVAL 1 HOUR + INTERVAL 1 MICROSECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"),
    "ev1_coalesce_state": (coalesced_state, "WITH n AS (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events) SELECT event_id FROM n, m WHERE NOT coalesce(nk = event_type AND nt - ts <= INTERVAL 1 HOUR, FALSE) AND (coalesce(nt < mark, FALSE) OR ts + INTERVAL 1 HOUR < mark)"),
    "tx1_claims": (claims, f"WITH l AS (SELECT item_id, {TOKENS.format(t='text')} AS a FROM benchmark), s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), r AS (SELECT doc_id * 100000 + i AS line_id, {TOKENS.format(t='parts[i + 1]')} AS b FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM s)), p AS (SELECT item_id, line_id, len(list_intersect(a, b)) AS k, len(a) AS na, len(b) AS nb FROM l, r WHERE len(a) > 0 AND len(b) > 0), q AS (SELECT *, k / (na + nb - k) AS similarity FROM p WHERE k / (na + nb - k) >= 0.4), t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, line_id) AS n FROM q) SELECT item_id, line_id, round(similarity, 6) AS similarity FROM t WHERE n = 1"),
    "tx1_claim_status": (claim_statuses, f"WITH l AS (SELECT item_id, text AS lt, {TOKENS.format(t='text')} AS a FROM benchmark), s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), r AS (SELECT doc_id * 100000 + i AS line_id, parts[i + 1] AS rt, {TOKENS.format(t='parts[i + 1]')} AS b FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM s)), p AS (SELECT item_id, line_id, len(list_intersect(a, b)) AS k, len(a) AS na, len(b) AS nb FROM l, r WHERE len(a) > 0 AND len(b) > 0), q AS (SELECT *, k / (na + nb - k) AS similarity FROM p WHERE k / (na + nb - k) >= 0.4), t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, line_id) AS n FROM q), m AS (SELECT item_id, line_id FROM t WHERE n = 1), lv AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'draft' WHEN length(lt) % 2 = 0 THEN 'even' ELSE 'odd' END AS va FROM l), rv AS (SELECT line_id, CASE WHEN line_id % 3 = 0 THEN 'draft' WHEN length(rt) % 2 = 0 THEN 'even' ELSE 'odd' END AS vb FROM r), j AS (SELECT lv.item_id, rv.line_id, CASE WHEN lv.item_id IS NULL THEN 'only-right' WHEN rv.line_id IS NULL THEN 'only-left' WHEN va <> vb AND va <> 'draft' AND vb <> 'draft' THEN 'conflict' ELSE 'agreement' END AS status FROM (lv LEFT JOIN m USING (item_id)) FULL JOIN rv USING (line_id)) SELECT status, count(*) AS n, count(DISTINCT item_id) AS claims FROM j GROUP BY 1"),
}
