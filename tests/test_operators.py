import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.functions.casts import as_boolean, as_double, as_timestamp, half_up, semantic_type
from quarrylens.operators import charts, compare, events, filters, joins, profile, ranking, score, spatial, summarise, text
from quarrylens.plans.recipes import Blank, Pipeline, Step, recipe
from quarrylens.sources import io

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lenient_casts(spark):
    df = spark.createDataFrame([("1.5",), (" -2e3 ",), ("1.0d",), ("x",), (None,), ("2024",), ("2024-01-05",), ("yes",), ("F",)], "t string")
    rows = df.select(as_double(df, "t").alias("d"), as_timestamp(df, "t").alias("ts"), as_boolean(df, "t").alias("b")).collect()
    assert [r.d for r in rows] == [1.5, -2000.0, None, None, None, 2024.0, None, None, None]
    assert [r.ts for r in rows][5:7] == [None, dt.datetime(2024, 1, 5)]
    assert [r.b for r in rows][-2:] == [True, False]
    assert spark.range(1).select(half_up(F.lit(-0.5))).first()[0] == 0


def test_semantic_types(spark):
    df = spark.sql("SELECT 1 AS user_id, 1.5D AS price, 'a' AS name, true AS flag, date'2024-01-01' AS day, x'00' AS shape, array(1) AS list")
    assert [semantic_type(df, c) for c in df.columns] == ["identifier", "numeric", "categorical", "boolean", "temporal", "geometry", "unknown"]


def test_filters_that_do_nothing_and_null_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, t string")
    assert filters.filtered(df, [{"type": "category", "field": "t", "values": []}, {"type": "range", "field": "k"}, {"type": "text", "field": "t", "query": ""}]).count() == 3
    kept = filters.filtered(df, [{"type": "category", "field": "t", "values": ["a"], "mode": "exclude"}])
    assert [r.k for r in kept.orderBy("k").collect()] == [2, 3]
    with pytest.raises(ValueError):
        filters.predicate(df, {"type": "shape", "field": "t"})


def test_criteria_agree_with_funnel(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 20), (4, 30)], "k int, v int")
    conditions = [{"label": "big", "expression": "v > 10"}, {"label": "odd", "expression": "k % 2 = 1"}, {"label": "soft", "expression": "v < 25", "hard": False}]
    tagged = {r.k: (r.excluded, r.excluded_by, r.excluded_count) for r in filters.criteria(df, conditions).collect()}
    assert tagged == {1: (True, "big", 1), 2: (True, "big · odd · soft", 3), 3: (False, None, 0), 4: (True, "odd · soft", 2)}
    rows = filters.funnel(df, conditions).collect()
    assert rows[1].remaining == filters.criteria(df, conditions, "drop").count() == 1
    assert [r.removed_alone for r in rows] == [2, 2, 2] and rows[2].remaining is None
    with pytest.raises(ValueError):
        filters.criteria(df, [conditions[0], conditions[0]])
    with pytest.raises(ValueError):
        filters.criteria(df, [])


def test_top_n_keeps_ties_and_nulls_come_last(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None)], "k int, v int")
    assert sorted(r.k for r in filters.top_n(df, "v", 1).collect()) == [1, 2]
    assert sorted(r.k for r in filters.top_n(df, "v", 1, descending=False).collect()) == [3]
    assert filters.top_n(df, "v", 9).count() >= 3


def test_ranks_without_a_single_task(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    for df in (ranking.rank(li, "l_quantity", "r"), ranking.running_sum(li, F.col("l_quantity"), "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "s"), score.allocate(li, "l_extendedprice", 1e6, "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])):
        assert "Window" in plan(df)
        for line in plan(df).split("\n"):
            assert not ("Exchange SinglePartition" in line and "FileScan" in line)
        import re

        assert not re.search(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan(df))


def test_range_partitioned_buckets_give_the_same(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("q", F.when(F.col("l_quantity") < 40, F.col("l_quantity")))
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    for make in (lambda n: ranking.running_sum(li, F.lit(1), "q", ids, "s", rows_per_bucket=n), lambda n: ranking.rank(li, "q", "s", rows_per_bucket=n), lambda n: ranking.running_sum(li, F.lit(1), "q", ids, "s", partition=["l_returnflag"], rows_per_bucket=n)):
        assert sorted(make(None).select(*ids, "s").collect()) == sorted(make(20).select(*ids, "s").collect())


def test_range_partitions_follow_texts_with_a_common_prefix(spark):
    rows = [(i, f"Customer#{i * 7919 % 2000 // 2:06d}") for i in range(2000)]  # each text twice, far apart by id
    df = spark.createDataFrame(rows, "k int, t string")
    for down in (False, True):
        want = [k for k, _ in sorted(sorted(rows), key=lambda r: r[1], reverse=down)]
        got = ranking.running_sum(df, F.lit(1), "t", ["k"], "s", down, rows_per_bucket=20).collect()
        assert [r.k for r in sorted(got, key=lambda r: r.s)] == want and sorted(r.s for r in got) == list(range(1, 2001))
        ranks = {r.k: r.r for r in ranking.rank(df, "t", "r", down, rows_per_bucket=10).collect()}
        assert [ranks[k] for k in want] == [1 + i // 2 * 2 for i in range(2000)]


def test_text_and_date_ranks(spark):
    df = spark.createDataFrame([("b", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 1)), (None, None), ("b", dt.date(2024, 1, 3))], "t string, d date")
    assert sorted((r.t or "", r.r) for r in ranking.rank(df, "t", "r", descending=False).collect()) == [("", 4), ("a", 1), ("b", 2), ("b", 2)]
    assert sorted(r.r for r in ranking.rank(df, "d", "r").collect()) == [1, 2, 3, 4]


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.0, 7.0), (2, None, 7.0), (3, 10.0, 7.0)], "k int, a double, c double")
    criteria = [{"field": "a", "weight": 3}, {"field": "c", "weight": 0}]
    out = {r.k: r for r in score.score(df, criteria, missing="exclude", contributions=True, ranked=True).collect()}
    assert [out[k].score for k in (1, 2, 3)] == [0.0, None, 1.0] and [out[k].score_rank for k in (1, 2, 3)] == [2, 3, 1]
    assert all(r.score is None or abs(r.score - r.score_c_a) < 1e-12 for r in out.values())
    assert {r.score for r in score.score(df, [{"field": "c", "weight": 1}]).collect()} == {None}
    assert score.score(df, []).where("score IS NOT NULL").count() == 0
    assert [r.score for r in score.score(df, [{"field": "a", "weight": 1}], missing="mean").orderBy("k").collect()] == [0.0, 0.5, 1.0]


def test_allocation(spark):
    df = spark.createDataFrame([(1, "x", 60.0, 9), (2, "x", 60.0, 9), (3, "x", None, 1), (4, "y", 10.0, 5)], "k int, p string, amount double, o int")
    out = {r.k: r for r in score.allocate(df, "amount", 100, "o", ["k"], "scale", partition=["p"]).collect()}
    assert [out[k].amount_status for k in (1, 2, 3, 4)] == ["within", "over", "over", "within"]
    assert [out[k].allocated_amount for k in (1, 2, 3, 4)] == [60.0, 40.0, 0.0, 10.0]
    assert sorted(r.k for r in score.allocate(df, "amount", 100, "o", ["k"], "cut", partition=["p"]).collect()) == [1, 4]


def test_summary_errors(spark):
    df = spark.range(3)
    for bad in ([], [{"fn": "sum"}], [{"fn": "count"}, {"fn": "count"}]):
        with pytest.raises(ValueError):
            summarise.summarise(df, [], bad)
    assert summarise.kpi(df, "count", None, [], "previous-period").first().note == "needs a bounded time filter"
    zero = spark.createDataFrame([(0.0,)], "v double")
    row = summarise.kpi(zero, "sum", "v", [], "total").first()
    assert row.delta is None and row.note == "baseline is zero"


def test_alignment_drops_null_keys(spark):
    a = spark.createDataFrame([("k", 1.0), (None, 5.0)], "key string, v double")
    b = spark.createDataFrame([("k", 4.0), ("m", 1.0)], "key string, v double")
    out = {r.key: r for r in joins.align([a, b], "key", "v").collect()}
    assert set(out) == {"k", "m"} and out["k"].delta == 3.0 and out["m"].delta is None


def test_charts_edges(spark):
    point = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    rows = charts.histogram(point, "v", []).collect()
    assert [(r.bin, r.bin_end - r.bin_start, r.total_count) for r in rows] == [(0, 1.0, 2)]
    assert charts.choose_grain(None, None) == "day"
    t = spark.createDataFrame([(dt.datetime(2025, 1, 3),), (dt.datetime(2025, 3, 1),)], "t timestamp_ntz")
    assert [(r.bucket.month, r.total_count) for r in charts.temporal_chart(t, "t", [], grain="month").orderBy("bucket").collect()] == [(1, 1), (2, 0), (3, 1)]
    s = spark.range(100)
    assert {r.id for r in charts.sample(s, "id", 10, 7).collect()} == {r.id for r in charts.sample(s.repartition(7), "id", 10, 7).collect()}


def test_breaks_and_classes(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (30.0,), (None,)], "v double")
    assert compare.equal_breaks(df, "v", 4) == [7.5, 15.0, 22.5]
    assert compare.quantile_breaks(df, "v", 2) == [10.0]
    got = [r.c for r in df.select("v", compare.class_of(F.col("v"), [7.5, 15]).alias("c")).collect()]
    assert got == [0, 1, 2, 2, None]
    assert compare.equal_breaks(df.where("v = 10"), "v", 4) == [10.0] and compare.equal_breaks(df.where("v IS NULL"), "v", 4) == []


def test_profile_of_mixed_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "t string")
    assert {r.kind for r in profile.column_profile(df, "t").collect()} == {"categorical"}
    assert profile.row_id(spark.createDataFrame([(1,), (1,)], "user_id int"))[2] == "materialised"


def test_rings(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shape])
    pts = [(1.0, 1.0, True, False), (3.0, 3.0, False, False), (4.0, 1.0, None, True), (0.0, 0.0, None, True), (1.0, 3.0, True, False), (5.0, 1.0, False, False)]
    df = spark.createDataFrame(pts, "x double, y double, inside boolean, edge boolean").withColumn("ring", ring)
    for r in df.select("inside", "edge", spatial.in_ring(F.col("ring"), F.col("x"), F.col("y")).alias("i"), spatial.on_ring(F.col("ring"), F.col("x"), F.col("y")).alias("e")).collect():
        assert r.e == r.edge and (r.inside is None or r.i == r.inside)
    m = spatial.ring_metrics(df.limit(1).withColumn("id", F.lit(1)), "ring", "id").first()
    assert (m.area, m.perimeter, m.vertices) == (12.0, 16.0, 6)


def test_dissolved_outline(spark):
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (1, 1.0, 2.0, 0.0, 1.0), (1, 5.0, 6.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 1.0)], "g int, xmin double, xmax double, ymin double, ymax double")
    edges = spatial.dissolve(boxes.withColumn("ring", spatial.box_ring()), "ring", "g")
    rings = sorted((r.g, r.vertices) for r in spatial.stitch_rings(edges, "g").collect())
    assert rings == [(1, 4), (1, 6), (2, 4)]


def test_spatial_joins_have_no_nested_loop(spark):
    from quarrylens.queries.inputs import areas, points

    df = spatial.points_in_boxes(points(spark, SF), areas(spark, SF), 30.0, how="inner")
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_events_gap_is_inclusive(spark):
    base = dt.datetime(2024, 1, 1)
    ms = lambda n: base + dt.timedelta(milliseconds=n)
    df = spark.createDataFrame([(1, 1, "a", ms(0)), (2, 1, "a", ms(700)), (3, 1, "a", ms(1401)), (4, 1, "b", ms(1500)), (5, 1, "a", ms(1600))], "id int, u int, k string, ts timestamp_ntz")
    assert sorted(r.id for r in events.coalesce_events(df, "u", "k", "ts", "id", 0.7).collect()) == [2, 3, 4, 5]


def test_events_across_spans_equal_one_window(spark):
    import random

    rng, base = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, i % 3 if i % 9 else None, rng.choice("ab"), None if i % 17 == 0 else base + dt.timedelta(seconds=rng.randrange(400))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, u int, k string, ts timestamp_ntz")
    kept = []
    for u in (0, 1, 2, None):
        log = sorted((r for r in rows if r[1] == u and r[3]), key=lambda r: (r[3], r[0]))
        kept += [r[0] for r in rows if r[1] == u and not r[3]]
        kept += [r[0] for r, n in zip(log, [*log[1:], None], strict=True) if not (n and n[2] == r[2] and (n[3] - r[3]).total_seconds() <= 5)]
    for span in (1, 7, 1000):
        out = events.coalesce_events(df, "u", "k", "ts", "id", 5, span)
        assert out.columns == df.columns and sorted(r.id for r in out.collect()) == sorted(kept)
    assert events.coalesce_events(df.limit(0), "u", "k", "ts", "id", 5).count() == 0


def test_event_stream(spark, tmp_path):
    from quarrylens.streaming.coalesce import coalesce_stream

    spark.sql("SELECT * FROM VALUES (1L, 1L, 'a', timestamp_ntz'2024-01-01 00:00:00'), (2L, 1L, 'a', timestamp_ntz'2024-01-01 00:00:05'), (3L, 1L, 'a', timestamp_ntz'2024-01-01 01:00:00'), (4L, 2L, 'z', timestamp_ntz'2024-01-02 00:00:00') AS t(event_id, user_id, event_type, ts)").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    out = coalesce_stream(source, "user_id", "event_type", "ts", 10, "1 minute")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    assert sorted((r.event_id, r.run_length) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(2, 2), (3, 1)]


def test_recipes_and_pipelines(spark):
    make = recipe({"least": Blank("number", 1), "f": Blank("field", "id")}, lambda df, least, f: df.where(F.col(f) >= least))
    assert spark.range(5).transform(make(least=3)).count() == 2
    for bad in ({"least": "1"}, {"least": float("nan")}, {"f": "a; DROP"}, {"x": 1}):
        with pytest.raises(ValueError):
            make(**bad)
    steps = {"a": Step(lambda d: d.where("id > 1"), ("src",)), "b": Step(lambda x, y: x.join(y, "id"), ("a", "src"))}
    assert Pipeline(steps, {"src": spark.range(4)}).result().count() == 2
    with pytest.raises(KeyError, match="not loaded"):
        Pipeline(steps, {}).result()
    with pytest.raises(ValueError):
        Pipeline({"a": Step(lambda d: d, ("a",))}, {}).result()


def test_sources(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert io.json_rows(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "bad.json").write_text("7")
    with pytest.raises(ValueError):
        io.json_rows(spark, str(tmp_path / "bad.json"))
    (tmp_path / "f.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 1}}, {"type": "Feature", "geometry": null, "properties": {"n": 2}}, {"type": "Feature", "geometry": {"type": "Blob"}, "properties": {"n": 3}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"n": 4}}]}')
    rows = {r.n: r for r in io.geojson(spark, str(tmp_path / "f.geojson")).collect()}
    assert rows[4].rings == [rows[4].ring] and len(rows[4].ring) == 4 and rows[1].rings is None and not rows[4].bad_geometry
    assert rows[1]["__geojson_id"] == "p" and (rows[1].x, rows[1].y) == (1.0, 2.0)
    assert not rows[2].bad_geometry and rows[3].bad_geometry and len(rows[4].ring) == 4
    (tmp_path / "t.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        io.delimited(spark, str(tmp_path / "t.csv"))
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        io.read_area(spark, str(tmp_path / "p"), limit=1)


def test_claims_find_every_best_pair(spark):
    a = spark.createDataFrame([(1, "red fox jumps over lazy dogs"), (2, "nothing alike here"), (3, None), (4, "red fox jumps")], "id int, text string")
    b = spark.createDataFrame([(7, "Red fox jumps, lazy dogs!"), (8, "red fox"), (9, "")], "id int, text string")
    got = {(r.left_id, r.right_id, round(r.similarity, 3), r.mutual) for r in text.match_claims(a, b, "id", "id").collect()}
    assert got == {(1, 7, 0.833, True), (4, 8, 0.667, True)}


def test_time_buckets_are_never_cut(spark):
    df = spark.range(3000).select(F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("t"))
    assert charts.temporal_chart(df, "t", [], grain="hour").agg(F.sum("total_count")).first()[0] == 3000
    for grain, n in (("hour", 3000), ("day", 125), ("week", 19), ("month", 5), ("quarter", 2), ("year", 1)):
        found = charts.time_buckets(df, "t", grain).orderBy("bucket").collect()
        assert len(found) == n and all(a.bucket_end < b.bucket for a, b in zip(found, found[1:], strict=False))


def test_text_ranks_beyond_the_basic_plane(spark):
    import random

    rng = random.Random(3)
    letters = "ab\uffff\U00010000\U0001f600\U0010ffff"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(5))) for _ in range(1500)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    order = sorted((t for t in texts if t is not None), key=lambda t: t.encode())
    first = {t: order.index(t) + 1 for t in set(order)} | {None: len(order) + 1}
    for per in (None, 40):
        got = {r.k: r.r for r in ranking.rank(df, "t", "r", descending=False, rows_per_bucket=per).collect()}
        assert all(got[i] == first[t] for i, t in enumerate(texts))
        cum = ranking.running_sum(df, F.lit(1), "t", ["k"], "n", descending=False, rows_per_bucket=per).orderBy("n").collect()
        assert [r.t for r in cum] == [*order, None] and [r.n for r in cum] == list(range(1, len(texts) + 1))


def test_order_statistics_against_numpy(spark):
    import numpy as np

    from quarrylens.operators.orderstat import order_statistics

    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else int(i % 3), None if i % 11 == 0 else float(rng.integers(0, 40)) if i % 3 else 5.0) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v double")
    points, names = (0.0, 0.1, 0.5, 0.77, 1.0), ["a", "b", "c", "d", "e"]
    by = {r.g: [r[n] for n in names] for r in order_statistics(df, ["g"], F.col("v"), points, names).collect()}
    for g in (None, 0, 1, 2):
        assert np.allclose(by[g], np.quantile([v for k, v in rows if k == g and v is not None], points))
    disc = order_statistics(df, [], F.col("v"), points, names, discrete=True).first()
    assert np.allclose(list(disc), np.quantile([v for _, v in rows if v is not None], points, method="inverted_cdf"))
    plain = plan(summarise.summarise(df, ["g"], [{"fn": "median", "field": "v"}, {"fn": "count_distinct", "field": "v"}, {"fn": "count_distinct", "field": "g"}]))
    assert "percentile(" not in plain and "median(" not in plain and "Expand" not in plain
    assert order_statistics(df.limit(0), [], F.col("v"), points, names).first()[0] is None


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000).repartition(7)
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())[:300]
    assert sorted(r.id for r in charts.sample(df, "id", 300, 7).collect()) == sorted(want)


def test_sweep_reports_what_fails_while_running(spark):
    from quarrylens.plans.recipes import sweep

    out, failed = sweep({"good": {"x": 1}, "bad": {"x": 0}, "worse": {"y": 1}}, lambda x: spark.range(3).select(F.expr(f"assert_true({x} = 1 OR id < 0)").alias("ok")))
    assert set(failed) == {"bad", "worse"} and out.count() == 3


def test_column_subset_and_rows_by_number(spark):
    from quarrylens.functions.casts import column_subset

    df = spark.createDataFrame([(i, (i * 7) % 10, None) for i in range(10)], "id int, v int, geometry string")
    assert column_subset(df, ["v"]).columns == ["v", "geometry"]
    for wrong in ([], ["nothing"]):
        with pytest.raises(ValueError, match="column"):
            column_subset(df, wrong)
    numbers = spark.createDataFrame([(1,), (3,), (99,), (None,)], "n int")
    assert sorted(r.v for r in filters.select_rows(df, numbers, "v", ["id"]).collect()) == [0, 2]
    assert [r.v for r in filters.ordered(df, "v", "id", descending=True, most=2).collect()] == [9, 8]


def test_drafts_are_in_no_conflict(spark):
    left = spark.createDataFrame([(1, "draft"), (2, "yes"), (3, "yes"), (4, "yes"), (5, None)], "a int, s string")
    right = spark.createDataFrame([(11, "no"), (12, "no"), (13, "yes"), (14, "draft"), (15, "no"), (16, "no")], "b int, s string")
    pairs = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, 14), (5, 15)], "left_id int, right_id int")
    got = {(r.left_id, r.right_id): r.status for r in text.claim_status(left, right, pairs, "a", "b", "s").collect()}
    assert got == {(1, 11): "agreement", (2, 12): "conflict", (3, 13): "agreement", (4, 14): "agreement", (5, 15): "agreement", (None, 16): "only-right"}


def test_claims_against_all_pairs(spark):
    import random

    rng = random.Random(9)
    words = "river stone cloud amber field winter the and of not copper lantern".split()
    make = lambda n, at: [(at + i, " ".join(rng.choices(words, k=rng.randrange(7)))) for i in range(n)]
    a, b = make(60, 0) + [(900, "river stone"), (901, "stone, RIVER!")], make(80, 1000) + [(1900, "stone river"), (1901, "river stone")]
    cut = lambda t: {w for w in re.findall("[a-z]+", t.lower()) if len(w) > 2 and w not in text.STOP_WORDS}
    sim = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    got = {r.left_id: r for r in text.match_claims(spark.createDataFrame(a, "i int, text string"), spark.createDataFrame(b, "j int, text string"), "i", "j").collect()}
    for i, t in a:
        best = max(((sim(cut(t), cut(u)), -j) for j, u in b), default=(0, 0))
        if best[0] < 0.4:
            assert i not in got
            continue
        assert got[i].right_id == -best[1] and abs(got[i].similarity - best[0]) < 1e-9
        back = max((sim(cut(x), cut(dict(b)[-best[1]])), -k) for k, x in a)
        assert got[i].mutual == (-back[1] == i)


def test_geojson_areas_there_and_back(spark, tmp_path):
    """Holes, several parts, open and closed rings, no geometry, and areas that are none."""
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    square, hole, far = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 1)), ring((9, 9), (10, 9), (10, 10))
    rows = [(1, 'quote " and \n', [[square, hole]]), (2, None, [[square], [far]]), (3, "none", None), (4, "empty", [])]
    df = spark.createDataFrame(rows, "id long, name string, parts array<array<array<struct<x:double,y:double>>>>")
    io.geojson_areas(df, "parts").write.text(path := str(tmp_path / "areas.geojsonl"))
    got = {r.id: r for r in io.geojson(spark, path).collect()}
    closed = lambda r: [(p["x"], p["y"]) for p in r] + ([] if r[0] == r[-1] else [(r[0]["x"], r[0]["y"])])
    points = lambda rings: [[tuple(p) for p in r] for r in rings]
    assert got[1].geometry_type == "Polygon" and points(got[1].rings) == [closed(square), closed(hole)] and points([got[1].ring]) == [closed(square)]
    assert got[2].geometry_type == "MultiPolygon" and points(got[2].rings) == [closed(square), closed(far)] and got[2].ring is None
    assert [(got[i].rings, got[i].geometry_type, got[i].bad_geometry) for i in (3, 4)] == [(None, None, False)] * 2
    assert {i: r.name for i, r in got.items()} == {i: n for i, n, _ in rows}
    bad = ['{"type":"Feature","geometry":{"type":"Polygon","coordinates":%s},"properties":{"id":%d}}' % (c, i) for i, c in enumerate(("[]", "[[[0,0],[1,1]]]", "7", "[[[0,0],[1,0],[null,1]]]"))]
    (tmp_path / "bad.geojsonl").write_text("\n".join(bad))
    assert [(r.bad_geometry, r.rings, r.ring, r.geometry_type) for r in io.geojson(spark, str(tmp_path / "bad.geojsonl")).collect()] == [(True, None, None, None)] * 4


def test_described_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`a b` long, c string")
    got = io.described({"t": df, "__own": df, "none": spark.range(0)}).collect()
    assert sorted(map(tuple, got)) == [("none", "id", "bigint", 0, 0), ("t", "a b", "bigint", 2, 0), ("t", "c", "string", 2, 1)]
    with pytest.raises(ValueError):
        io.described({"__own": df})


def test_row_id_is_proven(spark):
    df = spark.range(3000).select((F.col("id") % 2990).alias("nearly_id"), F.when(F.col("id") > 0, F.col("id")).alias("null_id"), F.col("id").alias("own"))
    assert profile.row_id(df)[1:] == ("own", "validated-unique")
    made, name, quality = profile.row_id(df.select("nearly_id"))
    assert (name, quality) == ("__row_id", "materialised") and made.agg(F.count_distinct(name)).first()[0] == 3000
    assert profile.row_id(df.limit(0))[2] == "materialised"
