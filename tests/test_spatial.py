"""Spatial joins and outlines against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import cells, outline, spatial

POINT = "pt_id long, x double, y double"
BOX = "area_id long, xmin double, ymin double, xmax double, ymax double"


def dense(n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, 5.5, 5.25))  # a third in one place
        elif i % 10:
            out.append((i, 5 + rng.random(), 5 + rng.random()))
        else:
            out.append((i, rng.uniform(-100, 100), rng.uniform(-100, 100)))
    return [*out, (n, None, 1.0), (n + 1, 1.0, None), (n + 2, -0.0, 0.0)]


def boxes_at_random(n, seed, wide=6.0, whole=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0, wide), rng.uniform(0, wide)
        if whole:
            x, y, w, h = (float(math.floor(v)) for v in (x, y, w + 1, h + 1))
        out.append((i, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("kind", ["intersects", "within"])
def test_points_in_boxes_with_split_cells(spark, kind):
    points, boxes = dense(), [*boxes_at_random(60, 2), (60, 5.5, 5.25, 5.5, 5.25), (61, 5.25, 5.0, 5.75, 5.5), (62, -200.0, -200.0, 200.0, 200.0), (63, None, 0.0, 1.0, 1.0), (64, 2.0, 2.0, 1.0, 1.0)]
    ok = (lambda a, p, b: a <= p <= b) if kind == "intersects" else (lambda a, p, b: a < p < b)
    want = sorted((i, j) for i, x, y in points for j, x0, y0, x1, y1 in boxes if None not in (x, y, x0) and ok(x0, x, x1) and ok(y0, y, y1))
    p, b = spark.createDataFrame(points, POINT).repartition(3), spark.createDataFrame(boxes, BOX)
    for limit in (50, 10**6):
        found = spatial.points_in_boxes(p, b, 30.0, kind, "inner", limit=limit)
        assert found.columns == ["pt_id", "x", "y", "area_id", "xmin", "ymin", "xmax", "ymax"]
        assert sorted((r.pt_id, r.area_id) for r in found.collect()) == want
    left = spatial.points_in_boxes(p, b, 30.0, kind, "left", limit=50).collect()
    assert {r.pt_id for r in left} == {i for i, *_ in points} and sum(r.area_id is not None for r in left) == len(want)


def test_leaves_are_small(spark):
    points = spark.createDataFrame(dense(), POINT)
    grid = cells.CellMap(points, 30.0, 50)
    sizes = [r["count"] for r in grid.points(points.where("x IS NOT NULL AND y IS NOT NULL")).groupBy(*cells.CellMap.KEYS).count().collect()]
    assert max(sizes) < 3 * 50 and sum(sizes) == 3001  # 1,000 of them in one place, over salts
    assert cells.CellMap(points, 30.0, 10**6).levels == 0
    assert cells.CellMap(points.limit(0), 30.0, 50).levels == 0


@pytest.mark.parametrize("distance", [0.0, 0.3, 7.0])
def test_within_distance(spark, distance):
    left, right = dense(600, 3), dense(300, 4)
    want = sorted((i, j) for i, x, y in left for j, u, v in right if None not in (x, y, u, v) and math.hypot(x - u, y - v) <= distance)
    a, b = spark.createDataFrame(left, POINT), spark.createDataFrame(right, POINT)
    assert sorted((r.pt_id, r.r_pt_id) for r in spatial.within_distance(a, b, distance, limit=40).collect()) == want
    with pytest.raises(ValueError):
        spatial.within_distance(a, b, -1.0)


@pytest.mark.parametrize("metres", [0.0, 1000.0, 400_000.0, 9_000_000.0])
def test_great_circle_join_at_poles_and_date_line(spark, metres):
    rng = random.Random(5)
    places = [(0.0, 90.0), (77.0, 90.0), (-120.0, -90.0), (180.0, 0.0), (-180.0, 0.0), (179.999, 0.001), (-179.999, 0.001), (180.0, 89.9), (0.0, 89.9), (13.4, 52.5), (13.4, 52.5)]
    places += [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(150)]
    rows = [(i, x, y) for i, (x, y) in enumerate(places)] + [(900, None, 1.0), (901, 1.0, None)]

    def distance(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * spatial.MEAN_EARTH * math.asin(math.sqrt(min(1.0, h)))

    p = spark.createDataFrame(rows, POINT)
    found = spatial.within_great_circle(p, p, metres, limit=3)
    assert found.columns == ["pt_id", "x", "y", "r_pt_id", "r_x", "r_y", "distance"]
    got = Counter((r.pt_id, r.r_pt_id) for r in found.collect())
    near = {(a[0], b[0]): distance(a, b) for a in rows[:-2] for b in rows[:-2]}
    assert set(got.values()) == {1} and all(p in got for p, d in near.items() if d < metres - 0.01) and all(near[p] <= metres + 0.01 for p in got)
    assert all((i, i) in got for i in range(len(places)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        spatial.within_great_circle(p, p, 2.1e7)


@pytest.mark.parametrize("test", sorted(spatial.BOX_TESTS))
def test_box_pairs_once(spark, test):
    left = [*boxes_at_random(60, 6, whole=True), (60, -3.0, -3.0, -3.0, -3.0), (61, None, 0.0, 1.0, 1.0)]
    right = [*boxes_at_random(60, 7, whole=True), left[0], left[3]]
    distance = 2.5 if test == "dwithin" else 0.0

    def holds(a, b):
        (_, x0, y0, x1, y1), (_, u0, v0, u1, v1) = a, b
        meets = x0 <= u1 and x1 >= u0 and y0 <= v1 and y1 >= v0
        inside, around = x0 >= u0 and x1 <= u1 and y0 >= v0 and y1 <= v1, x0 <= u0 and x1 >= u1 and y0 <= v0 and y1 >= v1
        common = x0 < u1 and x1 > u0 and y0 < v1 and y1 > v0
        return {
            "intersects": meets, "within": inside, "coveredby": inside, "contains": around, "covers": around, "equals": inside and around, "touches": meets and (x0 == u1 or x1 == u0 or y0 == v1 or y1 == v0),
            "overlaps": common and not inside and not around, "dwithin": math.hypot(max(0.0, u0 - x1, x0 - u1), max(0.0, v0 - y1, y0 - v1)) <= 2.5,
        }[test]

    want = sorted((a[0], b[0]) for a in left if a[1] is not None for b in right if holds(a, b))
    a, b = spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)
    for limit in (5, 10**6):
        found = spatial.box_pairs(a, b, 7.0, test, distance, limit)
        assert sorted((r.area_id, r.r_area_id) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("Exchange" in line for line in plan[:join])  # no shuffle that removes repeats


def test_box_distance_is_checked(spark):
    a = spark.createDataFrame(boxes_at_random(2, 1), BOX)
    for args in (("dwithin", -1.0), ("touches", 2.0)):
        with pytest.raises(ValueError):
            spatial.box_pairs(a, a, 5.0, *args)


def test_box_difference_in_unit_squares(spark):
    left = [*boxes_at_random(25, 8, 12.0, True), (50, -30.0, -30.0, 30.0, 30.0), (51, 100.0, 100.0, 101.0, 101.0), (52, 3.0, 3.0, 3.0, 9.0), (53, None, 0.0, 1.0, 1.0)]
    right = [*boxes_at_random(40, 9, 5.0, True), (60, 99.0, 99.0, 102.0, 102.0), (61, None, 0.0, 1.0, 1.0)]
    pieces = spatial.box_difference(spark.createDataFrame(left, BOX).withColumn("x0", F.lit("clash")), spark.createDataFrame(right, BOX), 7.0)
    assert pieces.columns[:6] == ["area_id", "xmin", "ymin", "xmax", "ymax", "x0"]
    got = {}
    for r in pieces.collect():
        squares = {(x, y) for x in range(int(r.o_xmin), int(r.o_xmax)) for y in range(int(r.o_ymin), int(r.o_ymax))}
        assert r.area == len(squares) > 0 and not squares & got.setdefault(r.area_id, set())
        got[r.area_id] |= squares
    for i, x0, y0, x1, y1 in left:
        if x0 is None:
            assert i not in got
            continue
        covered = lambda x, y: any(b[1] is not None and b[1] <= x < b[3] and b[2] <= y < b[4] for b in right)
        want = {(x, y) for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1)) if not covered(x, y)}
        assert got.get(i, set()) == want
    none = spark.createDataFrame([], BOX)
    assert spatial.box_difference(none, spark.createDataFrame(right, BOX), 7.0).count() == 0
    assert spatial.box_difference(spark.createDataFrame(left, BOX), none, 7.0).agg(F.sum("area")).first()[0] == sum((a[3] - a[1]) * (a[4] - a[2]) for a in left if a[1] is not None)


# --- outlines


def unit(x, y, w=1.0, h=1.0, back=False):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return ring[::-1] if back else ring


def rings_of(spark, rows):
    return spark.createDataFrame([(i, g, None if ring is None else [{"x": float(x), "y": float(y)} for x, y in ring]) for i, (g, ring) in enumerate(rows)], "piece long, g string, ring array<struct<x:double,y:double>>").repartition(3)


def walked(points):
    """{ring key: [points in order]}"""
    out = {}
    for r in sorted(points.collect(), key=lambda r: r.position):
        out.setdefault((r.g, r.start_x, r.start_y, r.start_bx, r.start_by), []).append((r.x, r.y))
    return out


def test_dissolve_with_corners_on_sides(spark):
    """Squares of two sizes around a hole, written in either direction; a slanted pair that shares part of an edge; a null group."""
    frame = [unit(0, 0, 4, 1), unit(0, 3, 4, 1, True), unit(0, 1, 1, 2), unit(3, 1, 1, 1), unit(3, 2, 1, 1, True)]
    slant = [[(0, 0), (4, 2), (0, 2)], [(1, 0.5), (3, 1.5), (3, -2)]]
    rows = [("frame", r) for r in frame] + [("slant", r) for r in slant] + [(None, unit(0, 0)), (None, unit(1, 0)), ("frame", None), ("flat", [(0, 0), (1, 1), (2, 2)])]
    edges = outline.dissolve_noded(rings_of(spark, rows), "ring", "g", "piece")
    rings = outline.ring_points(edges, "g")
    sizes = {(r.g, r.area > 0): (round(r.area, 6), round(r.perimeter, 6)) for r in outline.ring_sizes(rings, "g").collect()}
    half = math.hypot(2, 1)
    assert sizes == {
        ("frame", True): (16.0, 16.0), ("frame", False): (-4.0, 8.0), (None, True): (2.0, 6.0),
        ("slant", True): (4 + 3.5, round(math.hypot(4, 2) + 4 + 2 + half + 3.5 + math.hypot(2, 2.5) - 2 * half, 6)),
    }


def test_rings_that_touch_stay_apart(spark):
    squares = [unit(0, 0), unit(1, 1), unit(0, 2), unit(5, 5)]
    rings = walked(outline.ring_points(outline.dissolve_noded(rings_of(spark, [("a", s) for s in squares]), "ring", "g", "piece"), "g"))
    assert len(rings) == 4 and all(len(p) == 4 and p[0] == k[1:3] for k, p in rings.items())
    assert outline.ring_points(outline.dissolve_noded(rings_of(spark, []), "ring", "g", "piece"), "g").count() == 0


def test_long_ring_over_many_partitions(spark):
    """One ring of 20,000 edges, shuffled: the points come in the order of a walk."""
    n = 20_000
    edges = spark.range(n).select(F.lit("g").alias("g"), *[f((F.col("id") + k) * 2 * math.pi / n).alias(c) for c, f, k in (("ax", F.cos, 0), ("ay", F.sin, 0), ("bx", F.cos, 1), ("by", F.sin, 1))])
    wrap = F.col("id") == n - 1
    edges = spark.range(n).select(F.lit("g").alias("g"), F.cos(F.col("id") * 2 * math.pi / n).alias("ax"), F.sin(F.col("id") * 2 * math.pi / n).alias("ay"), F.when(wrap, 1.0).otherwise(F.cos((F.col("id") + 1) * 2 * math.pi / n)).alias("bx"), F.when(wrap, 0.0).otherwise(F.sin((F.col("id") + 1) * 2 * math.pi / n)).alias("by"))
    (points,) = walked(outline.ring_points(edges.repartition(7), "g")).values()
    assert len(points) == n
    turns = [math.atan2(y, x) % (2 * math.pi) for x, y in points]
    step = 2 * math.pi / n
    assert all(abs((b - a) % (2 * math.pi) - step) < 1e-9 for a, b in zip(turns, turns[1:], strict=False)) and points[0] == min(points)


def test_cells_of_polygons_with_holes(spark):
    rng = random.Random(11)
    level, n = 6, 64

    def star(x, y, wide):
        return [(x + wide * rng.uniform(0.3, 1) * math.cos(a / 9 * 2 * math.pi), y + wide * rng.uniform(0.3, 1) * math.sin(a / 9 * 2 * math.pi)) for a in range(9)]

    shapes = [[star(x, y, 40.0), star(x, y, 10.0)] for x, y in ((0, 0), (100, 40), (-120, -30), (170, 70))] + [[star(20, 20, 1.0)], [unit(-180, -85, 360, 170)]]
    rows = [(i, i + 1, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s]) for i, s in enumerate(shapes)] + [(90, 1, None), (91, 1, [None]), (92, 1, [[{"x": 0.0, "y": 0.0}]]), (93, None, [[{"x": float(x), "y": float(y)} for x, y in unit(0, 0, 30, 30)]])]
    df = spark.createDataFrame(rows, "id long, v long, rings array<array<struct<x:double,y:double>>>").repartition(3)
    got = Counter((r.id, r.tile_x, r.tile_y) for r in outline.ring_cells(df.where("id < 93"), "rings", level, ["id"]).collect())
    centre = [(i, j, (i + 0.5) / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (j + 0.5) / n))))) for i in range(n) for j in range(n)]

    def inside(rings, x, y):
        crossed = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                crossed += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return crossed % 2 == 1

    want = {(k, i, j) for k, s in enumerate(shapes) for i, j, x, y in centre if inside(s, x, y)}
    assert set(got) == want and set(got.values()) == {1} and len([w for w in want if w[0] == 5]) == n * n
    filled = {(r.tile_x, r.tile_y): (r.feature_count, r.total) for r in outline.polyfill_rings(df, "rings", level, "id", "v").collect()}
    assert filled == {c: (sum((k, *c) in want for k in range(6)), sum(k + 1 for k in range(6) if (k, *c) in want)) for c in {w[1:] for w in want}}
    assert outline.polyfill_rings(df.limit(0), "rings", level, "id").count() == 0
