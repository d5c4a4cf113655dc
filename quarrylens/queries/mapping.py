"""Spatial joins, grids and metrics over derived points and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import outline as ol
from quarrylens.operators import spatial as sp
from quarrylens.queries.inputs import AREAS, POINTS, areas, derived, points, rounded

P, R = f"WITH p AS ({POINTS}) ", f"WITH p AS ({POINTS}), a AS ({AREAS}) "
TILES = "greatest(0, least({n} - 1, floor((x + 180) / 360 * {n})))", "greatest(0, least({n} - 1, floor((1 - ln(tan(radians(greatest(least(y, 85.05112878), -85.05112878))) + 1 / cos(radians(greatest(least(y, 85.05112878), -85.05112878)))) / pi()) / 2 * {n})))"


def _shifted(spark, sf):
    """The areas moved by parts of their width and height, so that boxes overlap across borders."""
    return areas(spark, sf).select("area_id", "grp", (F.col("xmin") + 27).alias("xmin"), (F.col("xmax") + 27).alias("xmax"), (F.col("ymin") + 3).alias("ymin"), (F.col("ymax") + 3).alias("ymax"))


def _nested(test, outer_left):
    """The areas against boxes of which every other lies inside one."""

    def run(spark, sf):
        a = areas(spark, sf)
        inner = a.select("area_id", (F.col("xmin") + 1).alias("xmin"), (F.col("xmax") - 2).alias("xmax"), "ymin", (F.col("ymax") + (F.col("area_id") % 2) * 4 - 3).alias("ymax"))
        left, right = (a, inner) if outer_left else (inner, a)
        return sp.box_pairs(left, right, 40.0, test).select("area_id", "r_area_id")

    return run


NESTED = ", i AS (SELECT area_id, xmin + 1 AS xmin, xmax - 2 AS xmax, ymin, ymax + (area_id % 2) * 4 - 3 AS ymax FROM a) "
SHIFTED = "b AS (SELECT area_id AS r_area_id, xmin + 27 AS r_xmin, xmax + 27 AS r_xmax, ymin + 3 AS r_ymin, ymax + 3 AS r_ymax FROM a)"


def _point_join(kind, how):
    return lambda s, d: sp.points_in_boxes(points(s, d), areas(s, d).withColumn("xmax", F.col("xmax") - 3), 30.0, kind, how).select("pt_id", "area_id")


def ring_join(spark, sf):
    a = areas(spark, sf).withColumn("ring", sp.box_ring())
    return sp.points_per_box(points(spark, sf), a, 30.0, "within", ring="ring")


def distance_join(spark, sf):
    return sp.pairs_within_distance(points(spark, sf).select("pt_id", "x", "y"), 6.0, "pt_id", 6).select("pt_id", "r_pt_id", "distance")


def great_circle(spark, sf):
    p = points(spark, sf)
    return rounded(p.select("pt_id", sp.haversine(F.col("x"), F.col("y"), F.lit(0.0), F.lit(51.5)).alias("metres")), 3)


def _box_pairs(test):
    return lambda s, d: sp.box_pairs(areas(s, d), _shifted(s, d), 40.0, test).select("area_id", "r_area_id")


def disjoint(spark, sf):
    return sp.box_disjoint_counts(areas(spark, sf), _shifted(spark, sf), 40.0)


def overlay(spark, sf):
    return rounded(sp.box_overlay(areas(spark, sf), _shifted(spark, sf), 40.0).select("area_id", "r_area_id", "area"), 4)


def extents(spark, sf):
    p = points(spark, sf).withColumn("g", F.col("pt_id") % 7)
    return rounded(sp.extents(p, ["g"]), 4)


def common(spark, sf):
    a = areas(spark, sf).select("grp", (F.col("xmin") - 200).alias("xmin"), (F.col("xmax") + 200).alias("xmax"), (F.col("ymin") - 90).alias("ymin"), (F.col("ymax") + 90).alias("ymax"))
    return rounded(sp.common_box(a, ["grp"]), 4)


def dissolve(spark, sf):
    a = areas(spark, sf).withColumn("grp", F.expr("CAST(floor(area_id / 9.0) AS BIGINT)"))
    edges = sp.dissolve(a.withColumn("ring", sp.box_ring()), "ring", "grp")
    return rounded(edges.groupBy("grp").agg(F.count("*").alias("edges"), F.sum(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))).alias("perimeter")), 4)


def stitched(spark, sf):
    """Strips of nine neighbours, each dissolved into one ring."""
    a = areas(spark, sf).select(F.expr("CAST(floor(area_id / 9.0) AS BIGINT)").alias("grp"), sp.box_ring().alias("ring"))
    rings = sp.stitch_rings(sp.dissolve(a, "ring", "grp"), "grp")
    return rounded(sp.ring_metrics(rings, "ring", "grp").select("grp", "area", "vertices"), 4)


def metrics(spark, sf):
    return rounded(sp.ring_metrics(areas(spark, sf).withColumn("ring", sp.box_ring()), "ring", "area_id").select("area_id", "area", "perimeter", "centroid_x", "centroid_y", "vertices"), 6)


def hexbins(spark, sf):
    return rounded(sp.hexbins(points(spark, sf), 500_000, "sum", "v", "x", "y"), 2)


def cells(spark, sf):
    out = sp.cells(points(spark, sf), 4, "v", "x", "y")
    return out.select("cell", "n", F.round("total", 2).alias("total"), F.round("mean", 5).alias("mean"))


def roll_up(spark, sf):
    return sp.roll_up(sp.cells(points(spark, sf), 5, None, "x", "y"), [1, 2, 3]).select(F.col("level").cast("long").alias("level"), "cell", "n")


def cell_boxes(spark, sf):
    c = sp.cell_box(sp.cells(points(spark, sf), 3, None, "x", "y"))
    return rounded(c.select("cell", "n", "xmin", "xmax", "ymin", "ymax"), 6)


def polyfill(spark, sf):
    return sp.polyfill(areas(spark, sf), 4, "grp")


def dots(spark, sf):
    a = areas(spark, sf).withColumn("value", (F.col("area_id") * 3).cast("double"))
    return sp.dot_density(a, "value", 10.0, "area_id").where("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").groupBy("area_id").agg(F.count("*").alias("dots"))


def tiles(spark, sf):
    return sp.tile_index(areas(spark, sf), [1, 2, 3]).select(F.col("z").cast("long").alias("z"), "tile_x", "tile_y", "features")


def glyphs(spark, sf):
    out = sp.glyph_grid(points(spark, sf), 2_000_000, ["v"], None, "x", "y")
    return rounded(out.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "weight", "sum_v", "grid_max"), 2)


def mercator(spark, sf):
    return rounded(sp.reproject(points(spark, sf), "x", "y").select("pt_id", "mx", "my"), 3)


def back(spark, sf):
    m = sp.reproject(points(spark, sf), "x", "y")
    lon, lat = sp.lonlat(F.col("mx"), F.col("my"))
    return rounded(m.select("pt_id", lon.alias("lon"), lat.alias("lat")), 6)


#: Points on the globe with some on the date line, near it, and at both poles.
GLOBE = """SELECT c_custkey AS pt_id, CASE c_custkey % 10 WHEN 3 THEN 180.0 WHEN 4 THEN -180 + CAST(c_custkey % 7 AS DOUBLE) / 4 ELSE CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 END AS x,
 CASE c_custkey % 25 WHEN 0 THEN 90.0 WHEN 1 THEN -90.0 WHEN 2 THEN 89.5 ELSE CAST((c_custkey * 6007) % 16000 AS DOUBLE) / 100 - 80 END AS y FROM customer"""
#: Points of which nine in ten lie in four by four degrees, a third of these in one place.
DENSE = """SELECT l_orderkey AS pt_id, CASE WHEN l_orderkey % 10 = 9 THEN CAST((l_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180 WHEN l_orderkey % 3 = 0 THEN 1.25 ELSE CAST(l_partkey % 400 AS DOUBLE) / 100 END AS x,
 CASE WHEN l_orderkey % 10 = 9 THEN CAST((l_suppkey * 6007) % 16000 AS DOUBLE) / 100 - 80 WHEN l_orderkey % 3 = 0 THEN 2.5 ELSE CAST((l_partkey * 31 + l_suppkey) % 400 AS DOUBLE) / 100 END AS y FROM lineitem"""


def great_circle_join(spark, sf):
    p = derived(spark, sf, GLOBE).select("pt_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return sp.pairs_within_great_circle(p, 300_000.0, "pt_id", 2).select("pt_id", "r_pt_id", F.col("distance").alias("metres"))


def dense_points(spark, sf):
    """Small boxes over points most of which share one grid cell."""
    p = derived(spark, sf, DENSE).select("pt_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    boxes = areas(spark, sf).select("area_id", (F.col("area_id") % 10 * 0.4).alias("xmin"), (F.col("area_id") % 10 * 0.4 + 0.5).alias("xmax"), (F.col("area_id") % 7 * 0.5).alias("ymin"), (F.col("area_id") % 7 * 0.5 + 0.75).alias("ymax"))
    return sp.points_per_box(p, boxes, 30.0, "within", limit=2000)


def boxes_within_distance(spark, sf):
    return sp.box_pairs(areas(spark, sf), _shifted(spark, sf), 40.0, "dwithin", 9.5).select("area_id", "r_area_id")


def difference(spark, sf):
    """Two in three of the areas, moved and widened so that they overlap each other, taken out of the areas."""
    cover = areas(spark, sf).where("area_id % 3 > 0").select((F.col("xmin") + 3).alias("xmin"), (F.col("xmax") + 3 + F.col("area_id") % 4 * 2).alias("xmax"), (F.col("ymin") - 2).alias("ymin"), (F.col("ymax") - 3 + F.col("area_id") % 5).alias("ymax"))
    left = sp.box_difference(areas(spark, sf), cover, 40.0)
    return rounded(left.groupBy("area_id").agg(F.sum("area").alias("area")), 4)


def _two_sizes(spark, sf):
    """Boxes of which every other is cut into halves, so that corners of one meet sides of another; strips of nine."""
    a = areas(spark, sf).select("area_id", F.expr("CAST(floor(area_id / 9.0) AS BIGINT)").alias("grp"), "xmin", "ymin", "xmax", "ymax", ((F.col("ymin") + F.col("ymax")) / 2).alias("ymid"))
    part = lambda k, lo, hi: F.struct(F.lit(k).alias("part"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    parts = F.when(F.col("area_id") % 2 == 0, F.array(part(1, "ymin", "ymid"), part(2, "ymid", "ymax"))).otherwise(F.array(part(0, "ymin", "ymax")))
    b = a.select("area_id", "grp", "xmin", "xmax", F.inline(parts)).select((F.col("area_id") * 3 + F.col("part")).alias("piece"), "grp", "xmin", F.col("lo").alias("ymin"), "xmax", F.col("hi").alias("ymax"))
    return b.select("piece", "grp", sp.box_ring().alias("ring"))


def dissolve_two_sizes(spark, sf):
    edges = ol.dissolve_noded(_two_sizes(spark, sf), "ring", "grp", "piece")
    return rounded(edges.groupBy("grp").agg(F.count("*").alias("edges"), F.sum(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))).alias("perimeter")), 4)


def ring_outlines(spark, sf):
    points = ol.ring_points(ol.dissolve_noded(_two_sizes(spark, sf), "ring", "grp", "piece"), "grp")
    return rounded(ol.ring_sizes(points, "grp").select("grp", "start_x", "start_y", "vertices", "area", "perimeter"), 4)


def polygons(spark, sf):
    """A slanted four-corner ring around each area with a diamond inside as a hole."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0, y1 = (F.col(c) for c in ("xmin", "xmax", "ymin", "ymax"))
    outer = F.array(p(x0 - 8, y0 - 5), p(x1 + 9, y0 + 0), p(x1 + 0, y1 + 11), p(x0 + 2, y1 + 3))
    hole = F.array(p(x0 + 4, y0 + 0), p(x1 + 0, y0 + 4), p(x0 + 4, y1 + 0), p(x0 + 0, y0 + 4))
    return areas(spark, sf).select("area_id", "grp", F.array(outer, hole).alias("rings"))


def polyfill_rings(spark, sf):
    return ol.polyfill_rings(polygons(spark, sf), "rings", 6, "area_id", "grp").select("tile_x", "tile_y", "feature_count", "total")


def _tile_sql(n):
    return [t.format(n=n) for t in TILES]


def _quadkey_sql(level):
    tx, ty = _tile_sql(1 << level)
    digits = " || ".join(f"CAST(((CAST(tx AS BIGINT) >> {i}) & 1) + 2 * ((CAST(ty AS BIGINT) >> {i}) & 1) AS VARCHAR)" for i in range(level - 1, -1, -1))
    return f"t AS (SELECT *, {tx} AS tx, {ty} AS ty FROM p), k AS (SELECT *, {digits} AS cell FROM t)"


HEX = "r AS (SELECT *, x * pi() / 180 * 6378137 AS mx, ln(tan(radians(y) / 2 + pi() / 4)) * 6378137 AS my FROM p WHERE abs(y) <= 85), a1 AS (SELECT *, my / 750000 AS py FROM r), a2 AS (SELECT *, floor(py + 0.5) AS j FROM a1), a3 AS (SELECT *, mx / (500000 * sqrt(3)) - (CAST(j AS BIGINT) & 1) / 2.0::DOUBLE AS px FROM a2), a4 AS (SELECT *, floor(px + 0.5) AS i, py - j AS d FROM a3), a5 AS (SELECT *, i + CASE WHEN px < i THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS i2, j + CASE WHEN py < j THEN -1 ELSE 1 END AS j2 FROM a4), a6 AS (SELECT *, abs(d) * 3 > 1 AND (px - i) * (px - i) + d * d > (px - i2) * (px - i2) + (py - j2) * (py - j2) AS moved FROM a5) SELECT CAST(CASE WHEN moved THEN i2 + CASE WHEN (CAST(j AS BIGINT) & 1) = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END ELSE i END AS BIGINT) AS pi, CAST(CASE WHEN moved THEN j2 ELSE j END AS BIGINT) AS pj, count(*) AS n, round(sum(v), 2) AS value FROM a6 GROUP BY 1, 2"
BOX = {"intersects": "xmin <= r_xmax AND xmax >= r_xmin AND ymin <= r_ymax AND ymax >= r_ymin", "overlaps": "xmin < r_xmax AND xmax > r_xmin AND ymin < r_ymax AND ymax > r_ymin"}
LAT = "degrees(atan(sinh(pi() * (1 - 2 * ({y}) / {n}))))"

#: Cells of the polygons above: for each centre the edges to its right, all cells against all edges.
POLYFILL = R + f", c AS (SELECT i AS tile_x, j AS tile_y, (i + 0.5) / 64 * 360 - 180 AS lon, {LAT.format(y='j + 0.5', n=64)} AS lat FROM range(64) a1(i), range(64) b1(j)), e AS (SELECT area_id, grp, unnest([[xmin - 8, ymin - 5, xmax + 9, ymin], [xmax + 9, ymin, xmax, ymax + 11], [xmax, ymax + 11, xmin + 2, ymax + 3], [xmin + 2, ymax + 3, xmin - 8, ymin - 5], [xmin + 4, ymin, xmax, ymin + 4], [xmax, ymin + 4, xmin + 4, ymax], [xmin + 4, ymax, xmin, ymin + 4], [xmin, ymin + 4, xmin + 4, ymin]]) AS q FROM a), h AS (SELECT area_id, grp, tile_x, tile_y FROM e JOIN c ON (q[2] > lat) <> (q[4] > lat) AND lon < (q[3] - q[1]) * (lat - q[2]) / (q[4] - q[2]) + q[1] GROUP BY ALL HAVING count(*) % 2 = 1) SELECT tile_x, tile_y, count(*) AS feature_count, CAST(sum(grp) AS BIGINT) AS total FROM h GROUP BY 1, 2"

QUERIES = {
    "jn2_points_intersect": (_point_join("intersects", "left"), R + "SELECT pt_id, area_id FROM p LEFT JOIN (SELECT area_id, xmin, xmax - 3 AS xmax, ymin, ymax FROM a) ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"),
    "jn2_points_within": (_point_join("within", "inner"), R + "SELECT pt_id, area_id FROM p JOIN (SELECT area_id, xmin, xmax - 3 AS xmax, ymin, ymax FROM a) ON x > xmin AND x < xmax AND y > ymin AND y < ymax"),
    "sp1_points_in_rings": (ring_join, R + "SELECT area_id, count(*) AS n FROM p JOIN a ON x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY 1"),
    "jn3_within_distance": (distance_join, P + "SELECT l.pt_id, r.pt_id AS r_pt_id, round(sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)), 6) AS distance FROM p l JOIN p r ON l.pt_id < r.pt_id AND sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) <= 6"),
    "sp2_great_circle": (great_circle, P + "SELECT pt_id, round(2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(51.5 - y) / 2), 2) + cos(radians(y)) * cos(radians(51.5)) * pow(sin(radians(0 - x) / 2), 2))), 3) AS metres FROM p"),
    "jn4_boxes_intersect": (_box_pairs("intersects"), R + f", {SHIFTED} SELECT area_id, r_area_id FROM a JOIN b ON {BOX['intersects']}"),
    "jn4_boxes_overlap": (_box_pairs("overlaps"), R + f", {SHIFTED} SELECT area_id, r_area_id FROM a JOIN b ON {BOX['overlaps']}"),
    "jn4_boxes_touch": (lambda s, d: sp.box_pairs(areas(s, d), areas(s, d), 40.0, "touches").select("area_id", "r_area_id"), R + "SELECT l.area_id, r.area_id AS r_area_id FROM a l JOIN a r ON (l.xmin = r.xmax OR l.xmax = r.xmin) AND l.ymin <= r.ymax AND l.ymax >= r.ymin OR (l.ymin = r.ymax OR l.ymax = r.ymin) AND l.xmin <= r.xmax AND l.xmax >= r.xmin"),
    "jn4_boxes_within": (_nested("within", False), R + NESTED + "SELECT i.area_id, a.area_id AS r_area_id FROM i JOIN a ON i.xmin >= a.xmin AND i.xmax <= a.xmax AND i.ymin >= a.ymin AND i.ymax <= a.ymax"),
    "jn4_boxes_contain": (_nested("contains", True), R + NESTED + "SELECT a.area_id, i.area_id AS r_area_id FROM a JOIN i ON i.xmin >= a.xmin AND i.xmax <= a.xmax AND i.ymin >= a.ymin AND i.ymax <= a.ymax"),
    "jn4_boxes_disjoint": (disjoint, R + f", {SHIFTED} SELECT area_id, count(*) FILTER (NOT ({BOX['intersects']})) AS disjoint FROM a, b GROUP BY 1"),
    "jn5_box_overlay": (overlay, R + f", {SHIFTED} SELECT area_id, r_area_id, round((least(xmax, r_xmax) - greatest(xmin, r_xmin)) * (least(ymax, r_ymax) - greatest(ymin, r_ymin)), 4) AS area FROM a JOIN b ON {BOX['overlaps']}"),
    "sp3_box_equals": (lambda s, d: sp.box_pairs(areas(s, d), areas(s, d), 40.0, "equals").select("area_id", "r_area_id"), R + "SELECT l.area_id, r.area_id AS r_area_id FROM a l JOIN a r USING (xmin, ymin, xmax, ymax)"),
    "sp4_extents": (extents, P + "SELECT pt_id % 7 AS g, round(min(x), 4) AS xmin, round(min(y), 4) AS ymin, round(max(x), 4) AS xmax, round(max(y), 4) AS ymax, count(*) AS n FROM p GROUP BY 1"),
    "ag3_common_box": (common, R + "SELECT grp, max(xmin) - 200 AS xmin, max(ymin) - 90 AS ymin, min(xmax) + 200 AS xmax, min(ymax) + 90 AS ymax FROM a GROUP BY 1 HAVING max(xmin) - 200 <= min(xmax) + 200 AND max(ymin) - 90 <= min(ymax) + 90"),
    "sp5_dissolve": (dissolve, R + ", e AS (SELECT CAST(floor(area_id / 9.0) AS BIGINT) AS grp, unnest([{'ax': xmin, 'ay': ymin, 'bx': xmax, 'by': ymin}, {'ax': xmax, 'ay': ymin, 'bx': xmax, 'by': ymax}, {'ax': xmin, 'ay': ymax, 'bx': xmax, 'by': ymax}, {'ax': xmin, 'ay': ymin, 'bx': xmin, 'by': ymax}]) AS s FROM a), o AS (SELECT grp, s FROM e GROUP BY 1, 2 HAVING count(*) = 1) SELECT grp, count(*) AS edges, round(sum(abs(s.bx - s.ax) + abs(s.by - s.ay)), 4) AS perimeter FROM o GROUP BY 1"),
    "sp5_stitched_rings": (stitched, R + "SELECT CAST(floor(area_id / 9.0) AS BIGINT) AS grp, round(sum((xmax - xmin) * (ymax - ymin)), 4) AS area, 2 * count(*) + 2 AS vertices FROM a GROUP BY 1"),
    "sp6_metrics": (metrics, R + "SELECT area_id, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * (xmax - xmin + ymax - ymin), 6) AS perimeter, round((xmin + xmax) / 2, 6) AS centroid_x, round((ymin + ymax) / 2, 6) AS centroid_y, CAST(4 AS BIGINT) AS vertices FROM a"),
    "sp7_hexbins": (hexbins, P + ", " + HEX),
    "sp8_cells": (cells, P + ", " + _quadkey_sql(4) + " SELECT cell, count(*) AS n, round(sum(v), 2) AS total, round(avg(v), 5) AS mean FROM k GROUP BY 1"),
    "sp9_roll_up": (roll_up, P + ", " + _quadkey_sql(5) + " SELECT CAST(l AS BIGINT) AS level, cell[1:l] AS cell, count(*) AS n FROM k, (VALUES (1), (2), (3)) v(l) GROUP BY 1, 2"),
    "sp10_cell_boxes": (cell_boxes, P + ", " + _quadkey_sql(3) + f" SELECT cell, count(*) AS n, round(tx / 8 * 360 - 180, 6) AS xmin, round((tx + 1) / 8 * 360 - 180, 6) AS xmax, round({LAT.format(y='ty + 1', n=8)}, 6) AS ymin, round({LAT.format(y='ty', n=8)}, 6) AS ymax FROM k GROUP BY cell, tx, ty"),
    "sp11_polyfill": (polyfill, R + f", c AS (SELECT i AS tile_x, j AS tile_y, (i + 0.5) / 16 * 360 - 180 AS lon, {LAT.format(y='j + 0.5', n=16)} AS lat FROM range(16) a1(i), range(16) b1(j)) SELECT tile_x, tile_y, count(*) AS feature_count, CAST(sum(grp) AS BIGINT) AS total FROM c JOIN a ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax GROUP BY 1, 2"),
    "sp2_great_circle_join": (great_circle_join, f"WITH p AS ({GLOBE}), d AS (SELECT l.pt_id, r.pt_id AS r_pt_id, 2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(r.y - l.y) / 2), 2) + cos(radians(l.y)) * cos(radians(r.y)) * pow(sin(radians(r.x - l.x) / 2), 2)))) AS m FROM p l JOIN p r ON l.pt_id < r.pt_id) SELECT pt_id, r_pt_id, round(m, 2) AS metres FROM d WHERE m <= 300000"),
    "sp1_dense_cell": (dense_points, f"WITH p AS ({DENSE}), a AS ({AREAS}), b AS (SELECT area_id, area_id % 10 * 0.4::DOUBLE AS xmin, area_id % 7 * 0.5::DOUBLE AS ymin FROM a) SELECT area_id, count(*) AS n FROM p JOIN b ON x > xmin AND x < xmin + 0.5::DOUBLE AND y > ymin AND y < ymin + 0.75::DOUBLE GROUP BY 1"),
    "jn4_boxes_dwithin": (boxes_within_distance, R + f", {SHIFTED} SELECT area_id, r_area_id FROM a JOIN b ON sqrt(pow(greatest(0, r_xmin - xmax, xmin - r_xmax), 2) + pow(greatest(0, r_ymin - ymax, ymin - r_ymax), 2)) <= 9.5"),
    "jn5_box_difference": (difference, R + ", c AS (SELECT xmin + 3 AS x0, xmax + 3 + area_id % 4 * 2 AS x1, ymin - 2 AS y0, ymax - 3 + area_id % 5 AS y1 FROM a WHERE area_id % 3 > 0), u AS (SELECT area_id, xmin + i AS x, ymin + j AS y FROM a, range(8) r(i), range(8) s(j)) SELECT area_id, CAST(count(*) AS DOUBLE) AS area FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE x0 <= x AND x1 > x AND y0 <= y AND y1 > y) GROUP BY 1"),
    "sp5_dissolve_noded": (dissolve_two_sizes, R + "SELECT CAST(floor(area_id / 9.0) AS BIGINT) AS grp, 2 * count(*) + 2 + (min(area_id) + 1) % 2 + (max(area_id) + 1) % 2 AS edges, 16.0::DOUBLE * count(*) + 16 AS perimeter FROM a GROUP BY 1"),
    "sp5_ring_outlines": (ring_outlines, R + "SELECT CAST(floor(area_id / 9.0) AS BIGINT) AS grp, min(xmin) AS start_x, min(ymin) AS start_y, 2 * count(*) + 2 + (min(area_id) + 1) % 2 + (max(area_id) + 1) % 2 AS vertices, sum((xmax - xmin) * (ymax - ymin)) AS area, 16.0::DOUBLE * count(*) + 16 AS perimeter FROM a GROUP BY 1"),
    "sp11_polyfill_rings": (polyfill_rings, POLYFILL),
    "sp13_dot_density": (dots, R + "SELECT area_id, CAST(greatest(1, floor(area_id * 3 / 10.0)) AS BIGINT) AS dots FROM a WHERE area_id * 3 > 0"),
    "sp14_tile_index": (tiles, R + ", z AS (SELECT area_id, z, n, " + "greatest(0, least(n - 1, floor((xmin + 180) / 360 * n))) AS x0, greatest(0, least(n - 1, floor((xmax + 180) / 360 * n))) AS x1, " + TILES[1].format(n="n").replace("(y,", "(ymax,") + " AS y0, " + TILES[1].format(n="n").replace("(y,", "(ymin,") + " AS y1 FROM a, (VALUES (1, 2), (2, 4), (3, 8)) v(z, n)) SELECT CAST(z AS BIGINT) AS z, i AS tile_x, j AS tile_y, count(*) AS features FROM z, range(8) r1(i), range(8) r2(j) WHERE i BETWEEN x0 AND x1 AND j BETWEEN y0 AND y1 GROUP BY 1, 2, 3"),
    "sp15_glyph_grid": (glyphs, P + ", g AS (SELECT CAST(floor(x * pi() / 180 * 6378137 / 2000000) AS BIGINT) AS gx, CAST(floor(ln(tan(radians(y) / 2 + pi() / 4)) * 6378137 / 2000000) AS BIGINT) AS gy, count(*) * 1.0::DOUBLE AS weight, sum(v) AS s FROM p WHERE abs(y) <= 85 GROUP BY 1, 2) SELECT gx, gy, weight, round(s, 2) AS sum_v, (SELECT round(max(abs(s)), 2) FROM g) AS grid_max FROM g"),
    "sp16_reproject": (mercator, P + "SELECT pt_id, round(radians(x) * 6378137, 3) AS mx, round(ln(tan(radians(y) / 2 + pi() / 4)) * 6378137, 3) AS my FROM p"),
    "sp16_round_trip": (back, P + "SELECT pt_id, round(x, 6) AS lon, round(y, 6) AS lat FROM p"),
}
