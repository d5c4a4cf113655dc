"""Outlines and cells of polygons as jobs over their edges: nothing walks around a polygon in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.spatial import ring_edges, tile_xy
from quarrylens.sources.shared import written

#: Decimal places in which slope and height of two edges must agree to lie on one line.
PLACES = 9


def directed_edges(df: DataFrame, ring: str, keys: list[str], row_id: str) -> DataFrame:
    """(keys, x1, y1, x2, y2): the edges of each ring with its inside on their left, whichever way the ring is written.
    Edges without length, and rings without area, have none."""
    edges = ring_edges(df, ring, [row_id, *keys])
    turn = edges.groupBy(row_id).agg(F.signum(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))).alias("__turn"))
    edges = edges.join(turn, row_id).where("`__turn` <> 0 AND (x1 <> x2 OR y1 <> y2)")
    pick = lambda a, b: F.when(F.col("__turn") > 0, F.col(a)).otherwise(F.col(b))
    return edges.select(*keys, pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"))


def dissolve_noded(df: DataFrame, ring: str, group: str, row_id: str) -> DataFrame:
    """(group, ax, ay, bx, by): the outer edges of the union of each group's polygons, with the inside on their left. Polygons
    of a group must not overlap, but neighbours may share any part of an edge.

    Edges are grouped by the line they lie on, every line is cut at all end points on it, and a running count says how
    many edges cover each stretch: those that one edge covers are outer. The work is spread over lines, so a group of
    any size is no task of its own. Edges along the axes are exact; slanted ones lie on one line if slope and height
    agree in ``PLACES`` decimal places. Null rings are left out; null is a group like any other."""
    edges = directed_edges(df.where(F.col(ring).isNotNull()), ring, [group], row_id)
    upright = F.col("x1") == F.col("x2")
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    height = F.when(upright, F.col("x1")).when(slope == 0, F.col("y1")).otherwise(F.round(F.col("y1") - slope * F.col("x1"), PLACES))
    line = F.struct(upright.alias("upright"), F.coalesce(F.round(slope, PLACES), F.lit(0.0)).alias("slope"), height.alias("height"))
    forward = F.when(upright, F.col("y2") > F.col("y1")).otherwise(F.col("x2") > F.col("x1"))
    first, second = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    low, high = F.when(forward, first).otherwise(second), F.when(forward, second).otherwise(first)
    way = F.when(forward, 1).otherwise(-1)
    ends = F.array(F.struct(low.alias("p"), F.lit(1).alias("n"), way.alias("w")), F.struct(high.alias("p"), F.lit(-1).alias("n"), (-way).alias("w")))
    events = edges.select(group, line.alias("__line"), ends.alias("__ends")).select(group, "__line", F.inline("__ends")).select(group, "__line", "p", "n", "w", F.when(F.col("__line.upright"), F.col("p.y")).otherwise(F.col("p.x")).alias("__at"))
    nodes = events.groupBy(group, "__line", "__at").agg(F.min("p").alias("p"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    along = Window.partitionBy(group, "__line").orderBy("__at")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = nodes.select(group, "p", F.lead("p").over(along).alias("q"), F.sum("n").over(upto).alias("n"), F.sum("w").over(upto).alias("w")).where("n = 1")
    end = lambda a, b, c: F.when(F.col("w") > 0, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    return cut.select(group, end("p", "q", "x").alias("ax"), end("p", "q", "y").alias("ay"), end("q", "p", "x").alias("bx"), end("q", "p", "y").alias("by"))


def ring_points(edges: DataFrame, group: str) -> DataFrame:
    """(group, start_x, start_y, position, x, y): the closed rings of directed edges (ax, ay to bx, by), point by point. A ring
    is named by its least edge's start (two rings that touch there also by the edge: start_bx, start_by), which has position 0.

    Each edge points to the next: the one that leaves its end, or of several the one that turns left most, so rings that
    touch in a point stay apart. Then pointers double: in every round an edge looks twice as far along its ring, for the
    least edge and the steps to it, and after about log2 of the longest ring's edges nothing changes any more. Every
    round is one join on unique keys, written to the shared folder; no ring and no group is held in one task. Edges that are not part of a
    closed ring (an end that no edge leaves) are an error of the input and are left out."""
    numbered = edges.select(group, *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]).distinct()
    numbered = written(numbered.withColumn("id", F.monotonically_increasing_id()), "half-edges")
    turn = F.pmod(F.atan2(F.col("o_by") - F.col("o_ay"), F.col("o_bx") - F.col("o_ax")) - F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")) + math.pi, F.lit(2 * math.pi))
    leaving = numbered.select(*[F.col(c).alias(f"o_{c}") for c in numbered.columns])
    meets = F.col(group).eqNullSafe(F.col(f"o_{group}")) & (F.col("bx") == F.col("o_ax")) & (F.col("by") == F.col("o_ay"))
    after = numbered.join(leaving, meets).groupBy("id").agg(F.max_by("o_id", F.struct(turn.alias("turn"), "o_id")).alias("next"))
    # least edge seen from here on, the steps to it, and the edge that is ``span`` steps on
    own = F.struct("ax", "ay", "bx", "by", "id")
    at = written(numbered.join(after, "id").select("id", "next", own.alias("least"), F.lit(0).cast("long").alias("steps")), "pointers")
    span = 1
    while True:
        ahead = at.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("least").alias("__least"), (F.col("steps") + span).alias("__steps"))
        closer = F.col("__least") < F.col("least")
        at = at.join(ahead, "next").select("id", F.col("__next").alias("next"), F.when(closer, F.col("__least")).otherwise(F.col("least")).alias("least"), F.when(closer, F.col("__steps")).otherwise(F.col("steps")).alias("steps"), closer.alias("changed"))
        at = written(at, "pointers")
        if at.where("changed").isEmpty():
            break
        at, span = at.drop("changed"), 2 * span
    size = at.groupBy("least").agg(F.count("*").alias("edges"))
    placed = at.join(size, "least").join(numbered, "id")
    return placed.select(group, F.col("least.ax").alias("start_x"), F.col("least.ay").alias("start_y"), F.col("least.bx").alias("start_bx"), F.col("least.by").alias("start_by"), F.pmod(F.col("edges") - F.col("steps"), F.col("edges")).alias("position"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def ring_sizes(points: DataFrame, group: str) -> DataFrame:
    """(group, start_x, start_y, vertices, area, perimeter) of the rings of ``ring_points``; the area of a hole is negative."""
    ring = [group, "start_x", "start_y", "start_bx", "start_by"]
    along = Window.partitionBy(*ring).orderBy("position")
    back = {"px": F.lag("x").over(along), "py": F.lag("y").over(along)}
    steps = points.withColumns(back)
    first = steps.groupBy(*ring).agg(
        F.count("*").alias("vertices"), F.sum(F.col("px") * F.col("y") - F.col("x") * F.col("py")).alias("cross"), F.sum(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("length"),
        F.max(F.struct("position", "x", "y")).alias("last"),
    )
    x, y = F.col("last.x"), F.col("last.y")  # the way back to the start closes the ring
    return first.select(group, "start_x", "start_y", "vertices", ((F.coalesce("cross", F.lit(0.0)) + x * F.col("start_y") - F.col("start_x") * y) / 2).alias("area"), (F.coalesce("length", F.lit(0.0)) + F.hypot(F.col("start_x") - x, F.col("start_y") - y)).alias("perimeter"))


def _row_latitude(row: Column, level: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (row + 0.5) / (1 << level)))))


def ring_cells(df: DataFrame, rings: str, level: int, keys: list[str]) -> DataFrame:
    """(keys, tile_x, tile_y): the cells of a level whose centre lies in a polygon, by the even-odd rule over all its rings
    (arrays of points x, y in degrees), so holes count. ``keys`` tell the polygons apart and come along.

    Scan lines: every edge is laid on the rows of tiles whose centre line it crosses; the crossings of a row in order are
    the ends of runs inside, and a run is filled. A large polygon is many rows of work, not one. Null polygons and rings
    have no cells, rings beyond 85 degrees end there, and points on a border belong to the side that the even-odd rule
    gives them."""
    if not 0 <= level <= 29:
        raise ValueError("levels are 0 to 29")
    n = 1 << level
    each = df.select(*keys, F.explode(rings).alias("__ring")).where("size(__ring) > 2")
    edges = ring_edges(each, "__ring", keys)
    row = lambda y: tile_xy(F.lit(0.0), y, level)[1]
    top, bottom = row(F.greatest("y1", "y2")), row(F.least("y1", "y2"))
    rows = edges.where("y1 <> y2").withColumn("tile_y", F.explode(F.sequence(F.greatest(top - 1, F.lit(0)), F.least(bottom + 1, F.lit(n - 1)))))
    rows = rows.withColumn("__lat", _row_latitude(F.col("tile_y"), level)).where("(y1 > `__lat`) <> (y2 > `__lat`)")
    crossing = (F.col("x2") - F.col("x1")) * (F.col("__lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    line = Window.partitionBy(*keys, "tile_y").orderBy("__x")
    runs = rows.select(*keys, "tile_y", crossing.alias("__x")).select(*keys, "tile_y", "__x", F.lead("__x").over(line).alias("__end"), F.row_number().over(line).alias("__n"))
    runs = runs.where("`__n` % 2 = 1 AND `__x` < `__end`")
    column = lambda x: F.floor((x + 180) / 360 * n)
    filled = runs.withColumn("tile_x", F.explode(F.sequence(F.greatest(column(F.col("__x")) - 1, F.lit(0)), F.greatest(F.lit(0), F.least(column(F.col("__end")) + 1, F.lit(n - 1))))))
    lon = (F.col("tile_x") + 0.5) / n * 360 - 180
    return filled.where((lon >= F.col("__x")) & (lon < F.col("__end"))).select(*keys, "tile_x", "tile_y")


def polyfill_rings(df: DataFrame, rings: str, level: int, row_id: str, value: str | None = None) -> DataFrame:
    """(tile_x, tile_y, feature_count, total, mean) of the cells whose centre lies in the polygons; rows without a value are left
    out where one is asked for."""
    rows = df.where(F.col(rings).isNotNull())
    if value:
        rows = rows.where(F.col(value).isNotNull())
    inside = ring_cells(rows, rings, level, [row_id, *([value] if value else [])])
    more = [F.sum(value).alias("total"), F.avg(value).alias("mean")] if value else []
    return inside.groupBy("tile_x", "tile_y").agg(F.count("*").alias("feature_count"), *more)
