"""Spatial jobs on points (x, y), boxes (xmin, ymin, xmax, ymax) and rings (arrays of structs x, y).

Joins never compare all pairs: both sides are laid on a grid, equal cells meet, and the exact test follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.casts import half_up
from quarrylens.operators.cells import MAP_ROWS, ROWS_PER_CELL, CellMap, at_level, places, salted
from quarrylens.sources.shared import written

EARTH = 6378137.0
MEAN_EARTH = 6371008.8
MAX_LATITUDE = 85.05112878


def _on_cells(df: DataFrame, prefix: str, size: float) -> DataFrame:
    """A row for each grid cell that the row's box meets, as ``__cell``. Columns are split first, then rows, so a large box
    never holds all its cells in one array."""
    at = lambda c: F.floor(F.col(f"{prefix}{c}") / size)
    good = df.where(f"{prefix}xmin <= {prefix}xmax AND {prefix}ymin <= {prefix}ymax")
    wide = good.withColumn("__i", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("__j", F.explode(F.sequence(at("ymin"), at("ymax"))))
    return wide.withColumn("__cell", F.struct(F.col("__i").alias("i"), F.col("__j").alias("j"))).drop("__i", "__j")


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the ring's edges; points on the boundary are told apart by ``on_ring``."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))
        return ((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(ring, crosses)) % 2 == 1


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    n = F.size(ring)

    def touches(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(F.transform(ring, lambda p, i: touches(p, i)), lambda t: t)


def point_in_box(kind: str) -> Column:
    """Intersects holds on the boundary; within and contains do not."""
    if kind == "intersects":
        return F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return (F.col("x") > F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") < F.col("ymax"))


def _lies_in(kind: str, ring: str | None) -> Column:
    """The exact test of a point and a box, or a ring within the box; the bounds are looked at before the ring's edges."""
    if not ring:
        return point_in_box(kind)
    around, edge = in_ring(F.col(ring), F.col("x"), F.col("y")), on_ring(F.col(ring), F.col("x"), F.col("y"))
    return point_in_box("intersects") & ((around | edge) if kind == "intersects" else (around & ~edge))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, kind: str = "intersects", how: str = "left", row_id: str = "pt_id", ring: str | None = None, limit: int = ROWS_PER_CELL) -> DataFrame:
    """Each point with the boxes (or rings within them) it lies in. A point has one cell, so no pair comes up twice. Cells
    with more than ``limit`` points are split."""
    grid = CellMap(points, cell, limit)
    hits = grid.points(points).join(grid.boxes(boxes), list(CellMap.KEYS)).where(_lies_in(kind, ring)).drop(*CellMap.KEYS)
    if how == "inner":
        return hits
    extra = [c for c in boxes.columns if c not in points.columns]
    return points.join(hits.select(F.col(row_id).alias("__id"), *extra), F.col(row_id) == F.col("__id"), "left").drop("__id")


def points_per_box(points: DataFrame, boxes: DataFrame, cell: float, kind: str = "intersects", row_id: str = "area_id", ring: str | None = None, limit: int = ROWS_PER_CELL) -> DataFrame:
    """(row_id, n): how many points lie in each box (or ring within it); those without a point are left out. No pairs of points
    and boxes are made: points are counted by place, equal boxes are one shape, places meet shapes, and the sums of the
    shapes go back to their boxes. Points in cells that no box meets are dropped as they are read, unless there are too many
    such cells to broadcast. Cells with more than ``limit`` places are split."""
    shape = ["xmin", "ymin", "xmax", "ymax", *([ring] if ring else [])]
    shapes = written(boxes.select(*shape).distinct().withColumn("__shape", F.monotonically_increasing_id()), "shapes")
    met = _on_cells(shapes, "", cell).select("__cell.i", "__cell.j").distinct()
    inside = points.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y")
    if met.count() <= MAP_ROWS:
        at = {f"__{n}": at_level(F.col(c), cell, 0) for c, n in (("x", "i"), ("y", "j"))}
        inside = inside.withColumns(at).join(F.broadcast(met.toDF(*at)), list(at), "left_semi")
    spots = written(inside.groupBy("x", "y").agg(F.count("*").alias("__points")), "spots")
    grid = CellMap(spots, cell, limit)
    hits = grid.points(spots).join(grid.boxes(shapes), list(CellMap.KEYS)).where(_lies_in(kind, ring))
    sums = hits.groupBy("__shape").agg(F.sum("__points").alias("__points")).join(shapes, "__shape").drop("__shape")
    return boxes.select(row_id, *shape).join(sums, shape).groupBy(row_id).agg(F.sum("__points").alias("n"))


def planar(x1, y1, x2, y2) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres on the sphere of mean radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _sides(left: DataFrame, right: DataFrame | None, x: str, y: str, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The places of both tables, all names of the right ones begun by r_. Without a right table the places of the left one
    twice, with lists of bare ids where it has no other column."""
    if right is None:
        own = places(left, x, y, row_id if {*left.columns} == {x, y, row_id} else None)
        return own, own.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in own.columns])
    right = places(right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns]), f"r_{x}", f"r_{y}")
    return places(left, x, y), right.withColumnsRenamed({c: f"r_{c}" for c in ("__part", "__rows", "__n")})


def _not_after(names: list[str]) -> Column:
    """Whether the left place comes before the right one, or is the same, in the order of these columns."""
    *before, last = names
    out = F.col(last) <= F.col(f"r_{last}")
    for c in reversed(before):
        out = (F.col(c) < F.col(f"r_{c}")) | ((F.col(c) == F.col(f"r_{c}")) & out)
    return out


def _all_pairs(near: DataFrame, columns: list[str], r_columns: list[str]) -> DataFrame:
    """The pairs of rows of each two places, with the distance of these."""
    both = near.select("*", F.inline("__rows")).select("*", F.inline("r___rows"))
    return both.select(*[F.col(f"`{c}`") for c in [*columns, *r_columns]], "distance")


def _pairs_once(near: DataFrame, columns: list[str], row_id: str, x: str, y: str) -> DataFrame:
    """The pairs of rows of one table with different ids, the lesser on the left, from places of which each two come up once. A
    list and itself give a pair in both orders, of which one stays."""
    both = near.select("*", F.explode("__rows").alias("__a")).select("*", F.explode("r___rows").alias("__b"))
    field = lambda side, c: F.col(side) if {*columns} == {x, y, row_id} else F.col(f"{side}.`{c}`")
    first, second = field("__a", row_id), field("__b", row_id)
    itself = (F.col(x) == F.col(f"r_{x}")) & (F.col(y) == F.col(f"r_{y}")) & (F.col("__part") == F.col("r___part"))
    both = both.where((first < second) | ((first > second) & ~itself))
    at = lambda c, side, prefix: F.col(f"`{prefix}{c}`") if c in (x, y) else field(side, c)
    pick = lambda c, way: F.when(way, at(c, "__a", "")).otherwise(at(c, "__b", "r_"))
    return both.select(*[pick(c, first < second).alias(c) for c in columns], *[pick(c, first > second).alias(f"r_{c}") for c in columns], "distance")


def _near(own: DataFrame, other: DataFrame, distance: float, limit: int, once: bool) -> DataFrame:
    """The places at most ``distance`` apart, and the distance; with ``once`` the two of a pair in one order."""
    grid = CellMap(own, distance, limit, weight="__n")
    wider = {"__xmin": F.col("r_x") - distance, "__xmax": F.col("r_x") + (0.0 if once else distance), "__ymin": F.col("r_y") - distance, "__ymax": F.col("r_y") + distance}
    around = grid.boxes(other.withColumns(wider), "__xmin", "__ymin", "__xmax", "__ymax").drop(*wider)
    pairs = grid.points(own).join(around.hint("merge"), list(CellMap.KEYS)).drop(*CellMap.KEYS)
    if once:
        pairs = pairs.where(_not_after(["x", "y", "__part"]))
    pairs = pairs.where((F.abs(F.col("x") - F.col("r_x")) <= distance) & (F.abs(F.col("y") - F.col("r_y")) <= distance))
    return pairs.withColumn("distance", planar(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).where(F.col("distance") <= distance)


def _rounded(near: DataFrame, digits: int | None) -> DataFrame:
    return near if digits is None else near.withColumn("distance", F.round("distance", digits))


def within_distance(left: DataFrame, right: DataFrame, distance: float = 100.0, limit: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs of points (x, y in both; the right columns are renamed r_) at most ``distance`` apart, and the distance.
    Places are compared, not points: those in one place are a list, and pairs are made of two lists that are near. Cells are as
    wide as the distance, so a partner is in one of nine; cells with more than ``limit`` left points are split.
    A distance of 0 asks for equal coordinates. Points without coordinates have no partner."""
    if not 0 <= distance < math.inf:
        raise ValueError("the distance is a finite number of at least 0")
    r_columns = [f"r_{c}" for c in right.columns]
    if distance == 0:
        right = right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
        return left.join(right, (F.col("x") == F.col("r_x")) & (F.col("y") == F.col("r_y"))).withColumn("distance", F.lit(0.0))
    return _all_pairs(_near(*_sides(left, right, "x", "y"), distance, limit, False), left.columns, r_columns)


def pairs_within_distance(points: DataFrame, distance: float, row_id: str, digits: int | None = None, limit: int = ROWS_PER_CELL) -> DataFrame:
    """``within_distance`` of a table and itself, each pair of rows with different ids once, the lesser id on the left. The
    distance is worked out, and rounded to ``digits`` places, once for two places and not for every pair of rows there."""
    if not 0 < distance < math.inf:
        raise ValueError("the distance is a finite number above 0")
    near = _near(*_sides(points, None, "x", "y", row_id), distance, limit, True)
    return _pairs_once(_rounded(near, digits), points.columns, row_id, "x", "y")


def within_great_circle(left: DataFrame, right: DataFrame, metres: float, lon: str = "x", lat: str = "y", limit: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs of points at most ``metres`` apart on the sphere of mean radius (the right columns are renamed r_), and the
    distance. Points are laid on a grid of cubes around the unit sphere, as wide as the chord of the distance, so that
    poles and the date line are places like any other; a partner is in one of the 27 cubes around, of which those off the
    sphere or out of reach hold nothing. Cubes with more than ``limit`` left points are dealt over several salts. Points without
    coordinates have no partner; a distance that reaches around half the sphere is an error, as it asks for all pairs."""
    near = _near_on_sphere(left, right, metres, lon, lat, limit)
    return _all_pairs(near, left.columns, [f"r_{c}" for c in right.columns])


def pairs_within_great_circle(points: DataFrame, metres: float, row_id: str, digits: int | None = None, lon: str = "x", lat: str = "y", limit: int = ROWS_PER_CELL) -> DataFrame:
    """``within_great_circle`` of a table and itself, each pair of rows with different ids once, the lesser id on the left; the
    distance is rounded to ``digits`` places."""
    near = _near_on_sphere(points, None, metres, lon, lat, limit, row_id)
    return _pairs_once(_rounded(near, digits), points.columns, row_id, lon, lat)


def _near_on_sphere(left: DataFrame, right: DataFrame | None, metres: float, lon: str, lat: str, limit: int, row_id: str | None = None) -> DataFrame:
    """The places at most ``metres`` apart, and the distance; without a right table each two of the left one once."""
    if not 0 <= metres < math.pi * MEAN_EARTH:
        raise ValueError("the distance is at least 0 and below half the circumference")
    once = right is None
    # a little wider than the chord for rounding; cubes below some metres would only be more numerous
    wide = max(2 * math.sin(metres / (2 * MEAN_EARTH)) * (1 + 1e-9), 1e-6)
    place = lambda p: (F.cos(F.radians(F.col(p + lat))) * F.cos(F.radians(F.col(p + lon))), F.cos(F.radians(F.col(p + lat))) * F.sin(F.radians(F.col(p + lon))), F.sin(F.radians(F.col(p + lat))))
    axes, unit = ("__i", "__j", "__k"), ("__u", "__v", "__w")
    on_sphere = lambda df, p: df.withColumns({p + u: v for u, v in zip(unit, place(p), strict=True)}).withColumns({a: F.floor(F.col(p + u) / wide) for a, u in zip(axes, unit, strict=True)})
    own, around = _sides(left, right, lon, lat, row_id)
    own, around = on_sphere(own, ""), on_sphere(around, "r_")
    for a in axes:  # of two places of one table the left one is not higher, so its cube is not higher either
        around = around.withColumn(a, F.explode(F.array(*[F.col(a) + d for d in ((-1, 0) if once and a == "__k" else (-1, 0, 1))])))
    nearest = lambda a: F.when(F.col(a) >= 0, F.col(a)).when(F.col(a) < -1, -(F.col(a) + 1)).otherwise(0) * wide
    farthest = lambda a: F.greatest(F.abs(a), F.abs(F.col(a) + 1)) * wide
    gap = lambda a: F.greatest(F.col(a) * wide - F.col(f"r_{unit[axes.index(a)]}"), F.col(f"r_{unit[axes.index(a)]}") - (F.col(a) + 1) * wide, F.lit(0.0))
    square = lambda of: sum((of(a) * of(a) for a in axes), F.lit(0.0))
    around = around.where((square(nearest) <= 1 + 1e-9) & (square(farthest) >= 1 - 1e-9) & (square(gap) <= wide * wide * (1 + 1e-6)))
    own, around = salted(own, around.drop("r___n"), list(axes), limit, "__n")
    pairs = own.join(around.hint("merge"), [*axes, "__salt"]).drop(*axes, "__salt")
    if once:
        pairs = pairs.where(_not_after(["__w", lon, lat, "__part"]))
    apart = sum(((F.col(u) - F.col(f"r_{u}")) * (F.col(u) - F.col(f"r_{u}")) for u in unit), F.lit(0.0))
    pairs = pairs.where(apart <= wide * wide * (1 + 1e-6))
    return pairs.withColumn("distance", haversine(F.col(lon), F.col(lat), F.col(f"r_{lon}"), F.col(f"r_{lat}"))).where(F.col("distance") <= metres)


BOX_TESTS = {
    "intersects": "xmin <= r_xmax AND xmax >= r_xmin AND ymin <= r_ymax AND ymax >= r_ymin",
    "within": "xmin >= r_xmin AND xmax <= r_xmax AND ymin >= r_ymin AND ymax <= r_ymax",
    "contains": "xmin <= r_xmin AND xmax >= r_xmax AND ymin <= r_ymin AND ymax >= r_ymax",
    "equals": "xmin = r_xmin AND xmax = r_xmax AND ymin = r_ymin AND ymax = r_ymax",
    "touches": "(xmin = r_xmax OR xmax = r_xmin) AND ymin <= r_ymax AND ymax >= r_ymin OR (ymin = r_ymax OR ymax = r_ymin) AND xmin <= r_xmax AND xmax >= r_xmin",
    "overlaps": "xmin < r_xmax AND xmax > r_xmin AND ymin < r_ymax AND ymax > r_ymin AND NOT (xmin >= r_xmin AND xmax <= r_xmax AND ymin >= r_ymin AND ymax <= r_ymax) AND NOT (xmin <= r_xmin AND xmax >= r_xmax AND ymin <= r_ymin AND ymax >= r_ymax)",
}
#: Boxes at most a distance apart (a parameter of ``box_pairs``).
BOX_TESTS["dwithin"] = "hypot(greatest(0.0D, r_xmin - xmax, xmin - r_xmax), greatest(0.0D, r_ymin - ymax, ymin - r_ymax)) <= {distance}"
BOX_TESTS |= {"covers": BOX_TESTS["contains"], "coveredby": BOX_TESTS["within"]}


def box_pairs(left: DataFrame, right: DataFrame, cell: float, test: str = "intersects", distance: float = 0.0, limit: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs of boxes for which the test holds (the right columns are renamed r_). Every test needs a common point of the
    right box and the left one, grown by ``distance`` for ``dwithin``. Of the cells that both meet only the one that holds
    the lowest corner of what they share tells of the pair, so each comes up once without a shuffle that removes repeats.
    Cells with more than ``limit`` left boxes are dealt over several salts. Boxes with a null bound or none between their
    bounds have no partner."""
    if not 0 <= distance < math.inf or (distance and test != "dwithin"):
        raise ValueError("only dwithin takes a distance, a finite number of at least 0")
    right = right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
    grown = {f"__{c}": F.col(c) + (distance if c[1:] == "max" else -distance) for c in ("xmin", "ymin", "xmax", "ymax")}
    own, other = salted(_on_cells(left.withColumns(grown), "__", cell), _on_cells(right, "r_", cell), ["__cell"], limit)
    pairs = own.join(other, ["__cell", "__salt"]).where(BOX_TESTS[test].format(distance=repr(float(distance)) + "D"))
    corner = lambda c: F.floor(F.greatest(f"__{c}", f"r_{c}") / cell)
    return pairs.where((corner("xmin") == F.col("__cell.i")) & (corner("ymin") == F.col("__cell.j"))).drop("__cell", "__salt", *grown)


def box_disjoint_counts(left: DataFrame, right: DataFrame, cell: float, id_left: str = "area_id") -> DataFrame:
    """How many right boxes each left box does not meet: all of them less those it meets."""
    met = box_pairs(left, right, cell).groupBy(id_left).agg(F.count("*").alias("met"))
    n = right.agg(F.count("*").alias("all"))
    return left.join(met, id_left, "left").crossJoin(F.broadcast(n)).select(id_left, (F.col("all") - F.coalesce("met", F.lit(0))).alias("disjoint"))


def box_overlay(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Intersections of pairs of boxes with a common area."""
    pairs = box_pairs(left, right, cell)
    corner = {"o_xmin": F.greatest("xmin", "r_xmin"), "o_ymin": F.greatest("ymin", "r_ymin"), "o_xmax": F.least("xmax", "r_xmax"), "o_ymax": F.least("ymax", "r_ymax")}
    return pairs.withColumns(corner).where("o_xmin < o_xmax AND o_ymin < o_ymax").withColumn("area", (F.col("o_xmax") - F.col("o_xmin")) * (F.col("o_ymax") - F.col("o_ymin")))


def box_difference(left: DataFrame, right: DataFrame, cell: float, row_id: str = "area_id") -> DataFrame:
    """What is left of each left box without all right boxes that meet it: the left columns with pieces (o_xmin, o_ymin, o_xmax,
    o_ymax) that do not overlap, and their area. A box that is wholly covered has no piece.

    Boxes are cut by the grid first, so a large one is spread over its cells and a piece meets the right boxes of one cell
    only. The bounds of those cut it into slabs along x, and in every slab the gaps between the covered stretches of y are
    what is left. ``row_id`` tells the left boxes apart. Boxes with a null bound have no piece and cover nothing."""
    bounds = {"xmin": ("i", 0), "ymin": ("j", 0), "xmax": ("i", 1), "ymax": ("j", 1)}
    clip = {f"__{c}": (F.greatest if c[1:] == "min" else F.least)(F.col(c), (F.col(f"__cell.{axis}") + step) * F.lit(float(cell))) for c, (axis, step) in bounds.items()}
    pieces = _on_cells(left, "", cell).withColumns(clip).where("__xmin < __xmax AND __ymin < __ymax")
    pieces = written(pieces, "pieces")
    key = [row_id, "__cell"]
    own = pieces.select(*key, *clip)
    cover = _on_cells(right.select(*[F.col(c).alias(f"r_{c}") for c in bounds]), "r_", cell)
    met = own.join(cover, "__cell").select(*own.columns, *[(F.greatest if c[1:] == "min" else F.least)(f"__{c}", f"r_{c}").alias(f"c_{c}") for c in bounds]).where("c_xmin < c_xmax AND c_ymin < c_ymax")
    met = written(met, "covers")
    cuts = own.select(*key, F.explode(F.array("__xmin", "__xmax")).alias("x")).unionByName(met.select(*key, F.explode(F.array("c_xmin", "c_xmax")).alias("x"))).distinct()
    along = Window.partitionBy(*key).orderBy("x")
    slabs = cuts.select(*key, F.col("x").alias("x0"), F.lead("x").over(along).alias("x1")).where("x1 IS NOT NULL")
    covered = slabs.join(met.select(*key, "c_xmin", "c_xmax", "c_ymin", "c_ymax"), key).where("c_xmin <= x0 AND c_xmax >= x1").select(*key, "x0", "x1", "c_ymin", "c_ymax")
    tops = slabs.join(own, key).select(*key, "x0", "x1", F.col("__ymax").alias("c_ymin"), F.col("__ymax").alias("c_ymax"))
    before = Window.partitionBy(*key, "x0").orderBy("c_ymin", "c_ymax").rowsBetween(Window.unboundedPreceding, -1)
    stretches = covered.unionByName(tops).withColumn("__from", F.max("c_ymax").over(before))
    gaps = stretches.join(own.select(*key, "__ymin"), key).withColumn("__from", F.coalesce("__from", "__ymin")).where("__from < c_ymin")
    gaps = gaps.select(*key, F.col("x0").alias("o_xmin"), F.col("__from").alias("o_ymin"), F.col("x1").alias("o_xmax"), F.col("c_ymin").alias("o_ymax"))
    out = pieces.drop(*clip).join(gaps, key).drop("__cell")
    return out.select(*left.columns, "o_xmin", "o_ymin", "o_xmax", "o_ymax").withColumn("area", (F.col("o_xmax") - F.col("o_xmin")) * (F.col("o_ymax") - F.col("o_ymin")))


def extents(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"), F.count("*").alias("n"))


def common_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """The intersection of all boxes of a group; none where it is empty."""
    out = df.groupBy(*keys).agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))
    return out.where("xmin <= xmax AND ymin <= ymax")


def box_ring() -> Column:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"))


def ring_edges(df: DataFrame, ring: str, keys: list[str]) -> DataFrame:
    n = F.size(ring)
    edge = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))["x"].alias("x2"), F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))["y"].alias("y2")))
    return df.select(*keys, F.inline(edge))


def dissolve(df: DataFrame, ring: str, group: str) -> DataFrame:
    """Outer edges of the union of each group's polygons: shared edges occur twice and fall out. Neighbours must share
    whole edges; an edge met by a vertex of its neighbour stays."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    edges = ring_edges(df, ring, [group]).select(group, pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by"))
    return edges.groupBy(group, "ax", "ay", "bx", "by").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def ring_metrics(df: DataFrame, ring: str, row_id: str) -> DataFrame:
    """area, perimeter, centroid, vertices and bounds of each ring, by sums over its edges."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = ring_edges(df, ring, [row_id]).groupBy(row_id).agg(
        F.sum(cross).alias("c"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("cx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("cy"),
        F.sum(planar(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("perimeter"), F.count("*").alias("vertices"),
        F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"),
    )
    return sums.select(row_id, (F.abs("c") / 2).alias("area"), "perimeter", F.try_divide(F.col("cx"), 3 * F.col("c")).alias("centroid_x"), F.try_divide(F.col("cy"), 3 * F.col("c")).alias("centroid_y"), "vertices", "xmin", "ymin", "xmax", "ymax")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * EARTH


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def reproject(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y = mercator(F.col(lon), F.col(lat))
    return df.withColumns({"mx": x, "my": y})


def hexbins(df: DataFrame, radius: float, fn: str = "count", value: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(pi, pj, n, value): pointy-top hexagons of at least 10 m in Web Mercator. Points beyond 85 degrees or not finite are
    dropped; an empty average drops its cell, an empty sum is 0."""
    r = max(10.0, radius)
    dx, dy = r * math.sqrt(3), r * 1.5
    good = F.abs(F.col(lat)).between(0, 85) & F.col(lon).isNotNull() & ~F.isnan(F.col(lon).cast("double")) & (F.abs(F.col(lon)) < 1e6)
    mx, my = mercator(F.col(lon), F.col(lat))
    rows = df.where(good).withColumns({"__x": mx, "__y": my}).withColumn("__py", F.col("__y") / dy).withColumn("__j", half_up(F.col("__py")))
    rows = rows.withColumn("__px", F.col("__x") / dx - F.pmod(F.col("__j"), F.lit(2)) / 2).withColumn("__i", half_up(F.col("__px"))).withColumn("__d", F.col("__py") - F.col("__j"))
    i2 = F.col("__i") + F.when(F.col("__px") < F.col("__i"), -1).otherwise(1) / 2
    j2 = F.col("__j") + F.when(F.col("__py") < F.col("__j"), -1).otherwise(1)
    a, b = F.col("__px") - F.col("__i"), F.col("__px") - i2
    moved = (F.abs("__d") * 3 > 1) & (a * a + F.col("__d") * F.col("__d") > b * b + (F.col("__py") - j2) * (F.col("__py") - j2))
    pi = F.when(moved, i2 + F.when(F.pmod(F.col("__j"), F.lit(2)) == 1, 1).otherwise(-1) / 2).otherwise(F.col("__i"))
    rows = rows.select(*df.columns, pi.cast("long").alias("pi"), F.when(moved, j2).otherwise(F.col("__j")).cast("long").alias("pj"))
    agg = {"count": lambda: F.count("*").cast("double"), "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)), "avg": lambda: F.avg(value)}[fn]()
    return rows.groupBy("pi", "pj").agg(F.count("*").alias("n"), agg.cast("double").alias("value")).where("value IS NOT NULL")


def tile_xy(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    n = 1 << level
    phi = F.radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    return inside(x), inside(y)


def quadkey(lon: Column, lat: Column, level: int) -> Column:
    """The tile's digits, most significant first: one for x plus two for y of every bit."""
    if not 1 <= level <= 23:
        raise ValueError("levels are 1 to 23")
    x, y = tile_xy(lon, lat, level)
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(x, i) + 2 * bit(y, i)).cast("string") for i in range(level - 1, -1, -1)])


def cells(df: DataFrame, level: int, value: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    rows = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("cell", quadkey(F.col(lon), F.col(lat), level))
    more = [F.sum(value).alias("total"), F.avg(value).alias("mean")] if value else []
    return rows.groupBy("cell").agg(F.count("*").alias("n"), *more)


def roll_up(cell_counts: DataFrame, levels: list[int]) -> DataFrame:
    """Counts of every cell at coarser levels, all in one grouping."""
    rows = cell_counts.select(F.explode(F.array(*map(F.lit, levels))).alias("level"), "cell", "n").where(F.length("cell") >= F.col("level"))
    return rows.groupBy("level", F.substr("cell", F.lit(1), F.col("level")).alias("cell")).agg(F.sum("n").alias("n"))


def cell_box(df: DataFrame, cell: str = "cell") -> DataFrame:
    """Bounds, centre and ground area (square kilometres) of each cell."""
    z = F.length(cell)
    digits = F.split(F.col(cell), "")
    number = lambda want: F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: acc * 2 + d.isin(*want).cast("long"))
    out = df.withColumns({"tile_x": number(["1", "3"]), "tile_y": number(["2", "3"]), "zoom": z})
    n = F.pow(F.lit(2.0), F.col("zoom"))
    lat = lambda y: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))
    out = out.withColumns({"xmin": F.col("tile_x") / n * 360 - 180, "xmax": (F.col("tile_x") + 1) / n * 360 - 180, "ymax": lat(F.col("tile_y")), "ymin": lat(F.col("tile_y") + 1), "center_lon": (F.col("tile_x") + 0.5) / n * 360 - 180, "center_lat": lat(F.col("tile_y") + 0.5)})
    area = F.radians(F.col("xmax") - F.col("xmin")) * (F.sin(F.radians("ymax")) - F.sin(F.radians("ymin"))) * (MEAN_EARTH / 1000) ** 2
    return out.withColumn("ground_km2", area)


def polyfill(boxes: DataFrame, level: int, value: str | None = None, buffer: float = 0.0) -> DataFrame:
    """(tile_x, tile_y, feature_count, total) of the cells whose centre lies in a box grown by ``buffer`` degrees."""
    rows = boxes.where("xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL")
    if value:
        rows = rows.where(F.col(value).isNotNull())
    rows = rows.withColumns({"xmin": F.col("xmin") - buffer, "ymin": F.col("ymin") - buffer, "xmax": F.col("xmax") + buffer, "ymax": F.col("ymax") + buffer})
    n = 1 << level
    x0, y1 = tile_xy(F.col("xmin"), F.col("ymin"), level)
    x1, y0 = tile_xy(F.col("xmax"), F.col("ymax"), level)
    rows = rows.withColumn("tile_x", F.explode(F.sequence(x0, x1))).withColumn("tile_y", F.explode(F.sequence(y0, y1)))
    lon = (F.col("tile_x") + 0.5) / n * 360 - 180
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (F.col("tile_y") + 0.5) / n))))
    inside = rows.where(lon.between(F.col("xmin"), F.col("xmax")) & lat.between(F.col("ymin"), F.col("ymax")))
    more = [F.sum(value).alias("total")] if value else []
    return inside.groupBy("tile_x", "tile_y").agg(F.count("*").alias("feature_count"), *more)


def dot_density(df: DataFrame, value: str, per_dot: float, row_id: str, seed: int = 1) -> DataFrame:
    """max(1, whole dots) points for each box with a positive value, at hashed places inside it."""
    n = F.greatest(F.lit(1), F.floor(F.col(value) / per_dot)).cast("int")
    dots = df.where(F.col(value) > 0).withColumn("dot", F.explode(F.sequence(F.lit(1), n)))
    unit = lambda k: (F.xxhash64(row_id, "dot", F.lit(seed * 2 + k)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    return dots.withColumns({"x": F.col("xmin") + unit(0) * (F.col("xmax") - F.col("xmin")), "y": F.col("ymin") + unit(1) * (F.col("ymax") - F.col("ymin"))})


def tile_index(boxes: DataFrame, levels: list[int]) -> DataFrame:
    """(z, tile_x, tile_y, features) of the tiles that each box touches, at every level."""
    out = None
    for z in levels:
        x0, y1 = tile_xy(F.col("xmin"), F.col("ymin"), z)
        x1, y0 = tile_xy(F.col("xmax"), F.col("ymax"), z)
        part = boxes.withColumn("tile_x", F.explode(F.sequence(x0, x1))).withColumn("tile_y", F.explode(F.sequence(y0, y1))).select(F.lit(z).alias("z"), "tile_x", "tile_y")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("z", "tile_x", "tile_y").agg(F.count("*").alias("features"))


def glyph_grid(df: DataFrame, cell_size: float, values: list[str], weight: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Sums of up to six values in square Mercator cells, the weight of each and the grid's largest sum."""
    mx, my = mercator(F.col(lon), F.col(lat))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.where(F.abs(F.col(lat)) <= 85).withColumns({"gx": F.floor(mx / cell_size), "gy": F.floor(my / cell_size), "__w": w})
    sums = rows.groupBy("gx", "gy").agg(F.sum("__w").alias("weight"), *[F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(f"sum_{v}") for v in values[:6]])
    most = sums.agg(F.max(F.greatest(*[F.abs(f"sum_{v}") for v in values[:6]], F.lit(0.0))).alias("grid_max"))
    return sums.crossJoin(F.broadcast(most))


def stitch_rings(edges: DataFrame, group: str) -> DataFrame:
    """Closed rings from the outer edges of ``dissolve``: (group, ring_number, ring, vertices). Edges of a group are
    walked from their least vertex on; where several meet, the one with the least end goes first. A group's outline
    is put together in one task, so groups are meant to be regions, not the whole table."""
    kind = dict(edges.dtypes)[group]

    def walk(rows):
        import pandas as pd

        ends: dict[tuple, list] = {}
        for a, b in zip(zip(rows.ax, rows.ay, strict=True), zip(rows.bx, rows.by, strict=True), strict=True):
            ends.setdefault(a, []).append(b)
            ends.setdefault(b, []).append(a)
        rings = []
        for start in sorted(ends):
            while ends[start]:
                ring, at = [start], start
                while ends[at]:
                    nxt = min(ends[at])
                    ends[at].remove(nxt)
                    ends[nxt].remove(at)
                    at = nxt
                    if at == start:
                        break
                    ring.append(at)
                rings.append(ring)
        return pd.DataFrame({group: [rows[group].iloc[0]] * len(rings), "ring_number": range(len(rings)), "ring": [[{"x": x, "y": y} for x, y in r] for r in rings], "vertices": [len(r) for r in rings]})

    return edges.groupBy(group).applyInPandas(walk, f"`{group}` {kind}, ring_number long, ring array<struct<x:double,y:double>>, vertices long")
