"""Queries over tables with more rows and larger keys than those given, against their SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import cells, charts, spatial
from quarrylens.queries import ORACLES, QUERIES

from .conftest import SF, same


def checked(spark, tmp_path, name, **tables):
    """The query's rows against its SQL, both over the given tables: DuckDB SQL that reads the given ones by their names."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY (SELECT * FROM ({sql.format(sf=SF)})) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    same(df, con, ORACLES[name])
    return df


def test_small_numbers_of_any_key(spark, tmp_path):
    """keys beyond a smallint, up to the last int, and none."""
    keys = "VALUES (0, 0), (1, 32767), (2, 32768), (3, 90000), (4, 65535), (5, 65536), (6, 2147483647), (7, NULL), (8, -1), (9, -2147483648)"
    df = checked(spark, tmp_path, "prj4_normalised_types", orders=f"SELECT o.* REPLACE (CAST(k AS BIGINT) AS o_custkey) FROM '{{sf}}/orders.parquet' o JOIN ({keys}) t(i, k) ON o_orderkey = i")
    assert dict(df.dtypes) == {"o_orderkey": "bigint", "price": "double", "small": "int"}


def test_points_in_one_place_are_compared_once(spark, tmp_path):
    """six times the points of which most share a place; rows of places are made, not compared."""
    customers = "SELECT c.* REPLACE (CASE WHEN i % 2 = 0 THEN c_custkey + i * 144000 ELSE c_custkey + i * 15000 END AS c_custkey) FROM range(6) r(i), '{sf}/customer.parquet' c"
    df = checked(spark, tmp_path, "jn3_within_distance", customer=customers)
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    assert "explode(__rows" in plan[:join] and "explode(r___rows" in plan[:join]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_pairs_once_of_lists(spark, monkeypatch, most):
    """each pair of rows once with the lesser id on the left and its own columns, whatever the lists hold."""
    monkeypatch.setattr(cells.places, "__defaults__", (*cells.places.__defaults__[:-1], most))
    rng = random.Random(8)
    rows = [(i, f"n{i}", 0.5 * rng.randint(-9, 9), 0.5 * rng.randint(-9, 9)) for i in range(150)]
    rows += [(i, None, 2.0, -1.0) for i in range(150, 160)] + [(3, "again", 1.0, 1.0), (None, "no id", 1.0, 1.0), (170, "no place", None, 1.0), (171, "a", -0.0, 0.0), (172, "b", 0.0, -0.0)]
    rng.shuffle(rows)
    p = spark.createDataFrame(rows, "id long, name string, x double, y double").repartition(3)
    placed = [r for r in rows if r[0] is not None and r[2] is not None]
    plane = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    want = sorted((repr(a), repr(b), round(plane(a, b), 3)) for a in placed for b in placed if a[0] < b[0] and plane(a, b) <= 1.2)
    for limit in (20, 10**6):
        got = [(r[:4], r[4:8], r.distance) for r in spatial.pairs_within_distance(p, 1.2, "id", 3, limit).collect()]
        assert sorted((repr(tuple(a)), repr(tuple(b)), d) for a, b, d in got) == [(a.replace("-0.0", "0.0"), b.replace("-0.0", "0.0"), d) for a, b, d in want]
        bare = [(r.id, r.r_id, r.distance) for r in spatial.pairs_within_distance(p.drop("name"), 1.2, "id", 3, limit).collect()]
        assert sorted(bare) == sorted((a[0], b[0], round(plane(a, b), 3)) for a in placed for b in placed if a[0] < b[0] and plane(a, b) <= 1.2)
    both = [(r.id, r.r_id) for r in spatial.within_distance(p, p, 1.2).where("id < r_id").collect()]
    assert sorted(both) == sorted((a[0], b[0]) for a in placed for b in placed if a[0] < b[0] and plane(a, b) <= 1.2)
    assert spatial.within_distance(p.select("x", "y"), p.select("x", "y"), 1.2).count() == sum(plane(a, b) <= 1.2 for a in rows if a[2] is not None for b in rows if b[2] is not None)
    with pytest.raises(ValueError):
        spatial.pairs_within_distance(p, 0.0, "id")


def test_equal_rings_meet_each_place_once(spark, tmp_path):
    """six times the points and areas, of which most share place and shape; the SQL's rows without a pair of each."""
    customers, suppliers = ("SELECT t.* REPLACE ({key} + i * {step} AS {key}) FROM range(6) r(i), '{{sf}}/{name}.parquet' t".format(key=k, step=n, name=t) for k, n, t in (("c_custkey", 144000, "customer"), ("s_suppkey", 900, "supplier")))
    df = checked(spark, tmp_path, "sp1_points_in_rings", customer=customers, supplier=suppliers)
    assert "sum(__points" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("kind", ["intersects", "within"])
def test_points_per_box(spark, monkeypatch, kind, few):
    """counts of boxes and of rings in them equal those of the pairs, with borders, repeated and empty shapes and nulls."""
    if not few:
        monkeypatch.setattr(spatial, "MAP_ROWS", 0)
    rng = random.Random(9)
    points = [(i, 0.25 * rng.randint(-40, 40), 0.25 * rng.randint(-40, 40)) for i in range(400)] + [(i, 1.0, 1.0) for i in range(400, 500)] + [(500, None, 1.0), (501, 1.0, None), (502, -0.0, 0.0)]
    boxes = []
    for i in range(40):
        x, y, w, h = (0.25 * rng.randint(a, b) for a, b in ((-40, 40), (-40, 40), (0, 24), (0, 24)))
        boxes += [(2 * i, x, y, x + w, y + h), (2 * i + 1, x, y, x + w, y + h)] if i % 3 else [(2 * i, x, y, x + w, y + h)]
    boxes += [(90, -0.0, -0.0, 2.0, 2.0), (91, 0.0, 0.0, 2.0, 2.0), (92, None, 0.0, 1.0, 1.0), (93, 2.0, 2.0, 1.0, 1.0), (94, -300.0, -300.0, 300.0, 300.0), (94, 0.0, 0.0, 2.0, 2.0)]
    p = spark.createDataFrame(points, "pt_id long, x double, y double").repartition(3)
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    diamond = F.array(corner(middle("xmin", "xmax"), F.col("ymin")), corner(F.col("xmax"), middle("ymin", "ymax")), corner(middle("xmin", "xmax"), F.col("ymax")), corner(F.col("xmin"), middle("ymin", "ymax")))
    b = spark.createDataFrame(boxes, "area_id long, xmin double, ymin double, xmax double, ymax double").withColumn("ring", F.when(F.col("area_id") != 4, diamond))
    for ring in (None, "ring"):
        want = Counter(r.area_id for r in spatial.points_in_boxes(p, b, 7.0, kind, "inner", ring=ring).collect())
        for limit in (30, 10**6):
            got = spatial.points_per_box(p, b, 7.0, kind, ring=ring, limit=limit)
            assert got.columns == ["area_id", "n"] and {r.area_id: r.n for r in got.collect()} == want and len(want) > 20
    inside = (lambda a, v, z: a <= v <= z) if kind == "intersects" else (lambda a, v, z: a < v < z)
    plain = Counter(i for i, x0, y0, x1, y1 in boxes for _, x, y in points if None not in (x0, x, y) and inside(x0, x, x1) and inside(y0, y, y1))
    assert {r.area_id: r.n for r in spatial.points_per_box(p, b, 7.0, kind).collect()} == plain


def test_scatter_has_every_point(spark, tmp_path):
    """more points than the 12,000 that a sample once held."""
    df = checked(spark, tmp_path, "ch6_scatter", orders="SELECT o.* REPLACE (o_orderkey + i * 1500 AS o_orderkey) FROM range(12) r(i), '{sf}/orders.parquet' o")
    assert df.count() > 12_000
    o = spark.read.parquet(f"{tmp_path}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    some = [charts.scatter(p, "o_custkey", "o_totalprice", "o_orderkey", [], 50) for p in (o, o.repartition(5))]
    assert len({tuple(sorted(r.o_orderkey for r in s.collect())) for s in some}) == 1 and some[0].count() == 50


def test_points_on_the_globe_in_one_place(spark, tmp_path):
    """six times the points, most of them in places of others; places are joined, and rows are made of their lists."""
    df = checked(spark, tmp_path, "sp2_great_circle_join", customer="SELECT c.* REPLACE (CASE WHEN i % 2 = 0 THEN c_custkey + i * 144000 ELSE c_custkey + i * 15000 END AS c_custkey) FROM range(4) r(i), '{sf}/customer.parquet' c")
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    assert "explode(__rows" in plan[:join] and "explode(r___rows" in plan[:join] and "struct" not in plan[:join]


def test_pairs_once_on_the_globe(spark):
    """each pair once at poles, on the date line and in one place, over salts or not; with other columns or without."""
    rng = random.Random(12)
    rows = [(i, f"n{i % 7}", rng.choice([-180.0, 180.0, -179.5, 0.0, 1.0, rng.uniform(-180, 180)]), rng.choice([90.0, -90.0, 89.5, 0.0, rng.uniform(-90, 90)])) for i in range(200)]
    rows += [(i, None, 13.4, 52.5) for i in range(200, 220)] + [(None, "no id", 13.4, 52.5), (221, "no place", 13.4, None)]
    p = spark.createDataFrame(rows, "id long, name string, x double, y double").repartition(3)
    for metres in (0.0, 300_000.0, 5_000_000.0):
        want = Counter((r.id, r.name, r.r_id, r.r_name, round(r.distance, 2)) for r in spatial.within_great_circle(p, p, metres).where("id < r_id").collect())
        assert set(want.values()) == {1} and len(want) > 190
        for limit in (5, 10**6):
            assert Counter((r.id, r.name, r.r_id, r.r_name, r.distance) for r in spatial.pairs_within_great_circle(p, metres, "id", 2, limit=limit).collect()) == want
            bare = spatial.pairs_within_great_circle(p.drop("name"), metres, "id", 2, limit=limit)
            assert Counter((r.id, r.r_id, r.distance) for r in bare.collect()) == Counter((a, b, d) for a, _, b, _, d in want)


def test_dense_points_are_counted_by_place(spark, tmp_path):
    """four times the points and areas; places and shapes meet, not points and areas."""
    keys = {"lineitem": "l_orderkey + i * 1500 AS l_orderkey, l_partkey + i * 200 AS l_partkey, l_suppkey + i * 10 AS l_suppkey", "supplier": "s_suppkey + i * 10 AS s_suppkey"}
    df = checked(spark, tmp_path, "sp1_dense_cell", **{t: f"SELECT t.* REPLACE ({k}) FROM range(4) r(i), '{{sf}}/{t}.parquet' t" for t, k in keys.items()})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "sum(__points" in plan and "l_orderkey" not in plan
