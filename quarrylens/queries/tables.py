"""Sources and sinks: files are written from the given tables into the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylens.functions.casts import column_subset, normalised_types, public_columns
from quarrylens.operators import profile as pf
from quarrylens.operators.filters import filtered, search
from quarrylens.operators.outline import polyfill_rings
from quarrylens.queries.inputs import AREAS, ORDERS_N, POINTS, areas, orders_n, points, rounded, table
from quarrylens.queries.mapping import POLYFILL, polygons
from quarrylens.sources import io
from quarrylens.sources.shared import new_path


def folder(spark) -> str:
    return new_path(spark, "files")


def csv(spark, sf):
    io.write(table(spark, sf, "customer"), path := folder(spark), "csv")
    return io.csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


def delimited(spark, sf):
    table(spark, sf, "supplier").write.option("header", True).option("sep", "\t").csv(path := folder(spark))
    return io.delimited(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_acctbal")


def json_rows(spark, sf):
    body = table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("data"))).alias("value"))  # a fixed table of 25 rows
    body.write.text(path := folder(spark))
    return io.json_rows(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def geojson(spark, sf):
    io.geojson_lines(points(spark, sf), "x", "y").write.text(path := folder(spark) + ".geojsonl")
    return rounded(io.geojson(spark, path).select(F.col("pt_id").cast("long").alias("pt_id"), "geometry_type", "x", "y"), 6)


def geojson_areas(spark, sf):
    """Areas with holes, every other one in two parts, written as features, read back and laid on cells."""
    p = polygons(spark, sf)
    outer, hole = F.get("rings", F.lit(0)), F.get("rings", F.lit(1))
    parts = F.when(F.col("area_id") % 2 == 0, F.array("rings")).otherwise(F.array(F.array(outer), F.array(hole)))
    io.geojson_areas(p.select("area_id", "grp", parts.alias("parts")), "parts").write.text(path := folder(spark) + ".geojsonl")
    read = io.geojson(spark, path).where("NOT bad_geometry").select(F.col("area_id").cast("long").alias("area_id"), F.col("grp").cast("long").alias("grp"), "rings")
    return polyfill_rings(read, "rings", 6, "area_id", "grp").select("tile_x", "tile_y", "feature_count", "total")


def area_lines(spark, sf):
    """The features of areas with holes, read as plain JSON: rings are closed, so they have five points."""
    rows = io.geojson_areas(polygons(spark, sf).select("area_id", F.array("rings").alias("parts")), "parts")
    at = lambda p: F.get_json_object("value", p)
    rings = F.from_json(at("$.geometry.coordinates"), "array<array<array<double>>>")
    return rows.select(at("$.properties.area_id").cast("long").alias("area_id"), at("$.geometry.type").alias("type"), F.size(rings).alias("rings"), F.aggregate(rings, F.lit(0), lambda a, r: a + F.size(r)).alias("points"))


def _boxes(spark, sf):
    path = folder(spark)
    areas(spark, sf).select("area_id", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox")).write.parquet(path)
    return path


def area_read(spark, sf):
    return io.read_area(spark, _boxes(spark, sf), (-50.0, -40.0, 40.0, 20.0), ["area_id"])


def inspect(spark, sf):
    return io.inspect(spark, _boxes(spark, sf)).select("field", "rows", "area_pushdown")


def named(spark, sf):
    table(spark, sf, "region").createOrReplaceTempView("named_region")
    return spark.table("named_region")


def listing(spark, sf):
    table(spark, sf, "region").createOrReplaceTempView("listed_region")
    found = [(n, ",".join(c)) for n, c in io.list_tables(spark) if n == "listed_region"]
    return table(spark, sf, "region").limit(1).select(F.lit(found[0][0]).alias("name"), F.lit(found[0][1]).alias("columns"))


def proven_id(spark, sf):
    df, name, quality = pf.row_id(table(spark, sf, "orders"))
    return df.agg(F.count_distinct(name).alias("ids")).select(F.lit(name).alias("row_id"), F.lit(quality).alias("quality"), "ids")


def made_id(spark, sf):
    df, name, quality = pf.row_id(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"))
    return df.agg(F.count_distinct(name).alias("ids"), F.min(name).cast("long").alias("first"), F.max(name).cast("long").alias("last")).withColumn("quality", F.lit(quality))


def cell_column(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lpad(F.lower(F.hex("o_orderkey")), 15, "8").alias("cell"))
    return o.agg(F.count("*").alias("rows")).select(F.lit(pf.cell_column(o)).alias("found"), "rows")


def round_trip(kind):
    def run(spark, sf):
        io.write(table(spark, sf, "part"), path := folder(spark), kind)
        df = spark.read.parquet(path) if kind == "parquet" else spark.read.json(path)
        return rounded(df.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("total")), 2)

    return run


def wkt(spark, sf):
    p = points(spark, sf)
    return io.csv_with_wkt(p, io.point_wkt("x", "y"), ["x", "y", "v"])


def ring_wkt(spark, sf):
    from quarrylens.operators.spatial import box_ring

    a = areas(spark, sf).withColumn("ring", box_ring())
    return io.csv_with_wkt(a.select("area_id", "ring"), io.ring_wkt("ring"), ["ring"])


def lines(spark, sf):
    rows = io.geojson_lines(points(spark, sf).select("pt_id", "x", "y"), "x", "y")
    return rows.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.properties.pt_id").cast("long").alias("pt_id"), F.get_json_object("value", "$.geometry.type").alias("geometry"))


def materialised(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    df, _ = io.materialise(rows, f"segments_{uuid.uuid4().hex[:8]}")
    return df.select("c_mktsegment", "n")


def exported(spark, sf):
    o = orders_n(spark, sf).withColumn("__internal", F.lit(1))
    view = search(filtered(o, [{"type": "range", "field": "price_n", "min": 200000}]), "high", ["prio_n"]).orderBy(F.desc_nulls_last("price_n"))
    io.write(public_columns(view), path := folder(spark), "parquet")
    return rounded(spark.read.parquet(path).drop("__internal").select("o_orderkey", "price_n"), 4)


def types(spark, sf):
    """Keys in two smallint halves, which hold every int, put together again once the halves have become int."""
    key = F.col("o_custkey")
    halves = F.shiftright(key, 16).cast("smallint").alias("high"), (key.bitwiseAND(F.lit(65535)) - 32768).cast("smallint").alias("low")
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.array("o_custkey").alias("list"), *halves)
    return normalised_types(df).withColumn("small", F.shiftleft("high", 16).bitwiseOR(F.col("low") + 32768)).drop("high", "low")


def public(spark, sf):
    return public_columns(table(spark, sf, "region").withColumns({"__internal": F.lit(1), "geometry": F.lit(None).cast("binary")}))


BRANDS = "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1"
NUM = "rtrim(rtrim(printf('%.9f', {0}), '0'), '.')"

QUERIES = {
    "src1_parquet": (lambda s, d: io.parquet(s, f"{d}/region.parquet"), "SELECT * FROM region"),
    "src2_csv": (csv, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "src3_delimited": (delimited, "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "src4_json_rows": (json_rows, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "src5_geojson": (geojson, f"SELECT pt_id, 'Point' AS geometry_type, round(x, 6) AS x, round(y, 6) AS y FROM ({POINTS})"),
    "src7_area_read": (area_read, f"SELECT area_id FROM ({AREAS}) WHERE xmin <= 40 AND xmax >= -50 AND ymin <= 20 AND ymax >= -40"),
    "src8_inspect": (inspect, "SELECT f AS field, (SELECT count(*) FROM supplier) AS rows, TRUE AS area_pushdown FROM (VALUES ('area_id'), ('bbox')) t(f)"),
    "src9_named_relation": (named, "SELECT * FROM region"),
    "src10_list_tables": (listing, "SELECT 'listed_region' AS name, 'r_regionkey,r_name' AS columns"),
    "src5_geojson_areas": (geojson_areas, POLYFILL),
    "snk2_geojson_areas": (area_lines, f"SELECT area_id, 'Polygon' AS type, 2 AS rings, 10 AS points FROM ({AREAS})"),
    "src10_described_tables": (
        lambda s, d: io.described({"orders": orders_n(s, d).select("o_orderkey", "price_n", "prio_n"), "nation": table(s, d, "nation").select("n_name"), "__hidden": table(s, d, "region")}),
        f"SELECT 'orders' AS name, 'o_orderkey' AS column, 'bigint' AS type, count(*) AS rows, count(*) - count(o_orderkey) AS nulls FROM ({ORDERS_N}) UNION ALL SELECT 'orders', 'price_n', 'double', count(*), count(*) - count(price_n) FROM ({ORDERS_N}) UNION ALL SELECT 'orders', 'prio_n', 'string', count(*), count(*) - count(prio_n) FROM ({ORDERS_N}) UNION ALL SELECT 'nation', 'n_name', 'string', count(*), 0 FROM nation",
    ),
    "src11_proven_row_id": (proven_id, "SELECT 'o_orderkey' AS row_id, 'validated-unique' AS quality, count(DISTINCT o_orderkey) AS ids FROM orders"),
    "src11_made_row_id": (made_id, "SELECT count(*) AS ids, CAST(1 AS BIGINT) AS first, count(*) AS last, 'materialised' AS quality FROM lineitem"),
    "src12_cell_column": (cell_column, "SELECT 'cell' AS found, count(*) AS rows FROM orders"),
    "snk1_parquet": (round_trip("parquet"), BRANDS),
    "snk1_json": (round_trip("json"), BRANDS),
    "snk2_geojson_lines": (lines, "SELECT 'Feature' AS type, c_custkey AS pt_id, 'Point' AS geometry FROM customer"),
    "snk3_csv_wkt": (wkt, f"SELECT pt_id, 'POINT (' || {NUM.format('x')} || ' ' || {NUM.format('y')} || ')' AS geometry_wkt FROM ({POINTS})"),
    "snk3_ring_wkt": (ring_wkt, "SELECT area_id, 'POLYGON ((' || " + " || ', ' || ".join(f"{NUM.format(x)} || ' ' || {NUM.format(y)}" for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))) + f" || '))' AS geometry_wkt FROM ({AREAS})"),
    "snk4_materialise": (materialised, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "snk5_export_view": (exported, f"SELECT o_orderkey, round(price_n, 4) AS price_n FROM ({ORDERS_N}) WHERE price_n >= 200000 AND prio_n ILIKE '%high%'"),
    "prj3_subset": (lambda s, d: column_subset(table(s, d, "part").withColumn("geom", F.lit(None).cast("string")), ["p_brand", "p_partkey"]), "SELECT p_partkey, p_brand, CAST(NULL AS VARCHAR) AS geom FROM part"),
    "prj4_normalised_types": (types, "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(o_custkey AS INT) AS small FROM orders"),
    "prj5_public_columns": (public, "SELECT * FROM region"),
}
