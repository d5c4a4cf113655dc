"""Sources: Parquet, CSV, delimited text, JSON rows, GeoJSON, guarded area reads, inspection. Paths are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGE = 100_000_000


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """Text with a header: tabs if the first line has one, else commas; at least two lines that are not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    if len(lines) < 2:
        raise ValueError("a header and one row are needed")
    sep = "\t" if "\t" in lines[0].value else ","
    return spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, one object, or {data: [objects]}."""
    df = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in df.columns or not df.columns:
        raise ValueError("no JSON objects")
    if "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType):
        if not isinstance(df.schema["data"].dataType.elementType, T.StructType):
            raise ValueError("data is no array of objects")
        return df.select(F.inline("data"))
    return df


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature: properties, ``__geojson_id``, geometry type, x and y of points, the outer ring of a polygon, and all
    rings of polygons of one or several parts (holes included; inside is what an odd number of rings surrounds). A geometry
    that cannot be read, or an area without rings, is null and told by ``bad_geometry``. Line-delimited features (.geojsonl)
    are read in parallel."""
    whole = not path.rstrip("/").endswith(("geojsonl", "ndjson"))
    raw = spark.read.text(path, wholetext=whole).select(F.col("value").alias("t"))
    kind = F.get_json_object("t", "$.type")
    feature = F.when(kind == "FeatureCollection", F.from_json(F.get_json_object("t", "$.features"), "array<string>")).when(kind == "Feature", F.array("t"))
    rows = raw.select(F.explode(feature).alias("f"))
    found = spark.read.option("multiLine", whole).json(path).schema
    found = found["features"].dataType.elementType if "features" in found.names else found
    shape = found["properties"].dataType if "properties" in found.names and isinstance(found["properties"].dataType, T.StructType) else T.StructType()
    part = lambda p: F.get_json_object("f", p)
    point, ring = F.from_json(part("$.geometry.coordinates"), "array<double>"), F.from_json(part("$.geometry.coordinates[0]"), "array<array<double>>")
    place = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    parts = F.when(part("$.geometry.type") == "Polygon", F.array(F.from_json(part("$.geometry.coordinates"), "array<array<array<double>>>")))
    parts = parts.when(part("$.geometry.type") == "MultiPolygon", F.from_json(part("$.geometry.coordinates"), "array<array<array<array<double>>>>"))
    rings = F.transform(F.flatten(parts), lambda r: F.transform(r, place))
    whole_rings = (F.size(rings) > 0) & F.forall(rings, lambda r: F.coalesce((F.size(r) > 2) & F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.lit(False)))
    names = {"Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"}
    good = part("$.geometry.type").isin(*names) & (part("$.geometry.coordinates").isNotNull() | (part("$.geometry.type") == "GeometryCollection"))
    good = good & (~part("$.geometry.type").isin("Polygon", "MultiPolygon") | F.coalesce(whole_rings, F.lit(False)))
    out = rows.select(
        F.from_json(F.coalesce(part("$.properties"), F.lit("{}")), shape).alias("p"), part("$.id").alias("__geojson_id"), F.when(good, part("$.geometry.type")).alias("geometry_type"),
        F.when(part("$.geometry.type") == "Point", F.get(point, F.lit(0))).alias("x"), F.when(part("$.geometry.type") == "Point", F.get(point, F.lit(1))).alias("y"),
        F.when(good & (part("$.geometry.type") == "Polygon"), F.transform(ring, place)).alias("ring"), F.when(good, rings).alias("rings"), (part("$.geometry").isNotNull() & ~F.coalesce(good, F.lit(False))).alias("bad_geometry"),
    )
    own = [n for n in shape.names if n != "__geojson_id"]
    fid = F.col("p.__geojson_id").cast("string") if "__geojson_id" in shape.names else F.col("__geojson_id")
    return out.select(*[F.col(f"p.`{n}`") for n in own], fid.alias("__geojson_id"), "geometry_type", "x", "y", "ring", "rings", "bad_geometry")


def bbox_condition(west: float, south: float, east: float, north: float, column: str = "bbox") -> Column:
    b = lambda k: F.col(f"{column}.{k}")
    return (b("xmin") <= east) & (b("xmax") >= west) & (b("ymin") <= north) & (b("ymax") >= south)


def size_of(spark: SparkSession, path: str) -> int | None:
    """Bytes under a path by Spark's own file system; None where it cannot tell."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    try:
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    except Exception:  # noqa: BLE001 - any Java error means that the size is unknown
        return None


def read_area(spark: SparkSession, path: str, area: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a Parquet file within an area, by its ``bbox`` struct; large files need an area or a limit."""
    size = size_of(spark, path)
    if area is None and limit is None and (size is None or size > LARGE):
        raise ValueError("a large file needs an area or a limit")
    df = spark.read.parquet(path)
    geometry = [c for c in df.columns if c in ("geometry", "geom", "wkb_geometry", "bbox")]
    if not geometry:
        raise ValueError("no geometry")
    if area is not None:
        if "bbox" not in df.columns:
            raise ValueError("no bbox to filter by")
        df = df.where(bbox_condition(*area))
    if columns is not None:
        known = [c for c in columns if c in df.columns]
        if not known:
            raise ValueError("none of the columns exists")
        df = df.select(*dict.fromkeys(known + [c for c in geometry if c != "bbox"]))
    return df.limit(limit) if limit is not None else df


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(field, type, rows, area_pushdown) of a Parquet file; the count comes from its footers."""
    df = spark.read.parquet(path)
    kind = dict(df.dtypes).get("bbox", "")
    pushed = all(f"{k}:" in kind for k in ("xmin", "ymin", "xmax", "ymax"))
    rows = [F.struct(F.lit(n).alias("field"), F.lit(t).alias("type"), F.col("rows"), F.lit(pushed).alias("area_pushdown")) for n, t in df.dtypes]
    return df.agg(F.count("*").alias("rows")).select(F.inline(F.array(*rows)))


def list_tables(spark: SparkSession, hidden: tuple[str, ...] = ("__", "tmp_")) -> list[tuple[str, list[str]]]:
    return [(t.name, [c.name for c in spark.catalog.listColumns(t.name)]) for t in spark.catalog.listTables() if not t.name.startswith(hidden)]


def write(df: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    out = df.write.mode(mode)
    {"parquet": out.parquet, "json": out.json, "csv": out.option("header", True).csv}[kind](path)


def wkt_number(c: Column) -> Column:
    """Nine decimals, trailing zeros trimmed."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", c.cast("double")), "0+$", ""), "\\.$", "")


def point_wkt(x: str, y: str) -> Column:
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.concat(F.lit("POINT ("), wkt_number(F.col(x)), F.lit(" "), wkt_number(F.col(y)), F.lit(")")))


def ring_wkt(ring: str) -> Column:
    point = lambda p: F.concat(wkt_number(p["x"]), F.lit(" "), wkt_number(p["y"]))
    closed = F.concat(F.col(ring), F.slice(F.col(ring), 1, 1))
    return F.when(F.size(ring) > 0, F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, point), ", "), F.lit("))")))


def csv_with_wkt(df: DataFrame, geometry: Column, drop: list[str]) -> DataFrame:
    """Property columns as text (structs and arrays as JSON, null as empty) and ``geometry_wkt``."""
    flat = []
    for f in df.schema.fields:
        if f.name not in drop:
            c = F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name)
            flat.append(c.alias(f.name))
    return df.select(*flat, geometry.alias("geometry_wkt"))


def geojson_lines(df: DataFrame, x: str, y: str) -> DataFrame:
    """One text column with a Feature per row; write it with ``.write.text``."""
    geometry = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))
    properties = F.struct(*[c for c in df.columns if c not in (x, y)])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def geojson_areas(df: DataFrame, parts: str) -> DataFrame:
    """One text column with a Feature per row whose geometry is the column ``parts``: lists of rings (arrays of x, y, open or
    closed), the first of a part outside and the others holes. One part makes a Polygon, several a MultiPolygon; null or
    no part is a feature without geometry. The other columns are its properties."""
    closed = lambda r: F.when((F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)) & (F.size(r) > 1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    places = lambda r: F.transform(closed(r), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    coordinates = F.transform(F.col(parts), lambda part: F.transform(part, places))
    shape = F.when(F.size(parts) == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.get(coordinates, F.lit(0))), F.lit("}")))
    shape = shape.when(F.size(parts) > 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(coordinates), F.lit("}"))).otherwise("null")
    properties = F.to_json(F.struct(*[c for c in df.columns if c != parts]), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def described(tables: dict[str, DataFrame], hidden: tuple[str, ...] = ("__", "tmp_")) -> DataFrame:
    """(name, column, type, rows, nulls) of every column of the tables, of each by one aggregate; names that begin with a hidden
    prefix are left out."""
    out = None
    for name, df in tables.items():
        if name.startswith(hidden) or not df.columns:
            continue
        row = lambda i, n, t, name=name: F.struct(F.lit(name).alias("name"), F.lit(n).alias("column"), F.lit(t).alias("type"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"))
        part = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(df.columns)])
        part = part.select(F.inline(F.array(*[row(i, n, t) for i, (n, t) in enumerate(df.dtypes)])))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table to describe")
    return out


def materialise(df: DataFrame, name: str, geometry: tuple[str, ...] = ("geometry", "geom", "wkb_geometry", "ring")) -> tuple[DataFrame, str]:
    """Saved as a table; ``layer`` with geometry, else ``dataset`` with a row id."""
    from quarrylens.operators.profile import row_id

    layer = any(c in geometry for c in df.columns)
    (df if layer else row_id(df)[0]).write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name), "layer" if layer else "dataset"
