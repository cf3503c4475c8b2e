"""GeoJSON, the adjacency file and KML: reading with from_json, writing as distributed text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.functions.geometry import with_bounds

#: Depth of the coordinates of each kind of geometry.
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
_FEATURE = "struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>"


def _shape(kind: Column, text: Column) -> Column:
    """Parts, rings and points from the text of the coordinates; a third coordinate is dropped."""

    def parse(depth: int) -> Column:
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    ring = lambda r: F.transform(r, point)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(point(parse(1))))))
        .when(kind == "MultiPoint", F.transform(parse(2), lambda p: F.array(F.array(point(p)))))
        .when(kind == "LineString", F.array(F.array(ring(parse(2)))))
        .when(kind == "MultiLineString", F.transform(parse(3), lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(parse(3), ring)))
        .when(kind == "MultiPolygon", F.transform(parse(4), lambda part: F.transform(part, ring)))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts")))


def read_geojson(spark: SparkSession, path: str, key: str, columns: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    """One row per feature: ``key``, geom, bounds and properties.

    ``lines``: one feature a line, which Spark splits over tasks; else each file is one collection, read whole. ``columns``
    gives names and types of the properties; without it all that occur are strings. The key is the property of that name,
    or the feature's id. Unknown kinds of geometry and missing ones are null.
    """
    text = spark.read.text(path, wholetext=not lines).where("trim(value) <> ''")
    if lines:
        rows = text.select(F.from_json("value", _FEATURE).alias("f"))
    else:
        rows = text.select(F.explode(F.from_json("value", f"struct<features:array<{_FEATURE}>>")["features"]).alias("f"))
    rows = rows.select("f.*").withColumn("p", F.from_json("properties", "map<string,string>"))
    if columns is None:
        columns = {r[0]: "string" for r in rows.select(F.explode(F.map_keys("p"))).distinct().orderBy("col").collect()}
    named = [F.try_element_at("p", F.lit(c)).cast(t).alias(c) for c, t in columns.items() if c != key]
    shape = _shape(F.col("geometry.type"), F.col("geometry.coordinates"))
    name = F.coalesce(F.try_element_at("p", F.lit(key)), F.col("id"))
    return with_bounds(rows.select(name.alias(key), shape.alias("geom"), *named))


def geometry_json(shape: Column) -> Column:
    """The GeoJSON object of a shape, as text."""
    kind, parts = shape["kind"], shape["parts"]
    point = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, point)
    first = F.get(parts, 0)
    text = (
        F.when(kind == "Point", F.to_json(point(F.get(F.get(first, 0), 0))))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: point(F.get(F.get(p, 0), 0)))))
        .when(kind == "LineString", F.to_json(ring(F.get(first, 0))))
        .when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: ring(F.get(p, 0)))))
        .when(kind == "Polygon", F.to_json(F.transform(first, ring)))
        .when(kind == "MultiPolygon", F.to_json(F.transform(parts, lambda p: F.transform(p, ring))))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}"))


def feature_lines(df: DataFrame, key: str) -> DataFrame:
    """(value): one GeoJSON feature per row; bounds are left out, null properties too."""
    props = [c for c in df.columns if c not in ("geom", "minx", "miny", "maxx", "maxy", "is_box")]
    body = F.concat(
        F.lit('{"type":"Feature","id":'), F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2),
        F.lit(',"properties":'), F.to_json(F.struct(*props)), F.lit(',"geometry":'), F.coalesce(geometry_json(F.col("geom")), F.lit("null")), F.lit("}"),
    )
    return df.select(body.alias("value"))


def write_geojson(df: DataFrame, path: str, key: str) -> None:
    """Features as lines, one file per task, anywhere Spark writes."""
    feature_lines(df, key).write.mode("overwrite").text(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Edges from a JSON object {vectors: {name: {raster: relation}}, rasters: {...}}; both sides must agree."""
    side = "map<string,map<string,string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<vectors:{side},rasters:{side}>").alias("g"))
    if text.where("g.vectors is null or g.rasters is null").count():
        raise ValueError("an adjacency file has the two sides vectors and rasters")

    def edges(field: str, outer: str, inner: str) -> DataFrame:
        rows = text.select(F.explode(f"g.{field}").alias(outer, "near")).select(outer, F.explode("near").alias(inner, "relation"))
        return rows.select("vector_name", "raster_name", "relation")

    a, b = edges("vectors", "vector_name", "raster_name"), edges("rasters", "raster_name", "vector_name")
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError("the two sides of the adjacency differ")
    return a


def adjacency_lines(vectors: DataFrame, rasters: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, name, value): each vertex with the JSON object of its neighbours; {} for one without."""

    def side(name: str, table: DataFrame, key: str, other: str) -> DataFrame:
        near = edges.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(other, "relation"))))).alias("value"))
        return table.select(key).join(near, key, "left").select(F.lit(name).alias("side"), F.col(key).alias("name"), F.coalesce("value", F.lit("{}")).alias("value"))

    return side("vectors", vectors, "vector_name", "raster_name").unionAll(side("rasters", rasters, "raster_name", "vector_name"))


def adjacency_text(vectors: DataFrame, rasters: DataFrame, edges: DataFrame) -> str:
    """The whole adjacency as one JSON text on the driver: an export for small datasets."""
    out: dict = {"vectors": {}, "rasters": {}}
    for side, name, value in adjacency_lines(vectors, rasters, edges).toLocalIterator():
        out[side][name] = json.loads(value)
    return json.dumps(out, sort_keys=True)


def kml_placemarks(df: DataFrame, name: str, description: str | None = None) -> DataFrame:
    """(value): a KML placemark for each row with an areal shape, or for its box where it has no shape."""

    def safe(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def ring(r: Column) -> Column:
        return F.array_join(F.transform(r, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")

    def border(tag: str, r: Column) -> Column:
        return F.concat(F.lit(f"<{tag}><LinearRing><coordinates>"), ring(r), F.lit(f"</coordinates></LinearRing></{tag}>"))

    def polygon(part: Column) -> Column:
        holes = F.array_join(F.transform(F.slice(part, 2, 1 << 20), lambda r: border("innerBoundaryIs", r)), "")
        return F.concat(F.lit("<Polygon>"), border("outerBoundaryIs", F.get(part, 0)), holes, F.lit("</Polygon>"))

    body = F.concat(F.lit("<MultiGeometry>"), F.array_join(F.transform(F.col("geom")["parts"], polygon), ""), F.lit("</MultiGeometry>"))
    about = F.lit("") if description is None else safe(F.col(description))
    return df.select(F.concat(F.lit("<Placemark><name>"), safe(F.col(name)), F.lit("</name><description>"), about, F.lit("</description>"), body, F.lit("</Placemark>")).alias("value"))
