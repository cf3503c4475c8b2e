"""Rasterising vectors to pixel labels: pixel centres, exploding only the pixels of each vector's box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.functions.geometry import inside
from swathe.operators.classes import PREFIX
from swathe.plans.skew import shuffled


def covered_pixels(edges: DataFrame, vectors: DataFrame, rasters: DataFrame) -> DataFrame:
    """(raster_name, vector_name, row, col): pixels of a raster whose centre lies in the vector.

    ``rasters`` has width, height and a north-up affine (a, c, e, f). A centre on the edge of a box belongs to the box that
    begins there. Shapes that are no boxes are tested exactly.
    """
    shape = ["geom", "is_box"] if "geom" in vectors.columns else []
    v = vectors.select("vector_name", *[F.col(c).cast("double").alias(f"v_{c}") for c in ("minx", "miny", "maxx", "maxy")], *shape)
    df = edges.select("vector_name", "raster_name").join(shuffled(v), "vector_name").join(shuffled(rasters.select("raster_name", "width", "height", "a", "c", "e", "f")), "raster_name")
    col0 = F.greatest(F.ceil((F.col("v_minx") - F.col("c")) / F.col("a") - 0.5), F.lit(0)).cast("long")
    col1 = F.least(F.ceil((F.col("v_maxx") - F.col("c")) / F.col("a") - 0.5).cast("long"), F.col("width")) - 1
    row0 = F.greatest(F.ceil((F.col("v_maxy") - F.col("f")) / F.col("e") - 0.5), F.lit(0)).cast("long")
    row1 = F.least(F.ceil((F.col("v_miny") - F.col("f")) / F.col("e") - 0.5).cast("long"), F.col("height")) - 1
    df = df.withColumns({"c0": col0, "c1": col1, "r0": row0, "r1": row1}).where("c0 <= c1 and r0 <= r1")
    df = df.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    if shape:
        centre = F.struct((F.col("c") + (F.col("col") + 0.5) * F.col("a")).alias("x"), (F.col("f") + (F.col("row") + 0.5) * F.col("e")).alias("y"))
        df = df.where(F.when(F.coalesce("is_box", F.lit(False)), F.lit(True)).otherwise(inside(centre, F.col("geom"))))
    return df.select("raster_name", "vector_name", "row", "col")


def check_types(vectors: DataFrame, classes: Sequence[str]) -> None:
    bad = vectors.where(~F.coalesce(F.col("type").isin(*classes), F.lit(False))).select("type").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"classes that the dataset doesn't have: {[r[0] for r in bad]}")


def label_categorical(edges: DataFrame, vectors: DataFrame, rasters: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(raster_name, row, col, label): the greatest place (from 1) in ``classes`` over the vectors of a pixel.

    Pixels that aren't there are background, 0; vectors of other classes (the background) burn nothing.
    """
    order = F.create_map(*[F.lit(x) for k, c in enumerate(classes, 1) for x in (c, k)])
    kinds = vectors.select("vector_name", F.try_element_at(order, F.col("type")).alias("label")).where("label is not null")
    pixels = covered_pixels(edges, vectors, rasters).join(shuffled(kinds), "vector_name")
    return pixels.groupBy("raster_name", "row", "col").agg(F.max("label").alias("label"))


def label_soft(edges: DataFrame, vectors: DataFrame, rasters: DataFrame, classes: Sequence[str], background: bool = True) -> DataFrame:
    """(raster_name, row, col, one column per class[, background]): the probabilities of the pixel's last vector by name.

    ``background`` is one minus the sum of the others; pixels that aren't there are all background.
    """
    probs = [F.col(f"`{PREFIX}{c}`") for c in classes]
    missing = [c for c in classes if f"{PREFIX}{c}" not in vectors.columns]
    if missing:
        raise ValueError(f"no probabilities for {missing}")
    v = vectors.select("vector_name", F.struct(*[p.cast("double").alias(c) for p, c in zip(probs, classes)]).alias("p"))
    pixels = covered_pixels(edges, vectors, rasters).join(shuffled(v), "vector_name")
    last = pixels.groupBy("raster_name", "row", "col").agg(F.max_by("p", "vector_name").alias("p"))
    out = last.select("raster_name", "row", "col", *[F.col("p")[c].alias(f"{PREFIX}{c}") for c in classes])
    rest = F.lit(1.0) - sum((F.col(f"`{PREFIX}{c}`") for c in classes), F.lit(0.0))
    return out.withColumn("background", rest) if background else out


def without_labels(rasters: DataFrame, labelled: DataFrame) -> DataFrame:
    return rasters.select("raster_name").join(shuffled(labelled.select("raster_name")), "raster_name", "left_anti")


def dense(pixels: DataFrame, rasters: DataFrame, columns: Sequence[str], fill: float = 0) -> DataFrame:
    """One array per raster row instead of sparse pixels: (raster_name, row, one array of ``width`` values per column)."""
    rows = rasters.select("raster_name", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row"))
    cells = pixels.groupBy("raster_name", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])))).alias("m"))
    df = rows.join(shuffled(cells), ["raster_name", "row"], "left")

    def line(c: str):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i)[c], F.lit(fill))).alias(c)

    return df.select("raster_name", "row", *[line(c) for c in columns])
