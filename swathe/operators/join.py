"""The spatial join: a hierarchy of grids turns overlap into equality, so that Spark can shuffle on it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from py4j.java_gateway import JavaGateway
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.functions.geometry import BOX, box_contains, box_intersects, contains, intersects
from swathe.plans.skew import shuffled, spread


#: Cells are at least 2^-PRECISION of the greatest coordinate long, so that their numbers are exact in a double.
PRECISION = 48


def _octave() -> Column:
    """Level of the smallest grid (cells of 2^level units) whose cell is at least as long as the object's box; null for points."""
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")).cast("double")
    return F.when(extent > 0, F.ceil(F.log2(extent))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def grid_levels(left: DataFrame, right: DataFrame) -> tuple[int, list[int], list[int]]:
    """(the finest level, the levels of either side): from the data, whatever their units; one aggregation of both tables.

    Points go to the finest level of what has an extent.
    """
    reach = F.greatest(*[F.abs(c) for c in BOX]).cast("double")
    both = left.select(F.lit(0).alias("side"), _octave().alias("n"), reach.alias("reach")).unionAll(right.select(F.lit(1), _octave(), reach))
    rows = both.groupBy("side", "n").agg(F.max("reach").alias("reach")).collect()  # at most the exponents of a double
    top = max((r["reach"] for r in rows), default=0.0)
    least = (math.frexp(top)[1] if top else 0) - PRECISION
    finest = max(min((r["n"] for r in rows if r["n"] is not None), default=least), least)
    return finest, *[sorted({max(finest if r["n"] is None else r["n"], finest) for r in rows if r["side"] == side}) for side in (0, 1)]


def _gridded(df: DataFrame, finest: int, others: list[int], prefix: str) -> DataFrame:
    """One row per cell that the object's box touches, at each coarser level that the other side has and, if that has objects
    that are as small, at its own: at most four a level."""
    df = df.withColumn("own", F.greatest(F.coalesce(_octave(), F.lit(finest)), F.lit(finest)))
    coarser = F.filter(F.array(*[F.lit(n) for n in others]).cast("array<int>"), lambda n: n > F.col("own"))
    own = F.when(F.col("own") >= F.lit(min(others, default=None)), F.array("own")).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("level", F.explode(F.concat(own, coarser)))
    for axis in "xy":
        lo, hi = (_cell(F.col(f"{end}{axis}"), F.col("level")) for end in ("min", "max"))
        df = df.withColumn(f"c{axis}", F.explode(F.sequence(lo, hi)))
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose closed boxes meet, columns prefixed l_ and r_; each pair once.

    Two objects meet at the coarser of their two levels, where each touches at most four cells, however large or small it
    is and whatever the unit; a pair is emitted in the cell that holds the lower left corner of what the boxes share, so no
    distinct is needed. It is one sort-merge join of two plain shuffles, whose crowded cells the adaptive planner splits. Rows
    with a null box match nothing.
    """
    left, right = (df.where(" and ".join(f"{c} is not null" for c in BOX)) for df in (left, right))
    finest, of_left, of_right = grid_levels(left, right)
    left, right = (spread(df, [df.columns[0], *BOX]) for df in (left, right))  # a name and a box: many may share either
    a, b = _gridded(left, finest, of_right, "l_"), _gridded(right, finest, of_left, "r_")
    at = F.greatest("l_own", "r_own") == F.col("l_level")
    home = F.lit(True)
    for axis in "xy":
        home = home & (_cell(F.greatest(f"l_min{axis}", f"r_min{axis}"), F.col("l_level")) == F.col(f"l_c{axis}"))
    on = (F.col("l_level") == F.col("r_level")) & (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy"))
    pairs = a.join(shuffled(b), on & at & box_intersects("l_", "r_") & home)
    return pairs.drop(*[f"{p}{c}" for p in ("l_", "r_") for c in ("own", "level", "cx", "cy")])


@lru_cache(maxsize=16)
def _built(gateway: JavaGateway, test: Callable[[Column, Column], Column], a: str, b: str) -> Column:
    return test(F.col(a), F.col(b))


def _shapes(test: Callable[[Column, Column], Column], a: str, b: str) -> Column:
    """``test`` of two columns by name. It takes thousands of calls to the JVM to build and names no table, so it is kept
    for as long as the JVM lives."""
    return _built(SparkContext._gateway, test, a, b)


def _exact(df: DataFrame, test: Callable[[], Column], box_test: Column) -> Column:
    """The exact test where either object is no box; the box test alone where both are. ``test`` is a large expression,
    so it is built only if there are shapes."""
    if "l_geom" not in df.columns or "r_geom" not in df.columns:
        return box_test
    boxes = F.coalesce(F.col("l_is_box") & F.col("r_is_box"), F.lit(False))
    return box_test & F.when(boxes, F.lit(True)).otherwise(test())


def spatial_edges(vectors: DataFrame, rasters: DataFrame) -> DataFrame:
    """(vector_name, raster_name, relation): 'contains' if the raster contains the vector, else 'intersects'.

    Filter and refine: boxes first; shapes that are no boxes are tested exactly, containment only on what intersects.
    """
    keep = [*BOX, *(["geom", "is_box"] if "geom" in vectors.columns and "geom" in rasters.columns else [])]
    pairs = box_pairs(vectors.select("vector_name", *keep), rasters.select("raster_name", *keep))
    hit = pairs.where(_exact(pairs, lambda: _shapes(intersects, "l_geom", "r_geom"), F.lit(True)))
    inside = _exact(pairs, lambda: _shapes(contains, "r_geom", "l_geom"), box_contains("r_", "l_"))
    return hit.select(F.col("l_vector_name").alias("vector_name"), F.col("r_raster_name").alias("raster_name"), F.when(inside, "contains").otherwise("intersects").alias("relation"))


def overlap_pairs(rasters: DataFrame) -> DataFrame:
    """(raster_a, raster_b), a before b by name: rasters whose footprints meet."""
    keep = ["raster_name", *BOX, *(["geom", "is_box"] if "geom" in rasters.columns else [])]
    pairs = box_pairs(rasters.select(*keep), rasters.select(*keep)).where("l_raster_name < r_raster_name")
    hit = pairs.where(_exact(pairs, lambda: _shapes(intersects, "l_geom", "r_geom"), F.lit(True)))
    return hit.select(F.col("l_raster_name").alias("raster_a"), F.col("r_raster_name").alias("raster_b"))
