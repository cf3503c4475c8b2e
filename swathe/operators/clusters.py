"""Clusters of rasters for splits without leaks, and sweep-line pre-clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathe.operators.graph import boundary_vectors, sharing_links
from swathe.operators.join import overlap_pairs
from swathe.plans.components import components
from swathe.plans.skew import shuffled


def raster_clusters(rasters: DataFrame, edges: DataFrame, defined_by: str = "share", names: DataFrame | None = None) -> DataFrame:
    """(raster_name, cluster): cluster is the least name of the rasters that it is linked with.

    ``share``: rasters that share a vector; ``share_or_overlap``: or whose footprints meet; ``overlap``: whose footprints
    meet. ``names`` (raster_name) restricts it to some rasters.
    """
    if defined_by not in ("share", "share_or_overlap", "overlap"):
        raise ValueError(defined_by)
    rasters, edges = _named(rasters, edges, names)
    links = overlap_pairs(rasters) if defined_by == "overlap" else sharing_links(edges)
    if defined_by == "share_or_overlap":
        links = links.unionAll(overlap_pairs(rasters))
    found = components(links, "raster_a", "raster_b", few=200_000)
    rows = rasters.select("raster_name").join(shuffled(found), F.col("raster_name") == F.col("node"), "left")
    return rows.select("raster_name", F.coalesce("component", "raster_name").alias("cluster"))


def intervals(rasters: DataFrame, vectors: DataFrame, edges: DataFrame, axis: str) -> DataFrame:
    """(raster_name or null, lo, hi): extents of the rasters and of the vectors that bridge two of them."""
    lo, hi = F.col(f"min{axis}").cast("double").alias("lo"), F.col(f"max{axis}").cast("double").alias("hi")
    bridges = vectors.join(shuffled(boundary_vectors(edges).select("vector_name")), "vector_name", "left_semi")
    return rasters.select("raster_name", lo, hi).unionAll(bridges.select(F.lit(None).cast("string"), lo, hi))


def sweep(spans: DataFrame, by: list[str] | None = None, blocks: float | None = None) -> DataFrame:
    """Adds ``island``: the number of the run of touching or overlapping closed intervals, inside ``by`` if given.

    Gaps and islands over blocks of the axis: each block's interval union is found on its own, the blocks are chained by
    their greatest end in one small window with a row per block, so no task sorts all intervals.
    """
    by = by or []
    if blocks is None:
        r = spans.agg(F.count("*"), F.min("lo"), F.max("lo")).first()
        blocks = max((r[2] - r[1]) / max(r[0] / 2000, 1), 1e-9) if r[0] else 1.0
    rows = spans.withColumn("block", F.floor(F.col("lo") / F.lit(float(blocks))).cast("long"))
    tops = rows.groupBy(*by, "block").agg(F.max("hi").alias("top"))
    chain = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "block", F.max("top").over(chain).alias("before"))
    rows = rows.join(shuffled(tops), [*by, "block"])
    own = Window.partitionBy(*by, "block").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("hi").over(own), F.col("before"))
    rows = rows.withColumn("opens", (reach.isNull() | (F.col("lo") > reach)).cast("long"))
    opened = rows.groupBy(*by, "block").agg(F.sum("opens").alias("n"))
    opened = opened.select(*by, "block", F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("earlier"))
    run = Window.partitionBy(*by, "block").orderBy("lo", "hi").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal intervals together
    rows = rows.join(shuffled(opened), [*by, "block"])
    return rows.withColumn("island", F.col("earlier") + F.sum("opens").over(run)).drop("block", "before", "opens", "earlier")


def precluster(rasters: DataFrame, vectors: DataFrame, edges: DataFrame, axis: str, names: DataFrame | None = None) -> DataFrame:
    """(raster_name, island) by one axis ("x", "y"), or by both: "xy" sweeps y inside each island of x, "yx" the other way
    round, and island is then the two numbers joined by a dash. ``names`` (raster_name) restricts it to some rasters."""
    if axis not in ("x", "y", "xy", "yx"):
        raise ValueError(axis)
    rasters, edges = _named(rasters, edges, names)
    bridges = vectors.join(shuffled(boundary_vectors(edges).select("vector_name")), "vector_name", "left_semi")
    ends = [F.col(f"{end}{a}").cast("double").alias(f"{end}{a}") for a in axis for end in ("min", "max")]
    spans, by = rasters.select("raster_name", *ends).unionAll(bridges.select(F.lit(None).cast("string"), *ends)), []
    for a in axis:
        spans = sweep(spans.withColumns({"lo": F.col(f"min{a}"), "hi": F.col(f"max{a}")}), by).withColumnRenamed("island", f"island_{a}")
        by = [*by, f"island_{a}"]
    island = F.col(by[0]) if len(by) == 1 else F.concat_ws("-", *by)
    return spans.where("raster_name is not null").select("raster_name", island.alias("island"))


def _named(rasters: DataFrame, edges: DataFrame, names: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if names is None:
        return rasters, edges
    names = names.select("raster_name").distinct()
    return rasters.join(shuffled(names), "raster_name", "left_semi"), edges.join(shuffled(names), "raster_name", "left_semi")
