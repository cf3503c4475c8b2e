"""One query per operator over tables derived from ``part`` (vectors) and ``customer`` (rasters), with its SQL.

All geometry is arithmetic on integers, so that another engine gets the same boxes; every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.functions.geometry import BOX as BOX_COLUMNS
from swathe.functions.geometry import box_shape
from swathe.operators import classes, clusters, derive, graph, labels, planning, windows
from swathe.operators.dataset import SpatialDataset, batch_problems, count_containing, missing_vectors, needing_relabel
from swathe.operators.join import overlap_pairs, spatial_edges
from swathe.plans.skew import shuffled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size", "p_type")
    v = part.selectExpr(
        "p_partkey AS vid", "concat('v', CAST(p_partkey AS STRING)) AS vector_name", "p_brand AS type", "p_type AS kind", "p_size AS size",
        "CAST((p_partkey % 50) * 40 + (p_partkey * 13) % 37 AS BIGINT) AS minx", "CAST((p_partkey div 50) * 40 + (p_partkey * 29) % 31 AS BIGINT) AS miny",
        "CAST(2 + p_size % 11 AS BIGINT) AS w", "CAST(2 + (p_partkey * 3) % 9 AS BIGINT) AS h",
    )
    return v.select("*", (F.col("minx") + F.col("w")).alias("maxx"), (F.col("miny") + F.col("h")).alias("maxy")).drop("w", "h")


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    r = customer.selectExpr(
        "c_custkey AS rid", "concat('r', CAST(c_custkey AS STRING), '.tif') AS raster_name", "c_acctbal AS score", "c_mktsegment AS segment",
        "CAST((c_custkey % 50) * 40 + (c_custkey * 7) % 23 AS BIGINT) AS minx", "CAST((c_custkey div 50) * 40 + (c_custkey * 11) % 19 AS BIGINT) AS miny",
        "CAST(20 + c_custkey % 27 AS BIGINT) AS w", "CAST(20 + (c_custkey * 5) % 21 AS BIGINT) AS h",
    )
    return r.select("*", (F.col("minx") + F.col("w")).alias("maxx"), (F.col("miny") + F.col("h")).alias("maxy")).drop("w", "h")


def dataset(spark: SparkSession, sf: str) -> SpatialDataset:
    return SpatialDataset.of(vectors(spark, sf), rasters(spark, sf))


BASE = """
v AS (SELECT *, minx + w AS maxx, miny + h AS maxy FROM (SELECT p_partkey AS vid, concat('v', CAST(p_partkey AS VARCHAR)) AS vector_name, p_brand AS type, p_type AS kind,
    p_size AS size, CAST((p_partkey % 50) * 40 + (p_partkey * 13) % 37 AS BIGINT) AS minx, CAST((p_partkey // 50) * 40 + (p_partkey * 29) % 31 AS BIGINT) AS miny,
    CAST(2 + p_size % 11 AS BIGINT) AS w, CAST(2 + (p_partkey * 3) % 9 AS BIGINT) AS h FROM part)),
r AS (SELECT *, minx + w AS maxx, miny + h AS maxy FROM (SELECT c_custkey AS rid, concat('r', CAST(c_custkey AS VARCHAR), '.tif') AS raster_name, c_acctbal AS score,
    c_mktsegment AS segment, CAST((c_custkey % 50) * 40 + (c_custkey * 7) % 23 AS BIGINT) AS minx, CAST((c_custkey // 50) * 40 + (c_custkey * 11) % 19 AS BIGINT) AS miny,
    CAST(20 + c_custkey % 27 AS BIGINT) AS w, CAST(20 + (c_custkey * 5) % 21 AS BIGINT) AS h FROM customer)),
e AS (SELECT vector_name, raster_name, CASE WHEN r.minx <= v.minx AND v.maxx <= r.maxx AND r.miny <= v.miny AND v.maxy <= r.maxy THEN 'contains' ELSE 'intersects' END AS relation
    FROM v JOIN r ON v.minx <= r.maxx AND v.maxx >= r.minx AND v.miny <= r.maxy AND v.maxy >= r.miny),
n AS (SELECT v.vector_name, count(e.raster_name) AS raster_count FROM v LEFT JOIN e ON e.vector_name = v.vector_name AND relation = 'contains' GROUP BY 1)
"""


def query(sql: str | None, recursive: bool = False):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{sql}"
        return f

    return add


# -- join, counts, lookups ------------------------------------------------------------------------------------------------


@query("SELECT * FROM e")
def spatial_join_edges(spark, sf):
    return spatial_edges(vectors(spark, sf), rasters(spark, sf))


@query("SELECT * FROM e")
def spatial_join_degrees(spark, sf):
    """The same boxes around one place in degrees, a thousandth of the size."""
    small = [t.withColumns({c: F.col(c) / 1000 + at for c, at in (("minx", 13), ("maxx", 13), ("miny", 52), ("maxy", 52))}) for t in (vectors(spark, sf), rasters(spark, sf))]
    return spatial_edges(*small)


_CORNER = "(greatest(v.minx, r.minx) - r.minx) * r.h + (greatest(v.miny, r.miny) - r.miny) * r.w <= r.w * r.h"


@query(
    f"""SELECT vector_name, raster_name, CASE WHEN r.minx <= v.minx AND r.miny <= v.miny AND (v.maxx - r.minx) * r.h + (v.maxy - r.miny) * r.w <= r.w * r.h
    THEN 'contains' ELSE 'intersects' END AS relation
FROM v JOIN r ON v.minx <= r.maxx AND v.maxx >= r.minx AND v.miny <= r.maxy AND v.maxy >= r.miny AND {_CORNER}"""
)
def spatial_join_triangles(spark, sf):
    """Boxes and footprints that are right triangles: the lower left halves of the rasters' boxes."""
    v, r = vectors(spark, sf), rasters(spark, sf)
    v = v.withColumns({"geom": box_shape(*[F.col(c) for c in BOX_COLUMNS]), "is_box": F.lit(True)})
    corners = [("minx", "miny"), ("maxx", "miny"), ("minx", "maxy"), ("minx", "miny")]
    ring = F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in corners])
    r = r.withColumns({"geom": F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("parts")), "is_box": F.lit(False)})
    return spatial_edges(v, r)


@query("SELECT vector_name, raster_count FROM n")
def raster_count(spark, sf):
    return dataset(spark, sf).vectors.select("vector_name", "raster_count")


@query("SELECT vector_name, raster_count > 0 AS has_raster FROM n")
def vectors_with_raster(spark, sf):
    return dataset(spark, sf).has_raster()


@query("SELECT raster_name, minx, miny, maxx, maxy FROM r")
def raster_footprint(spark, sf):
    return rasters(spark, sf).select("raster_name", "minx", "miny", "maxx", "maxy")


@query("SELECT DISTINCT raster_name FROM e JOIN v USING (vector_name) WHERE kind = 'PROMO'")
def rasters_intersecting_vector(spark, sf):
    return dataset(spark, sf).rasters_intersecting_vector(vectors(spark, sf).where("kind = 'PROMO'"))


@query("SELECT raster_name FROM e JOIN v USING (vector_name) WHERE kind = 'PROMO'")
def rasters_intersecting_vector_bag(spark, sf):
    return dataset(spark, sf).rasters_intersecting_vector(vectors(spark, sf).where("kind = 'PROMO'"), distinct=False)


@query("SELECT DISTINCT raster_name FROM e JOIN v USING (vector_name) WHERE kind = 'SMALL' AND relation = 'contains'")
def rasters_containing_vector(spark, sf):
    return dataset(spark, sf).rasters_containing_vector(vectors(spark, sf).where("kind = 'SMALL'"))


@query("SELECT DISTINCT vector_name FROM e JOIN r USING (raster_name) WHERE segment = 'BUILDING'")
def vectors_intersecting_raster(spark, sf):
    return dataset(spark, sf).vectors_intersecting_raster(rasters(spark, sf).where("segment = 'BUILDING'"))


@query("SELECT DISTINCT vector_name FROM e JOIN r USING (raster_name) WHERE segment = 'MACHINERY' AND relation = 'contains'")
def vectors_contained_in_raster(spark, sf):
    return dataset(spark, sf).vectors_contained_in_raster(rasters(spark, sf).where("segment = 'MACHINERY'"))


@query(
    "SELECT v.vector_name, r.raster_name, relation IS NOT NULL AS intersects, coalesce(relation = 'contains', false) AS contains FROM v JOIN r ON v.vid = r.rid "
    "LEFT JOIN e ON e.vector_name = v.vector_name AND e.raster_name = r.raster_name"
)
def pair_relation_lookup(spark, sf):
    pairs = vectors(spark, sf).select("vid", "vector_name").join(shuffled(rasters(spark, sf).select(F.col("rid").alias("vid"), "raster_name")), "vid")
    return dataset(spark, sf).pair_relations(pairs.drop("vid"))


@query("SELECT vector_name, raster_count FROM n WHERE raster_count < 2")
def vectors_missing_rasters(spark, sf):
    from swathe.operators.dataset import missing_rasters

    return dataset(spark, sf).vectors.where(missing_rasters(2)).select("vector_name", "raster_count")


@query("SELECT vector_name, type, raster_count FROM n JOIN v USING (vector_name) WHERE size > 25 AND raster_count >= 1")
def vector_row_condition(spark, sf):
    return dataset(spark, sf).vectors.where("size > 25 AND raster_count >= 1").select("vector_name", "type", "raster_count")


@query("SELECT raster_name, score FROM r WHERE score > 0 AND segment <> 'FURNITURE'")
def raster_row_condition(spark, sf):
    return rasters(spark, sf).where("score > 0 AND segment <> 'FURNITURE'").select("raster_name", "score")


@query(
    "SELECT raster_name, n_contained FROM r JOIN (SELECT raster_name, count(*) AS n_contained FROM e WHERE relation = 'contains' GROUP BY 1) AS c USING (raster_name) "
    "WHERE score BETWEEN 1000 AND 8000 AND n_contained >= 2"
)
def raster_composite_predicate(spark, sf):
    d = dataset(spark, sf)
    held = d.edges.where("relation = 'contains'").groupBy("raster_name").agg(F.count("*").alias("n_contained")).where("n_contained >= 2")
    return d.rasters.where("score BETWEEN 1000 AND 8000").join(shuffled(held), "raster_name").select("raster_name", "n_contained")


# -- changes ----------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM e")
def add_vectors_delta(spark, sf):
    v = vectors(spark, sf)
    return SpatialDataset.of(v.where("kind <> 'LARGE'"), rasters(spark, sf)).add_vectors(v.where("kind = 'LARGE'"), check=False).edges


@query("SELECT vector_name, raster_count FROM n")
def add_rasters_delta(spark, sf):
    r = rasters(spark, sf)
    d = SpatialDataset.of(vectors(spark, sf), r.where("segment <> 'HOUSEHOLD'")).add_rasters(r.where("segment = 'HOUSEHOLD'"), check=False)
    return d.vectors.select("vector_name", "raster_count")


@query("SELECT e.* FROM e JOIN v USING (vector_name) WHERE size <= 40")
def drop_vectors_edges(spark, sf):
    return dataset(spark, sf).drop_vectors(vectors(spark, sf).where("size > 40")).edges


@query("SELECT e.* FROM e JOIN r USING (raster_name) WHERE score >= 0")
def drop_rasters_edges(spark, sf):
    return dataset(spark, sf).drop_rasters(rasters(spark, sf).where("score < 0")).edges.select("vector_name", "raster_name", "relation")


@query("SELECT v.vector_name, count(k.raster_name) AS raster_count FROM v LEFT JOIN (SELECT e.* FROM e JOIN r USING (raster_name) WHERE score >= 0 AND relation = 'contains') AS k USING (vector_name) GROUP BY 1")
def drop_rasters_counts(spark, sf):
    return dataset(spark, sf).drop_rasters(rasters(spark, sf).where("score < 0")).vectors.select("vector_name", "raster_count")


@query(
    """SELECT DISTINCT 'edge without raster' AS kind, raster_name AS name FROM e JOIN r USING (raster_name) WHERE segment = 'BUILDING'
UNION ALL SELECT DISTINCT 'edge without vector', vector_name FROM e JOIN v USING (vector_name) WHERE kind = 'PROMO'
UNION ALL SELECT DISTINCT 'edge twice', vector_name FROM e JOIN v USING (vector_name) WHERE relation = 'intersects' AND size = 9
UNION ALL SELECT 'wrong count', vector_name FROM v WHERE size = 7 AND kind <> 'PROMO'"""
)
def graph_invariant_violations(spark, sf):
    """A dataset that has lost rasters and vectors, has edges twice and counts that are off by one."""
    d = dataset(spark, sf)
    twice = d.edges.where("relation = 'intersects'").join(shuffled(d.vectors.where("size = 9").select("vector_name")), "vector_name", "left_semi")
    v = d.vectors.where("kind <> 'PROMO'").withColumn("raster_count", F.when(F.col("size") == 7, F.col("raster_count") + 1).otherwise(F.col("raster_count")))
    return SpatialDataset(v, d.rasters.where("segment <> 'BUILDING'"), d.edges.unionByName(twice)).invariant_violations()


@query("SELECT raster_count, count(*) AS n_vectors FROM n GROUP BY 1")
def raster_count_histogram(spark, sf):
    return dataset(spark, sf).vectors.groupBy("raster_count").agg(F.count("*").alias("n_vectors"))


@query("SELECT raster_name, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, raster_name LIMIT 10")
def top_rasters_by_degree(spark, sf):
    return graph.degrees(dataset(spark, sf).edges, "raster_name").orderBy(F.col("degree").desc(), "raster_name").limit(10)


@query("SELECT vector_name FROM v WHERE size > 40 OR kind = 'PROMO'")
def missing_vectors_to_target(spark, sf):
    """What a target lacks that was made from part of the source and lost some of it."""
    v = vectors(spark, sf)
    target = SpatialDataset.of(v.where("kind <> 'PROMO'"), rasters(spark, sf)).drop_vectors(v.where("size > 40"))
    return missing_vectors(v, target.vectors).select("vector_name")


@query("SELECT DISTINCT raster_name FROM e JOIN v USING (vector_name) JOIN r USING (raster_name) WHERE kind = 'ECONOMY' AND segment <> 'FURNITURE'")
def rasters_needing_relabel(spark, sf):
    d = dataset(spark, sf)
    return needing_relabel(d.edges, d.vectors.where("kind = 'ECONOMY'"), d.rasters.where("segment <> 'FURNITURE'"))


@query("SELECT e.* FROM e JOIN v USING (vector_name) JOIN r USING (raster_name) WHERE (size <= 35 OR size >= 20) AND (score >= 0 OR segment <> 'BUILDING')")
def merge_datasets(spark, sf):
    v, r = vectors(spark, sf), rasters(spark, sf)
    a = SpatialDataset.of(v.where("size <= 35"), r.where("score >= 0"))
    return a.merge(SpatialDataset.of(v.where("size >= 20"), r.where("segment <> 'BUILDING'"))).edges


@query(
    """SELECT name, CASE WHEN n > 1 THEN 'appear twice' ELSE 'are in the dataset already' END AS problem
FROM (SELECT concat('v', CAST(vid // 2 AS VARCHAR)) AS name, count(*) AS n FROM v WHERE size <= 25 GROUP BY 1)
WHERE n > 1 OR name IN (SELECT vector_name FROM v WHERE size > 25)"""
)
def duplicate_ids(spark, sf):
    """The check of a batch whose ids are half the numbers, against a table of other vectors."""
    v = vectors(spark, sf)
    batch = v.where("size <= 25").withColumn("vector_name", F.expr("concat('v', CAST(vid div 2 AS STRING))"))
    return batch_problems(batch, v.where("size > 25"), "vector_name")


@query("SELECT vector_name, count(*) AS degree FROM e GROUP BY 1")
def vertex_degrees(spark, sf):
    return graph.degrees(dataset(spark, sf).edges, "vector_name")


@query("SELECT e.* FROM e JOIN v USING (vector_name) JOIN r USING (raster_name) WHERE NOT (kind = 'PROMO' AND segment = 'BUILDING')")
def delete_edges(spark, sf):
    d = dataset(spark, sf)
    gone = d.edges.join(shuffled(d.vectors.where("kind = 'PROMO'").select("vector_name")), "vector_name", "left_semi")
    return graph.delete_edges(d.edges, gone.join(shuffled(d.rasters.where("segment = 'BUILDING'").select("raster_name")), "raster_name", "left_semi"))


@query("SELECT vector_name, raster_name, CASE WHEN relation = 'contains' THEN 'intersects' ELSE 'contains' END AS relation FROM e")
def overwrite_edges(spark, sf):
    """Adding edges that exist with force replaces their data."""
    edges = dataset(spark, sf).edges
    swapped = edges.select("vector_name", "raster_name", F.when(F.col("relation") == "contains", "intersects").otherwise("contains").alias("relation"))
    return graph.add_edges(edges, swapped, force=True)


# -- clusters ---------------------------------------------------------------------------------------------------------------

_OVERLAP = "SELECT a.raster_name AS raster_a, b.raster_name AS raster_b FROM r AS a JOIN r AS b ON a.raster_name < b.raster_name AND a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny"
_SHARE = "SELECT DISTINCT a.raster_name AS raster_a, b.raster_name AS raster_b FROM e AS a JOIN e AS b ON a.vector_name = b.vector_name AND a.raster_name < b.raster_name"
_CLUSTERS = """, links AS ({}), both_ways AS (SELECT raster_a AS a, raster_b AS b FROM links UNION ALL SELECT raster_b, raster_a FROM links),
walk AS (SELECT raster_name AS a, raster_name AS b FROM r UNION SELECT walk.a, both_ways.b FROM walk JOIN both_ways ON walk.b = both_ways.a)
SELECT a AS raster_name, min(b) AS cluster FROM walk GROUP BY 1"""


@query(_OVERLAP)
def raster_overlap_pairs(spark, sf):
    return overlap_pairs(rasters(spark, sf))


@query(_SHARE)
def raster_share_pairs(spark, sf):
    return graph.sharing_pairs(dataset(spark, sf).edges)


@query("SELECT vector_name, count(*) AS n_boundary FROM e WHERE relation = 'intersects' GROUP BY 1 HAVING count(*) >= 2")
def boundary_vectors(spark, sf):
    return graph.boundary_vectors(dataset(spark, sf).edges)


def _precluster(spark, sf, axis):
    d = dataset(spark, sf)
    return clusters.precluster(d.rasters, d.vectors, d.edges, axis)


for _axis in "xy":
    QUERIES[f"precluster_{_axis}_axis"] = partial(_precluster, axis=_axis)
    SQL[f"precluster_{_axis}_axis"] = f"""WITH {BASE}, b AS (SELECT vector_name FROM e WHERE relation = 'intersects' GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT raster_name, min{_axis} AS lo, max{_axis} AS hi FROM r UNION ALL SELECT NULL, min{_axis}, max{_axis} FROM v WHERE vector_name IN (SELECT vector_name FROM b)),
m AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT raster_name, CAST(sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
SELECT raster_name, island FROM i WHERE raster_name IS NOT NULL"""


@query(_CLUSTERS.format(_SHARE), recursive=True)
def raster_clusters_share(spark, sf):
    d = dataset(spark, sf)
    return clusters.raster_clusters(d.rasters, d.edges, "share")


@query(_CLUSTERS.format(f"{_SHARE} UNION {_OVERLAP}"), recursive=True)
def raster_clusters_share_or_overlap(spark, sf):
    d = dataset(spark, sf)
    return clusters.raster_clusters(d.rasters, d.edges, "share_or_overlap")


# -- windows ----------------------------------------------------------------------------------------------------------------

_GRID = """, g AS (SELECT concat('r', CAST(rid AS VARCHAR), '_', CAST(j AS VARCHAR), '_', CAST(i AS VARCHAR), '.tif') AS new_name, raster_name, i * 8 AS col_off, j * 8 AS row_off,
    CAST(minx + i * 8 AS DOUBLE) AS minx, CAST(maxy - j * 8 - 8 AS DOUBLE) AS miny, CAST(minx + i * 8 + 8 AS DOUBLE) AS maxx, CAST(maxy - j * 8 AS DOUBLE) AS maxy
    FROM (SELECT *, unnest(range((maxx - minx) // 8)) AS i FROM r) AS a, range(6) AS t(j) WHERE j < (a.maxy - a.miny) // 8)"""
_WINDOW = ["vector_name", "raster_name", "new_name", "col_off", "row_off", "w", "h", "minx", "miny", "maxx", "maxy"]


def _around_sql(w: str, h: str, col0: str, row0: str) -> str:
    return f""", p AS (SELECT e.vector_name, e.raster_name, rid, r.minx AS c, r.maxy AS f, r.maxx - r.minx AS width, r.maxy - r.miny AS height,
    greatest(v.minx, r.minx) AS bx0, least(v.maxx, r.maxx) AS bx1, greatest(v.miny, r.miny) AS by0, least(v.maxy, r.maxy) AS by1 FROM e JOIN v USING (vector_name) JOIN r USING (raster_name)),
q AS (SELECT *, bx0 - c AS min_col, bx1 - c AS max_col, f - by1 AS min_row, f - by0 AS max_row, CAST(floor((bx0 + bx1) / 2.0 - c) AS BIGINT) AS mid_col,
    CAST(floor(f - (by0 + by1) / 2.0) AS BIGINT) AS mid_row FROM p),
s AS (SELECT *, {w} AS w, {h} AS h FROM q),
k AS (SELECT *, CAST(ceil((max_col - min_col) / CAST(w AS DOUBLE)) AS BIGINT) AS n_cols, CAST(ceil((max_row - min_row) / CAST(h AS DOUBLE)) AS BIGINT) AS n_rows FROM s),
o AS (SELECT *, {col0} AS col0, {row0} AS row0 FROM k),
i AS (SELECT *, unnest(range(n_rows)) AS i FROM o), j AS (SELECT *, unnest(range(n_cols)) AS j FROM i),
x AS (SELECT *, col0 + j * w AS col_off, row0 + i * h AS row_off, CAST(c + col0 + j * w AS DOUBLE) AS minx, CAST(f - row0 - i * h AS DOUBLE) AS maxy,
    concat('r', CAST(rid AS VARCHAR), '_', vector_name, CASE WHEN n_rows * n_cols = 1 THEN '' ELSE concat('_', CAST(i AS VARCHAR), '_', CAST(j AS VARCHAR)) END, '.tif') AS new_name FROM j)
SELECT vector_name, raster_name, new_name, col_off, row_off, w, h, minx, maxy - h AS miny, minx + w AS maxx, maxy FROM x
WHERE minx <= bx1 AND minx + w >= bx0 AND maxy - h <= by1 AND maxy >= by0"""


def _draw(axis: str) -> str:
    lo, hi = f"greatest(0, max_{axis} - {{0}} * n_{axis}s)", f"least(min_{axis}, {{1}} - {{0}} * n_{axis}s)"
    text = f"{lo} + CAST('0x' || substr(md5('10|{axis}|' || vector_name || '|' || raster_name), 1, 8) AS BIGINT) % greatest({hi} - {lo} + 1, 1)"
    return text.format(*(("w", "width") if axis == "col" else ("h", "height")))


_MID = ("mid_col - (w * n_cols) // 2", "mid_row - (h * n_rows) // 2")


@query(_GRID + "SELECT new_name, raster_name, col_off, row_off, minx, miny, maxx, maxy FROM g")
def grid_windows(spark, sf):
    found = windows.footprint(windows.grid_windows(windows.with_pixels(rasters(spark, sf)), 8, 8))
    return found.select("new_name", "raster_name", "col_off", "row_off", "minx", "miny", "maxx", "maxy")


@query(
    """, p AS (SELECT vector_name, raster_name, rid, v.minx - r.minx AS c0, v.maxx - r.minx AS c1, r.maxy - v.maxy AS r0, r.maxy - v.miny AS r1,
    row_number() OVER (PARTITION BY raster_name ORDER BY vector_name) - 1 AS i FROM e JOIN v USING (vector_name) JOIN r USING (raster_name) WHERE relation = 'contains')
SELECT vector_name, raster_name, concat('r', CAST(rid AS VARCHAR), '_', CAST(i AS VARCHAR), '.tif') AS new_name,
    CAST(trunc(c0 + (c1 - c0) / 2.0 - 8) AS BIGINT) AS col_off, CAST(trunc(r0 + (r1 - r0) / 2.0 - 8) AS BIGINT) AS row_off FROM p"""
)
def bbox_windows(spark, sf):
    d = dataset(spark, sf)
    inside = d.edges.where("relation = 'contains'").select("vector_name", "raster_name")
    found = windows.bbox_windows(windows.with_pixels(d.rasters), d.vectors, inside, 16, 16)
    return found.select("vector_name", "raster_name", "new_name", "col_off", "row_off")


def _around(spark, sf, mode):
    d = dataset(spark, sf)
    return windows.around_vectors(d.edges, windows.with_pixels(d.rasters), d.vectors, mode).select(*_WINDOW)


_EIGHT = "CAST(8 AS BIGINT)"
for _mode, _sql in (
    ("centered", _around_sql(_EIGHT, _EIGHT, *_MID)),
    ("random", _around_sql(_EIGHT, _EIGHT, _draw("col"), _draw("row"))),
    (
        "variable",
        _around_sql(*(f"CAST(ceil(greatest((max_{a} - min_{a}) * CAST(1.2 AS DOUBLE), CAST(8 AS DOUBLE))) AS BIGINT)" for a in ("col", "row")), *_MID),
    ),
):
    QUERIES[f"around_vector_windows_{_mode}"] = partial(_around, mode=_mode)
    SQL[f"around_vector_windows_{_mode}"] = f"WITH {BASE}{_sql}"


@query(
    _GRID
    + """SELECT v.vector_name, g.new_name AS raster_name, CASE WHEN g.minx <= v.minx AND v.maxx <= g.maxx AND g.miny <= v.miny AND v.maxy <= g.maxy THEN 'contains' ELSE 'intersects' END AS relation
FROM v JOIN g ON v.minx <= g.maxx AND v.maxx >= g.minx AND v.miny <= g.maxy AND v.maxy >= g.miny"""
)
def cut_grid_edges(spark, sf):
    """A derived dataset of grid cutouts: its edges."""
    return derive.cut_grid(dataset(spark, sf), derive.GridCut(8, 8)).target.edges


def _cut_log(d: SpatialDataset) -> DataFrame:
    return d.edges.where("relation = 'contains'").join(shuffled(d.rasters.where("segment = 'BUILDING'").select("raster_name")), "raster_name", "left_semi")


_CUT = ", cut AS (SELECT e.vector_name, e.raster_name FROM e JOIN r USING (raster_name) WHERE relation = 'contains' AND segment = 'BUILDING')"
_CAND = _CUT + ", cand AS (SELECT vector_name, raster_name FROM e WHERE relation = 'contains' AND (vector_name, raster_name) NOT IN (SELECT vector_name, raster_name FROM cut))"


@query(_CUT + "SELECT raster_name FROM r WHERE raster_name NOT IN (SELECT raster_name FROM cut)")
def rasters_not_previously_cut(spark, sf):
    d = dataset(spark, sf)
    return windows.not_cut(d.rasters.select("raster_name"), _cut_log(d))


@query(_CAND + "SELECT vector_name, raster_name FROM cand")
def candidate_source_rasters(spark, sf):
    d = dataset(spark, sf)
    return windows.candidates(d.edges, _cut_log(d))


@query(
    _CAND
    + """, d AS (SELECT v.vector_name, greatest(2 - count(cut.raster_name), 0) AS deficit FROM v LEFT JOIN cut USING (vector_name) GROUP BY 1),
k AS (SELECT cand.*, deficit, row_number() OVER (PARTITION BY vector_name ORDER BY CAST('0x' || substr(md5('10|' || vector_name || '|' || raster_name), 1, 8) AS BIGINT), raster_name) AS rank
    FROM cand JOIN d USING (vector_name)) SELECT vector_name, raster_name FROM k WHERE rank <= deficit"""
)
def select_source_rasters(spark, sf):
    d = dataset(spark, sf)
    log = _cut_log(d)
    deficits = count_containing(d.vectors, log).select("vector_name", F.greatest(2 - F.col("raster_count"), F.lit(0)).alias("deficit"))
    return windows.select_rasters(windows.candidates(d.edges, log), deficits)


# -- classes and labels -----------------------------------------------------------------------------------------------------

_GROUPS = {"one+two": ["Brand#1", "Brand#2"], "teens": [f"Brand#{k}" for k in range(13, 20)], "Brand#25": ["Brand#25"]}
_SOFT = ", s AS (SELECT vector_name, vid, CAST((vid * 2) % 4 AS DOUBLE) AS c0, CAST((vid * 3) % 4 AS DOUBLE) AS c1, CAST((vid * 4) % 4 AS DOUBLE) AS c2, CAST((vid * 5) % 4 AS DOUBLE) AS c3 FROM v)"
_KIND = "CASE WHEN type IN ('Brand#1', 'Brand#2') THEN 'one+two' WHEN type = 'Brand#25' THEN 'Brand#25' WHEN type IN (" + ", ".join(f"'Brand#{k}'" for k in range(13, 20)) + ") THEN 'teens' END"


def _soft(df: DataFrame) -> DataFrame:
    return df.select("*", *[((F.col("vid") * (k + 2)) % 4).cast("double").alias(f"{classes.PREFIX}c{k}") for k in range(4)])


@query(f", k AS (SELECT vector_name, type AS orig_type, {_KIND} AS type FROM v) SELECT * FROM k WHERE type IS NOT NULL")
def combine_classes_categorical(spark, sf):
    return classes.combine_categorical(vectors(spark, sf), _GROUPS).select("vector_name", "orig_type", "type")


@query(
    _SOFT
    + """, t AS (SELECT vector_name, (c0 + c1) / (c0 + c1 + c3) AS a, c3 / (c0 + c1 + c3) AS b FROM s WHERE c0 + c1 + c3 > 0)
SELECT vector_name, a AS prob_of_class_a, b AS prob_of_class_b, CASE WHEN a = b THEN 'a,b' WHEN a > b THEN 'a' ELSE 'b' END AS most_likely_class FROM t"""
)
def combine_classes_soft(spark, sf):
    found = classes.combine_soft(_soft(vectors(spark, sf)), {"a": ["c0", "c1"], "b": ["c3"]})
    return found.select("vector_name", "prob_of_class_a", "prob_of_class_b", "most_likely_class")


@query(_SOFT + "SELECT vector_name, CASE greatest(c0, c1, c2, c3) WHEN c0 THEN 'c0' WHEN c1 THEN 'c1' WHEN c2 THEN 'c2' ELSE 'c3' END AS type FROM s")
def soft_to_categorical(spark, sf):
    return classes.soft_to_categorical(_soft(vectors(spark, sf)), ["c0", "c1", "c2", "c3"]).select("vector_name", "type")


@query(f"SELECT DISTINCT raster_name FROM e JOIN v USING (vector_name) WHERE {_KIND} IS NOT NULL")
def rasters_with_kept_classes(spark, sf):
    d = dataset(spark, sf)
    return classes.rasters_of(d.edges, classes.combine_categorical(d.vectors, _GROUPS))


_PIXELS = """, a AS (SELECT raster_name, e.vector_name, unnest(range(greatest(v.minx, r.minx), least(v.maxx, r.maxx))) AS x, greatest(v.miny, r.miny) AS y0, least(v.maxy, r.maxy) AS y1
    FROM e JOIN v USING (vector_name) JOIN r USING (raster_name)), px AS (SELECT raster_name, vector_name, x, unnest(range(y0, y1)) AS y FROM a)"""


@query(
    _PIXELS
    + """, o AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS k FROM (SELECT DISTINCT type FROM v)),
m AS (SELECT raster_name, x, y, max(k) AS label FROM px JOIN v USING (vector_name) JOIN o USING (type) WHERE k > 0 GROUP BY 1, 2, 3)
SELECT raster_name, CAST(label AS INTEGER) AS label, count(*) AS n_pixels FROM m GROUP BY 1, 2"""
)
def label_categorical(spark, sf):
    """The least class is the background; pixels by raster and label."""
    d = dataset(spark, sf)
    kinds = sorted(r[0] for r in d.vectors.select("type").distinct().collect())
    found = labels.label_categorical(d.edges, d.vectors, windows.with_pixels(d.rasters), kinds[1:])
    return found.groupBy("raster_name", "label").agg(F.count("*").alias("n_pixels"))


@query(
    _PIXELS
    + _SOFT
    + """, m AS (SELECT raster_name, x, y, max(vector_name) AS vector_name FROM px GROUP BY 1, 2, 3)
SELECT raster_name, count(*) AS n_pixels, sum(c0) AS c0, sum(c1) AS c1, sum(1.0 - (c0 + c1)) AS background FROM m JOIN s USING (vector_name) GROUP BY 1"""
)
def label_soft_categorical(spark, sf):
    d = dataset(spark, sf)
    found = labels.label_soft(d.edges, _soft(d.vectors), windows.with_pixels(d.rasters), ["c0", "c1"])
    sums = [F.sum(f"{classes.PREFIX}{c}").alias(c) for c in ("c0", "c1")]
    return found.groupBy("raster_name").agg(F.count("*").alias("n_pixels"), *sums, F.sum("background").alias("background"))


@query("SELECT raster_name FROM r WHERE raster_name NOT IN (SELECT raster_name FROM e)")
def rasters_without_labels(spark, sf):
    d = dataset(spark, sf)
    return labels.without_labels(d.rasters, d.edges)


# -- planning ---------------------------------------------------------------------------------------------------------------


@query("SELECT vector_name, raster_count FROM n WHERE raster_count < 1")
def vectors_to_download(spark, sf):
    return planning.vectors_to_download(dataset(spark, sf).vectors, 1).select("vector_name", "raster_count")


@query(
    """, c AS (SELECT vector_name, unnest(range(minx, maxx)) AS x, miny, maxy FROM v), c2 AS (SELECT vector_name, x, unnest(range(miny, maxy)) AS y FROM c),
h AS (SELECT c2.vector_name, x, y, max(CASE WHEN r.minx <= x AND x + 1 <= r.maxx AND r.miny <= y AND y + 1 <= r.maxy THEN 1 ELSE 0 END) AS hit FROM c2
    LEFT JOIN e ON e.vector_name = c2.vector_name LEFT JOIN r ON r.raster_name = e.raster_name GROUP BY 1, 2, 3)
SELECT vector_name FROM h GROUP BY 1 HAVING min(hit) = 0"""
)
def vectors_not_covered_by_union(spark, sf):
    d = dataset(spark, sf)
    return planning.not_covered_by_union(d.vectors, d.rasters, d.edges)


@query(
    """, k AS (SELECT vector_name, raster_name, row_number() OVER (PARTITION BY vector_name ORDER BY score DESC, raster_name) AS rank FROM e JOIN r USING (raster_name)
    WHERE relation = 'contains' AND segment <> 'FURNITURE' AND score >= -500) SELECT vector_name, raster_name FROM k WHERE rank = 1"""
)
def best_product_per_vector(spark, sf):
    d = dataset(spark, sf)
    return planning.best_product(d.edges, d.rasters, "score", where=F.col("score") >= -500, taken=d.rasters.where("segment = 'FURNITURE'"))


def _degrees(df: DataFrame) -> DataFrame:
    """The boxes as longitudes and latitudes in tenths of a degree."""
    x = [(F.col(c) / 10 - 100).alias(c) for c in ("minx", "maxx")]
    return df.select("vector_name", *x, (F.col("miny") % 1600 / 10 - 80).alias("miny"), ((F.col("miny") % 1600 + F.col("maxy") - F.col("miny")) / 10 - 80).alias("maxy"))


def _dem_sql(places: str) -> str:
    def name(x: str, y: str) -> str:
        part = "concat(CASE WHEN floor({0}) >= 0 THEN '{1}' ELSE '{2}' END, lpad(CAST(CAST(abs(floor({0})) AS BIGINT) AS VARCHAR), 3, '0'))"
        return f"concat({part.format(y, 'N', 'S')}, {part.format(x, 'E', 'W')})"

    return f""", g AS (SELECT vector_name, CAST(minx AS DOUBLE) / 10 - 100 AS minx, CAST(maxx AS DOUBLE) / 10 - 100 AS maxx, CAST(miny % 1600 AS DOUBLE) / 10 - 80 AS miny,
    CAST(miny % 1600 + maxy - miny AS DOUBLE) / 10 - 80 AS maxy FROM v), p AS ({places})
SELECT DISTINCT vector_name, {name("floor(x / 5) * 5", "floor(y / 5) * 5")} AS folder, {name("x", "y")} AS tile FROM p"""


@query(_dem_sql(" UNION ALL ".join(f"SELECT vector_name, {x} AS x, {y} AS y FROM g" for x in ("minx", "maxx") for y in ("miny", "maxy"))))
def dem_tiles_vertices(spark, sf):
    return planning.dem_tiles(_degrees(vectors(spark, sf)), "vertices")


@query(
    _dem_sql(
        "SELECT vector_name, minx + i.range AS x, miny + j.range AS y FROM g, range(4) AS i, range(4) AS j WHERE i.range <= ceil(maxx - minx) AND j.range <= ceil(maxy - miny)"
    )
)
def dem_tiles_grid(spark, sf):
    return planning.dem_tiles(_degrees(vectors(spark, sf)), "grid")


@query(None)
def plan_downloads(spark, sf):
    """Greedy: for an empty dataset, the whole catalogue of rasters, two for each vector."""
    v, r = vectors(spark, sf), rasters(spark, sf)
    return planning.plan_downloads(v.withColumn("raster_count", F.lit(0).cast("long")), spatial_edges(v, r), r, 2, "score")


@query(None)
def cut_around_vectors(spark, sf):
    d = dataset(spark, sf)
    return planning.cut_around_vectors(d.vectors, d.rasters, d.edges)
