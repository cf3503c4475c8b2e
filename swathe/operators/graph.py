"""Bipartite graph operations on one table of edges; both directions are the same row, so it is undirected by design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.plans.skew import shuffled

KEYS = ("vector_name", "raster_name")


def opposite(column: str) -> str:
    if column not in KEYS:
        raise ValueError(f"unknown side: {column}")
    return KEYS[1 - KEYS.index(column)]


def vertices_opposite(edges: DataFrame, name: str, column: str, relation: str | None = None) -> DataFrame:
    rows = edges.where(F.col(column) == name)
    return (rows if relation is None else rows.where(F.col("relation") == relation)).select(opposite(column)).distinct()


def exists_edge(edges: DataFrame, vector: str, raster: str) -> bool:
    return not edges.where((F.col("vector_name") == vector) & (F.col("raster_name") == raster)).isEmpty()


def edge_data(edges: DataFrame, vector: str, raster: str) -> str:
    row = edges.where((F.col("vector_name") == vector) & (F.col("raster_name") == raster)).select("relation").first()
    if row is None:
        raise KeyError((vector, raster))
    return row[0]


def add_vertices(table: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Vertices that are there already are left alone."""
    return table.unionByName(new.select(column).distinct().join(shuffled(table.select(column)), column, "left_anti"), allowMissingColumns=True)


def add_edges(edges: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Adds edges; one that exists raises, or is overwritten with ``force``."""
    if not force:
        there = new.join(shuffled(edges.select(*KEYS)), list(KEYS), "left_semi").limit(5).collect()
        if there:
            raise ValueError(f"edges exist: {[tuple(r)[:2] for r in there]}")
        return edges.unionByName(new)
    return edges.join(shuffled(new.select(*KEYS)), list(KEYS), "left_anti").unionByName(new)


def delete_vertices(edges: DataFrame, ids: DataFrame, column: str, force: bool = True) -> DataFrame:
    """Edges without those at the vertices; the other ends stay. Without ``force`` a vertex with edges raises."""
    ids = ids.select(column).distinct()
    if not force and not edges.join(ids, column, "left_semi").isEmpty():
        raise ValueError("a vertex with edges can't be deleted without force")
    return edges.join(ids, column, "left_anti")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(shuffled(gone.select(*KEYS).distinct()), list(KEYS), "left_anti")


def equal(a: DataFrame, b: DataFrame) -> bool:
    cols = [*KEYS, "relation"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def degrees(edges: DataFrame, column: str) -> DataFrame:
    """Number of edges of each vertex that has any."""
    return edges.groupBy(column).agg(F.count("*").alias("degree"))


def boundary_vectors(edges: DataFrame, least: int = 2) -> DataFrame:
    """Vectors that at least so many rasters meet without containing them."""
    cut = edges.where("relation = 'intersects'").groupBy("vector_name").agg(F.count("*").alias("n"))
    return cut.where(F.col("n") >= least).select("vector_name", F.col("n").alias("n_boundary"))


def sharing_pairs(edges: DataFrame) -> DataFrame:
    """(raster_a, raster_b), a before b: rasters that share a vector they meet."""
    a = edges.select("vector_name", F.col("raster_name").alias("raster_a"))
    b = edges.select("vector_name", F.col("raster_name").alias("raster_b"))
    return a.join(shuffled(b), "vector_name").where("raster_a < raster_b").select("raster_a", "raster_b").distinct()


def sharing_links(edges: DataFrame) -> DataFrame:
    """(raster_a, raster_b) with the components of ``sharing_pairs``: each raster linked to the first of each vector.

    One link an edge instead of all pairs at a vector, so a vector under very many rasters stays cheap.
    """
    first = edges.groupBy("vector_name").agg(F.min("raster_name").alias("raster_a"))
    return edges.join(shuffled(first), "vector_name").where("raster_a <> raster_name").select("raster_a", F.col("raster_name").alias("raster_b")).distinct()
