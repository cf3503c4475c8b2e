"""Datasets of vectors (objects), rasters (images) and the labelled edges between them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.functions.crs import transform
from swathe.functions.geometry import BOX, SHAPE, with_bounds
from swathe.operators import graph
from swathe.operators.join import spatial_edges
from swathe.plans.durable import durable
from swathe.plans.skew import shuffled

EDGE_SCHEMA = "vector_name string, raster_name string, relation string"
VECTOR_SCHEMA = f"vector_name string, geom {SHAPE}, minx double, miny double, maxx double, maxy double, is_box boolean, raster_count long"
RASTER_SCHEMA = f"raster_name string, geom {SHAPE}, minx double, miny double, maxx double, maxy double, is_box boolean, orig_crs_epsg_code int"


def _ids(spark: SparkSession, names: DataFrame | str | int | Iterable, column: str) -> DataFrame:
    """Ids given as a table, one id or many; ids are strings."""
    if isinstance(names, DataFrame):
        return shuffled(names.select(F.col(column).cast("string")))
    names = [names] if isinstance(names, (str, int)) else list(names)
    return spark.createDataFrame([(str(n),) for n in names], f"{column} string")


def count_containing(vectors: DataFrame, edges: DataFrame, column: str = "raster_count") -> DataFrame:
    """Vectors with the number of rasters that contain them."""
    counts = edges.where("relation = 'contains'").groupBy("vector_name").agg(F.count("*").alias("__n"))
    rows = vectors.drop(column).join(shuffled(counts), "vector_name", "left")
    return rows.withColumn(column, F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")


@dataclass(frozen=True)
class SpatialDataset:
    """Immutable: every operation returns a new dataset. ``attrs`` holds what can be written as JSON."""

    vectors: DataFrame
    rasters: DataFrame
    edges: DataFrame
    attrs: dict = field(default_factory=lambda: {"crs_epsg_code": 4326, "task_vector_classes": [], "background_class": None, "raster_count_col_name": "raster_count"})

    # -- making, saving -------------------------------------------------------------------------------------------

    @classmethod
    def from_scratch(cls, spark: SparkSession, vectors: DataFrame | None = None, rasters: DataFrame | None = None, **attrs) -> SpatialDataset:
        empty = cls(spark.createDataFrame([], VECTOR_SCHEMA), spark.createDataFrame([], RASTER_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
        out = replace(empty, attrs=empty.attrs | attrs)
        out = out if rasters is None else out.add_rasters(rasters)
        return out if vectors is None else out.add_vectors(vectors)

    @classmethod
    def of(cls, vectors: DataFrame, rasters: DataFrame, **attrs) -> SpatialDataset:
        """From two checked tables with boxes: edges by the spatial join, counts from the edges."""
        edges = spatial_edges(vectors, rasters)
        made = cls(count_containing(vectors, edges), rasters, edges)
        return replace(made, attrs=made.attrs | attrs)

    def empty_same_format(self) -> SpatialDataset:
        return replace(self, vectors=self.vectors.limit(0), rasters=self.rasters.limit(0), edges=self.edges.limit(0))

    def save(self, path: str) -> None:
        """Parquet tables and attributes, anywhere Spark can write; edges are sorted by vector for lookups."""
        text = json.dumps(self.attrs)
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.rasters.write.mode("overwrite").parquet(f"{path}/rasters")
        self.edges.sortWithinPartitions("vector_name").write.mode("overwrite").parquet(f"{path}/edges")
        self.vectors.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attrs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpatialDataset:
        attrs = json.loads(spark.read.text(f"{path}/attrs", wholetext=True).first()[0])
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("vectors", "rasters", "edges")], attrs=attrs)

    def export(self, path: str) -> None:
        """The interchange form: GeoJSON lines of both tables, adjacency lines and attributes, written by the tasks."""
        from swathe.sources.geojson import adjacency_lines, write_geojson

        write_geojson(self.vectors, f"{path}/vectors.geojson", "vector_name")
        write_geojson(self.rasters, f"{path}/rasters.geojson", "raster_name")
        adjacency_lines(self.vectors, self.rasters, self.edges).select(F.to_json(F.struct("side", "name", "value")).alias("value")).write.mode("overwrite").text(f"{path}/graph.json")
        self.vectors.sparkSession.createDataFrame([(json.dumps(self.attrs),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attrs.json")

    @classmethod
    def from_data_dir(cls, spark: SparkSession, path: str) -> SpatialDataset:
        """Reads the interchange form, or single files of the same names: feature collections and one adjacency object."""
        from swathe.sources.geojson import read_adjacency, read_geojson

        def table(name: str, key: str) -> DataFrame:
            first = spark.read.text(f"{path}/{name}.geojson").where("trim(value) <> ''").limit(1).collect()
            lines = not first or '"Feature"' in first[0][0] and '"FeatureCollection"' not in first[0][0]
            return read_geojson(spark, f"{path}/{name}.geojson", key, lines=lines)

        text = spark.read.text(f"{path}/graph.json").where("trim(value) <> ''")
        if text.where("value like '{\"side\":%'").limit(1).count():
            rows = text.select(F.from_json("value", "struct<side:string,name:string,value:string>").alias("g")).where("g.side = 'vectors'")
            edges = rows.select(F.col("g.name").alias("vector_name"), F.explode(F.from_json("g.value", "map<string,string>")).alias("raster_name", "relation"))
        else:
            edges = read_adjacency(spark, f"{path}/graph.json")
        attrs = json.loads(spark.read.text(f"{path}/attrs.json", wholetext=True).first()[0])
        vectors = count_containing(table("vectors", "vector_name"), edges)
        return cls(vectors, table("rasters", "raster_name"), edges, attrs=attrs)

    # -- checks ---------------------------------------------------------------------------------------------------

    def _checked(self, new: DataFrame, old: DataFrame, key: str) -> DataFrame:
        """New rows with string ids, in the dataset's system, with boxes; raises for bad batches."""
        has_shape = "geom" in new.columns
        missing = {key, *(() if has_shape else BOX)} - set(new.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        new = new.withColumn(key, F.col(key).cast("string"))
        if has_shape and "crs_epsg_code" in new.columns:
            codes = [r[0] for r in new.select("crs_epsg_code").distinct().limit(3).collect()]
            if None in codes:
                raise ValueError("rows without a coordinate system")
            if len(codes) > 1:
                raise ValueError("a batch has one coordinate system")
            if codes:
                new = new.withColumn("geom", transform(F.col("geom"), int(codes[0]), self.attrs["crs_epsg_code"]))
            new = new.drop("crs_epsg_code")
        new = with_bounds(new) if has_shape and "minx" not in new.columns else new
        bad = batch_problems(new, old, key).limit(5).collect()
        if bad:
            raise ValueError(f"{key}s {bad[0]['problem']}: {[r['name'] for r in bad]}")
        return new

    # -- adding, dropping -----------------------------------------------------------------------------------------

    def add_vectors(self, new: DataFrame, check: bool = True) -> SpatialDataset:
        """Appends vectors; only the new ones are joined, with the rasters that are there."""
        new = self._checked(new, self.vectors, "vector_name") if check else new
        delta = durable(spatial_edges(new, self.rasters))  # counts and edges, and all that is asked later, read it
        return replace(self, vectors=self.vectors.unionByName(count_containing(new, delta), allowMissingColumns=True), edges=self.edges.unionByName(delta))

    def add_rasters(self, new: DataFrame, check: bool = True) -> SpatialDataset:
        """Appends rasters; only the new ones are joined; counts of the vectors they contain go up."""
        new = self._checked(new, self.rasters, "raster_name") if check else new
        edges = self.edges.unionByName(durable(spatial_edges(self.vectors, new)))
        return replace(self, rasters=self.rasters.unionByName(new, allowMissingColumns=True), edges=edges, vectors=count_containing(self.vectors, edges))

    def drop_vectors(self, names: DataFrame | str | Iterable) -> SpatialDataset:
        ids = _ids(self.vectors.sparkSession, names, "vector_name")
        return replace(self, vectors=self.vectors.join(ids, "vector_name", "left_anti"), edges=graph.delete_vertices(self.edges, ids, "vector_name"))

    def drop_rasters(self, names: DataFrame | str | Iterable) -> SpatialDataset:
        ids = _ids(self.vectors.sparkSession, names, "raster_name")
        edges = graph.delete_vertices(self.edges, ids, "raster_name")
        return replace(self, rasters=self.rasters.join(ids, "raster_name", "left_anti"), edges=edges, vectors=count_containing(self.vectors, edges))

    def merge(self, other: SpatialDataset) -> SpatialDataset:
        """This dataset with the vectors and rasters of ``other`` whose ids it lacks; edges across are found too."""
        rasters = other.rasters.join(shuffled(self.rasters.select("raster_name")), "raster_name", "left_anti")
        vectors = other.vectors.join(shuffled(self.vectors.select("vector_name")), "vector_name", "left_anti")
        return self.add_rasters(rasters, check=False).add_vectors(vectors, check=False)

    # -- questions ------------------------------------------------------------------------------------------------

    def neighbours(self, of: str, names: DataFrame | str | Iterable | None = None, relation: str | None = None, distinct: bool = True) -> DataFrame:
        """Edges at vectors (``of`` = 'vector_name') or rasters; of the given ids, or all; ``distinct`` for the other side only."""
        rows = self.edges if relation is None else self.edges.where(F.col("relation") == relation)
        other = "raster_name" if of == "vector_name" else "vector_name"
        if names is not None:
            ids = _ids(self.vectors.sparkSession, names, of)
            table = self.vectors if of == "vector_name" else self.rasters
            unknown = [r[0] for r in ids.join(shuffled(table.select(of)), of, "left_anti").limit(5).collect()]
            if unknown:
                raise ValueError(f"unknown {of}: {unknown}")
            rows = rows.join(ids.distinct() if distinct else ids, of)
            return rows.select(other).distinct() if distinct else rows.select(other)
        return rows.select(of, other)

    def rasters_intersecting_vector(self, names=None, distinct: bool = True) -> DataFrame:
        return self.neighbours("vector_name", names, None, distinct)

    def rasters_containing_vector(self, names=None, distinct: bool = True) -> DataFrame:
        return self.neighbours("vector_name", names, "contains", distinct)

    def vectors_intersecting_raster(self, names=None, distinct: bool = True) -> DataFrame:
        return self.neighbours("raster_name", names, None, distinct)

    def vectors_contained_in_raster(self, names=None, distinct: bool = True) -> DataFrame:
        return self.neighbours("raster_name", names, "contains", distinct)

    def pair_relations(self, pairs: DataFrame) -> DataFrame:
        """For (vector_name, raster_name) pairs: do they intersect, does the raster contain the vector."""
        rows = pairs.join(shuffled(self.edges), ["vector_name", "raster_name"], "left")
        return rows.select("vector_name", "raster_name", F.col("relation").isNotNull().alias("intersects"), F.coalesce(F.col("relation") == "contains", F.lit(False)).alias("contains"))

    def has_raster(self) -> DataFrame:
        return self.vectors.select("vector_name", (F.col("raster_count") > 0).alias("has_raster"))

    def invariant_violations(self) -> DataFrame:
        """(kind, name) of edges without a vertex, edges given twice and counts that aren't the number of containing rasters."""
        lost_v = self.edges.join(shuffled(self.vectors.select("vector_name")), "vector_name", "left_anti").select(F.lit("edge without vector").alias("kind"), F.col("vector_name").alias("name"))
        lost_r = self.edges.join(shuffled(self.rasters.select("raster_name")), "raster_name", "left_anti").select(F.lit("edge without raster"), "raster_name")
        twice = self.edges.groupBy("vector_name", "raster_name").count().where("count > 1").select(F.lit("edge twice"), "vector_name")
        recount = count_containing(self.vectors.select("vector_name", F.col("raster_count").alias("kept")), self.edges, "recount")
        wrong = recount.where(~F.col("kept").eqNullSafe(F.col("recount"))).select(F.lit("wrong count"), "vector_name")
        return lost_v.union(lost_r).union(twice).union(wrong).distinct()

    # -- classes --------------------------------------------------------------------------------------------------

    def all_vector_classes(self) -> list[str]:
        rest = [self.attrs.get("background_class")]
        return [*self.attrs.get("task_vector_classes", []), *(c for c in rest if c is not None)]

    def with_attrs(self, **attrs) -> SpatialDataset:
        """Sets attributes; task classes must be distinct and apart from the background class."""
        merged = self.attrs | attrs
        task = list(merged.get("task_vector_classes") or [])
        if len(set(task)) != len(task):
            raise ValueError("task classes must be distinct")
        if merged.get("background_class") in task:
            raise ValueError("the background class can't be a task class")
        json.dumps(merged)
        return replace(self, attrs=merged)

    def set_crs(self, epsg: int) -> SpatialDataset:
        """Reprojects the shapes of both tables; edges stay as they are."""
        old = self.attrs["crs_epsg_code"]
        if epsg == old:
            return self
        move = lambda df: with_bounds(df.withColumn("geom", transform(F.col("geom"), old, epsg)))
        return replace(self, vectors=move(self.vectors), rasters=move(self.rasters), attrs=self.attrs | {"crs_epsg_code": epsg})


def batch_problems(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(name, problem): ids of a batch that appear twice, have no box, or are in the table already."""
    rows = new.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col("minx").isNull()).alias("no_shape"))
    rows = rows.join(shuffled(old.select(key, F.lit(True).alias("there")).distinct()), key, "left").where("n > 1 or no_shape or there")
    why = F.when(F.col("n") > 1, "appear twice").when(F.col("no_shape"), "have no geometry").otherwise("are in the dataset already")
    return rows.select(F.col(key).alias("name"), why.alias("problem"))


def missing_rasters(target: int) -> Column:
    """Vectors that fewer than ``target`` rasters contain."""
    return F.col("raster_count") < target


def only_this(name: str) -> Column:
    return F.col("vector_name") == str(name)


def missing_vectors(source: DataFrame, target: DataFrame) -> DataFrame:
    """Vectors of the source that the target lacks, by id."""
    return source.join(shuffled(target.select("vector_name")), "vector_name", "left_anti")


def needing_relabel(edges: DataFrame, new_vectors: DataFrame, old_rasters: DataFrame) -> DataFrame:
    """Rasters that were there before and touch a new vector."""
    touched = edges.join(shuffled(new_vectors.select("vector_name")), "vector_name", "left_semi")
    return touched.join(shuffled(old_rasters.select("raster_name")), "raster_name", "left_semi").select("raster_name").distinct()
