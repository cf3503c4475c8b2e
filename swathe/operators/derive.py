"""Datasets made from datasets: created once, then updated with what the source has gained. Updates only add."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.operators import classes, planning, windows
from swathe.operators.dataset import SpatialDataset, missing_vectors, needing_relabel
from swathe.plans.durable import durable
from swathe.plans.skew import shuffled

LOG = "vector_name string, raster_name string"


@dataclass(frozen=True)
class Derived:
    """The target, which source rasters were cut (for which vectors), and the pre-existing rasters to label again."""

    target: SpatialDataset
    cut_log: DataFrame
    relabel: DataFrame


@dataclass(frozen=True)
class GridCut:
    """Every source raster to a grid; a part that can be saved with ``plans.recipe``."""

    rows: int = 512
    cols: int = 512
    pixel: float = 1.0


@dataclass(frozen=True)
class AroundCut:
    """Cutouts around vectors until each has ``target_count``: greedy as in ``planning.cut_around_vectors``."""

    target_count: int = 1
    rows: int = 512
    cols: int = 512
    seed: int = 10
    mode: str = "random"  # or centered, variable
    scaling: float = 1.2


def _started(source: SpatialDataset, before: Derived | None) -> tuple[SpatialDataset, DataFrame, DataFrame]:
    """The target with the source's new vectors, its cut log, and the new vectors."""
    spark = source.vectors.sparkSession
    if before is None:
        blank = source.empty_same_format()
        target, log = blank, spark.createDataFrame([], LOG)
    else:
        target, log = before.target, before.cut_log
    new = durable(missing_vectors(source.vectors, target.vectors))
    return target.add_vectors(new.drop("raster_count"), check=False), log, new


def _finished(target: SpatialDataset, made: DataFrame, log: DataFrame, new: DataFrame) -> Derived:
    old = target.rasters.select("raster_name")
    target = target.add_rasters(made.join(shuffled(old), "raster_name", "left_anti"), check=False)
    return Derived(target, durable(log.distinct()), needing_relabel(target.edges, new, old))


def cut_grid(source: SpatialDataset, cut: GridCut = GridCut(), before: Derived | None = None, where: Column | None = None) -> Derived:
    """Cuts the source rasters that weren't cut before (and pass ``where``) to a grid; cutouts keep the raster's columns."""
    target, log, new = _started(source, before)
    rasters = windows.not_cut(source.rasters if where is None else source.rasters.where(where), log)
    rasters = durable(rasters)
    pixels = rasters if {"width", "height", "a", "c", "e", "f"} <= set(rasters.columns) else windows.with_pixels(rasters, cut.pixel)
    made = windows.footprint(windows.grid_windows(pixels, cut.rows, cut.cols))
    if {"width", "height", "a", "c", "e", "f"} <= set(rasters.columns):  # a cutout's own pixels
        made = made.withColumns({"c": F.col("minx"), "f": F.col("maxy"), "width": F.col("w"), "height": F.col("h")})
    made = _as_rasters(made, rasters)
    done = rasters.select(F.lit(None).cast("string").alias("vector_name"), "raster_name")
    return _finished(target, made, log.unionByName(done), new)


def cut_around(source: SpatialDataset, cut: AroundCut = AroundCut(), before: Derived | None = None, where: Column | None = None) -> Derived:
    """Cuts windows around the vectors that still lack cutouts, from containing rasters that weren't cut for them."""
    target, log, new = _started(source, before)
    wanted = target.vectors.where(F.col("raster_count") < cut.target_count)
    wanted = wanted if where is None else wanted.where(where)
    keys = ["vector_name", "raster_name"]
    edges = source.edges.join(shuffled(log.select(*keys).distinct()), keys, "left_anti")
    edges = edges.join(shuffled(wanted.select("vector_name")), "vector_name", "left_semi")
    made = durable(planning.cut_around_vectors(source.vectors, source.rasters, edges, cut.target_count, cut.rows, cut.cols, cut.seed, wanted, cut.mode, cut.scaling))
    shaped = made.withColumnsRenamed({"raster_name": "__source", "new_name": "raster_name"}).select("raster_name", "__source", "minx", "miny", "maxx", "maxy")
    kept = [c for c in source.rasters.columns if c not in ("raster_name", "geom", "is_box", "minx", "miny", "maxx", "maxy")]
    shaped = shaped.join(shuffled(source.rasters.select(F.col("raster_name").alias("__source"), *kept)), "__source").drop("__source")
    out = _finished(target, _boxed(shaped, "geom" in source.rasters.columns), log.unionByName(made.select(*keys)), new)
    inside = out.target.edges.where("relation = 'contains'").join(shuffled(made.select(F.col("new_name").alias("raster_name"), F.col("raster_name").alias("__source"))), "raster_name")
    return replace(out, cut_log=durable(out.cut_log.unionByName(inside.select("vector_name", F.col("__source").alias("raster_name"))).distinct()))


def _boxed(df: DataFrame, shapes: bool) -> DataFrame:
    from swathe.functions.geometry import box_shape

    return df.withColumn("geom", box_shape(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])).withColumn("is_box", F.lit(True)) if shapes else df


def _as_rasters(made: DataFrame, rasters: DataFrame) -> DataFrame:
    kept = [c for c in rasters.columns if c not in ("raster_name", "geom", "is_box", "minx", "miny", "maxx", "maxy")]
    return _boxed(made.select(F.col("new_name").alias("raster_name"), "minx", "miny", "maxx", "maxy", *kept), "geom" in rasters.columns)


def combine_dataset(source: SpatialDataset, groups: dict[str, Sequence[str]], soft: bool = False, remove_rasters: bool = True) -> SpatialDataset:
    """The dataset with combined classes, and the rasters that meet a kept vector (or all). Raises for classes that the
    dataset doesn't have (if it names any) or that are used twice."""
    lists = {k: list(v) for k, v in groups.items()}
    known = source.all_vector_classes() or [c for v in lists.values() for c in v]
    classes.grouping(list(lists.values()), list(lists), known)
    vectors = durable((classes.combine_soft if soft else classes.combine_categorical)(source.vectors, lists))
    edges = source.edges.join(shuffled(vectors.select("vector_name")), "vector_name", "left_semi")
    rasters = source.rasters.join(shuffled(classes.rasters_of(edges, vectors)), "raster_name", "left_semi") if remove_rasters else source.rasters
    return replace(source, vectors=vectors, rasters=rasters, edges=edges, attrs=classes.combined_attrs(source.attrs, lists))


def categorical_dataset(source: SpatialDataset, names: Sequence[str]) -> SpatialDataset:
    """Soft classes to one class a vector; the rest of the dataset stays."""
    return replace(source, vectors=classes.soft_to_categorical(source.vectors, names), attrs=source.attrs | {"label_type": "categorical"})


def relabelled(labels: DataFrame, rasters: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The labels with those of ``rasters`` (raster_name) made again: the rows are replaced by raster."""
    names = rasters.select("raster_name").distinct()
    return labels.join(shuffled(names), "raster_name", "left_anti").unionByName(make(names))
