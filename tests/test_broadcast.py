"""Joins of tables that grow with the input are never broadcast, however small the files look."""

import os

import pytest
from pyspark.sql import functions as F

from swathe import queries
from swathe.operators import dataset, derive, planning
from swathe.plans import components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

NAMES = [
    "spatial_join_triangles", "spatial_join_edges", "spatial_join_degrees", "raster_overlap_pairs", "raster_count", "raster_count_histogram", "vectors_with_raster",
    "vector_row_condition", "vectors_missing_rasters", "vectors_to_download", "vertex_degrees", "boundary_vectors", "top_rasters_by_degree",
    "add_rasters_delta", "add_vectors_delta", "merge_datasets", "rasters_containing_vector", "rasters_intersecting_vector", "rasters_intersecting_vector_bag",
    "vectors_contained_in_raster", "vectors_intersecting_raster", "pair_relation_lookup", "drop_vectors_edges", "drop_rasters_edges", "drop_rasters_counts",
    "missing_vectors_to_target", "rasters_needing_relabel", "duplicate_ids", "raster_composite_predicate", "graph_invariant_violations", "raster_share_pairs",
    "delete_edges", "overwrite_edges",
    "cut_grid_edges", "rasters_with_kept_classes",
    "around_vector_windows_random", "around_vector_windows_centered", "around_vector_windows_variable", "bbox_windows", "candidate_source_rasters",
    "select_source_rasters", "rasters_not_previously_cut",
    "label_categorical", "label_soft_categorical", "rasters_without_labels",
    "precluster_x_axis", "precluster_y_axis", "raster_clusters_share", "raster_clusters_share_or_overlap",
    "best_product_per_vector", "plan_downloads", "cut_around_vectors", "vectors_not_covered_by_union",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_growing_tables_are_not_broadcast(spark, monkeypatch, name):
    plans = []
    for module in (dataset, derive, planning, components):
        kept = module.durable
        monkeypatch.setattr(module, "durable", lambda df, kept=kept: plans.append(plan(df)) or kept(df))
    last = plan(queries.QUERIES[name](spark, SF))
    plans += [] if name.startswith("raster_clusters") else [last]  # there it joins at most 200,000 links, made in one task
    assert not [p for p in plans if "Broadcast" in p]


RUN = [
    "rasters_intersecting_vector", "rasters_intersecting_vector_bag", "vectors_contained_in_raster", "boundary_vectors", "vectors_with_raster",
    "raster_count", "raster_count_histogram", "vector_row_condition",
]


def executed(spark):
    """Final plans of what ran, by id: what a query collects or checkpoints on its way is among them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {run.executionId(): run for run in (runs.apply(i) for i in range(runs.size()))}


@pytest.mark.parametrize("name", RUN)
def test_nothing_is_broadcast_while_a_query_runs(spark, name):
    before = executed(spark)
    queries.QUERIES[name](spark, SF).collect()
    ran = [run.physicalPlanDescription() for i, run in executed(spark).items() if i not in before]
    assert any("SortMergeJoin" in p for p in ran) and not [p for p in ran if "Broadcast" in p]


def test_small_and_large_objects_on_both_sides_meet(spark):
    """A row at an object's own level is left out only where the other side has none so small."""
    from swathe.operators.join import box_pairs

    def table(sizes):
        rows = [(f"{i}-{s}", float(7 * i), float(5 * i), 7.0 * i + s, 5.0 * i + s) for i in range(12) for s in sizes]
        return spark.createDataFrame(rows, "name string, minx double, miny double, maxx double, maxy double"), rows

    for a, b in (((0, 1, 40), (3, 9)), ((3, 9), (0, 1, 40)), ((1,), (30,)), ((30,), (1,)), ((0,), (0,)), ((2, 16), (2, 16))):
        (left, l_rows), (right, r_rows) = table(a), table(b)
        want = sorted((x[0], y[0]) for x in l_rows for y in r_rows if x[1] <= y[3] and x[3] >= y[1] and x[2] <= y[4] and x[4] >= y[2])
        assert sorted((r["l_name"], r["r_name"]) for r in box_pairs(left, right).collect()) == want


def test_a_scan_in_one_task_is_dealt_out_before_it_is_exploded(spark, tmp_path):
    """A file of one row group is one task; what its rows explode to is not held there. Small tables are left alone."""
    from swathe.operators.join import spatial_edges

    def table(name, n, size):
        box = {f"{end}{axis}": F.col("id") * step + at for axis, step in (("x", 7), ("y", 5)) for end, at in (("min", 0), ("max", size))}
        path = str(tmp_path / f"{name}{n}")
        spark.range(n).coalesce(1).select(F.concat(F.lit(name), F.col("id")).alias(f"{name}_name"), *[c.alias(k) for k, c in box.items()]).write.parquet(path)
        return spark.read.parquet(path)

    small = spatial_edges(table("vector", 100, 3), table("raster", 100, 30))
    assert "REPARTITION_BY_NUM" not in plan(small)
    v, r = table("vector", 300_000, 3), table("raster", 300_000, 30)
    assert len(v.inputFiles()) == len(r.inputFiles()) == 1
    large = spatial_edges(v, r)
    assert plan(large).count("REPARTITION_BY_NUM") == 2
    want = sum(1 for i in range(300_000) for k in range(-5, 2) if 0 <= i + k < 300_000 and 7 * i <= 7 * (i + k) + 30 and 7 * i + 3 >= 7 * (i + k) and 5 * i <= 5 * (i + k) + 30 and 5 * i + 3 >= 5 * (i + k))
    assert large.count() == want == large.distinct().count()
