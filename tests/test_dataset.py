"""The life of a dataset: adding and dropping on either side, lookups, clusters, classes, graph operations."""

import pytest
from pyspark.sql import functions as F

from swathe.functions.geometry import box_shape
from swathe.operators import classes, clusters, graph, planning
from swathe.operators.dataset import SpatialDataset
from swathe.operators.join import overlap_pairs, spatial_edges
from swathe.plans.components import components
from swathe.plans.skew import join_facts


def boxes(spark, key, rows):
    df = spark.createDataFrame([(n, *map(float, b)) for n, b in rows.items()], f"{key} string, a double, b double, c double, d double")
    return df.select(key, box_shape(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"))


def edges_of(d):
    return {(r["vector_name"], r["raster_name"], r["relation"][0]) for r in d.edges.collect()}


def consistent(d):
    assert d.invariant_violations().count() == 0
    return d


def test_adding_and_dropping(spark):
    v = boxes(spark, "vector_name", {"p1": (0, 0, 1, 1), "p2": (4, 4, 5, 5), "p3": (-2, -2, -1, -1)})
    d = SpatialDataset.from_scratch(spark)
    d = consistent(d.add_vectors(v))
    d = consistent(d.add_rasters(boxes(spark, "raster_name", {"r1": (-0.5, -0.5, 6, 6), "r2": (-1.5, -1.5, 0.5, 0.5)})))
    assert edges_of(d) == {("p1", "r1", "c"), ("p1", "r2", "i"), ("p2", "r1", "c"), ("p3", "r2", "i")}
    d = consistent(d.add_rasters(boxes(spark, "raster_name", {"r3": (-3, -3, 7, 7), "r4": (-1.5, -1.5, 2, 2)})))
    new = {("p1", "r3", "c"), ("p1", "r4", "c"), ("p2", "r3", "c"), ("p3", "r3", "c"), ("p3", "r4", "i")}
    assert edges_of(d) >= new and len(edges_of(d)) == 9
    d = consistent(d.drop_vectors("p3").add_vectors(boxes(spark, "vector_name", {"p3": (-100, -100, -99, -99), "p4": (-1, -1, 0, 0)})))
    assert {e for e in edges_of(d) if e[0] in ("p3", "p4")} == {("p4", "r1", "i"), ("p4", "r2", "c"), ("p4", "r3", "c"), ("p4", "r4", "c")}
    d = consistent(d.drop_rasters(["r2", "r3"]).drop_vectors(["p1", "p3"]).drop_rasters("r4"))
    assert edges_of(d) == {("p2", "r1", "c"), ("p4", "r1", "i")}
    assert {r["vector_name"]: r["raster_count"] for r in d.vectors.collect()} == {"p2": 1, "p4": 0}
    assert [r[0] for r in d.rasters_containing_vector(["p2"]).collect()] == ["r1"]
    assert {r[0] for r in d.vectors_intersecting_raster("r1").collect()} == {"p2", "p4"}
    with pytest.raises(ValueError, match="unknown"):
        d.rasters_intersecting_vector("nobody")
    with pytest.raises(ValueError, match="already"):
        d.add_vectors(boxes(spark, "vector_name", {"p2": (0, 0, 1, 1)}))
    with pytest.raises(ValueError, match="twice"):
        d.add_rasters(boxes(spark, "raster_name", {"n": (0, 0, 1, 1)}).union(boxes(spark, "raster_name", {"n": (0, 0, 1, 1)})))
    with pytest.raises(ValueError, match="missing"):
        d.add_vectors(spark.createDataFrame([("a",)], "vector_name string"))


def test_save_and_load_and_merge(spark, tmp_path):
    v = boxes(spark, "vector_name", {"p1": (0, 0, 1, 1), "p2": (4, 4, 5, 5)})
    r = boxes(spark, "raster_name", {"r1": (-1, -1, 2, 2), "r2": (3, 3, 9, 9)})
    d = SpatialDataset.from_scratch(spark, v, r, task_vector_classes=["x"], background_class="y")
    d.save(f"{tmp_path}/d")
    back = SpatialDataset.load(spark, f"{tmp_path}/d")
    assert edges_of(back) == edges_of(d) and back.attrs == d.attrs and back.all_vector_classes() == ["x", "y"]
    assert back.empty_same_format().vectors.schema == back.vectors.schema
    other = SpatialDataset.from_scratch(spark, boxes(spark, "vector_name", {"p2": (4, 4, 5, 5), "p9": (1, 1, 1.5, 1.5)}))
    assert edges_of(consistent(back.merge(other))) == {("p1", "r1", "c"), ("p2", "r2", "c"), ("p9", "r1", "c")}
    with pytest.raises(ValueError):
        d.with_attrs(task_vector_classes=["a", "a"])
    with pytest.raises(ValueError):
        d.with_attrs(task_vector_classes=["a"], background_class="a")


def test_clusters(spark):
    v = {"p1": (-1, -1, 1, 1), "p2": (3, 3, 3.5, 3.5)}
    r = {"r1": (-4, 0, 4, 8), "r2": (-4, -8.5, 4, -0.5), "r3": (2, 2, 10, 10), "r4": (100, 100, 108, 108), "r5": (106, 106, 114, 114), "r6": (112, 112, 120, 120)}
    d = SpatialDataset.from_scratch(spark, boxes(spark, "vector_name", v), boxes(spark, "raster_name", r))

    def found(kind):
        out = {}
        for row in clusters.raster_clusters(d.rasters, d.edges, kind).collect():
            out.setdefault(row["cluster"], set()).add(row["raster_name"])
        return sorted(map(sorted, out.values()))

    assert found("share_or_overlap") == [["r1", "r2", "r3"], ["r4", "r5", "r6"]]
    assert found("share") == [["r1", "r2", "r3"], ["r4"], ["r5"], ["r6"]]
    assert sorted(tuple(x) for x in overlap_pairs(d.rasters).collect()) == [("r1", "r3"), ("r4", "r5"), ("r5", "r6")]


def test_sweep_merges_touching_intervals(spark):
    spans = [(f"s{k}", float(lo), float(hi)) for k, (lo, hi) in enumerate([(0, 2), (2, 3), (3.5, 4), (10, 11), (9, 30), (29, 31), (31.5, 32)])]
    df = spark.createDataFrame(spans, "raster_name string, lo double, hi double")
    want = {"s0": 1, "s1": 1, "s2": 2, "s3": 3, "s4": 3, "s5": 3, "s6": 4}
    for blocks in (None, 0.5, 3.0, 100.0):
        assert {r["raster_name"]: r["island"] for r in clusters.sweep(df, blocks=blocks).collect()} == want


def test_class_algebra(spark):
    c = {0: [0.2, 0.2, 0.5, 0.3], 1: [0.2, 0, 0, 0.1], 2: [0.1, 0, 0, 0.1], 3: [0.4, 0.4, 0, 0.1], 4: [0, 0, 0.5, 0.3], 5: [0.1, 0.4, 0, 0.1]}
    rows = [(f"v{k}", *[float(c[j][k]) for j in range(6)]) for k in range(4)]
    df = spark.createDataFrame(rows, "vector_name string, " + ", ".join(f"prob_of_class_{j} double" for j in range(6)))
    groups = classes.grouping([["1", "2", "5"], "3"], ["new1", "new2"], list("012345"))
    got = {r["vector_name"]: (round(r["prob_of_class_new1"], 9), round(r["prob_of_class_new2"], 9), r["most_likely_class"]) for r in classes.combine_soft(df, groups).collect()}
    assert got == {"v0": (0.5, 0.5, "new1,new2"), "v1": (0.5, 0.5, "new1,new2"), "v3": (0.75, 0.25, "new1")}
    assert classes.combined_attrs({"background_class": "0"}, groups) == {"background_class": None, "task_vector_classes": ["new1", "new2"]}
    assert classes.combined_attrs({"background_class": "3"}, groups)["background_class"] == "new2"
    assert classes.grouping([["a", "b"]], None, ["a", "b"]) == {"a+b": ["a", "b"]}
    for bad in ([["1"], ["1"]], [["9"]]):
        with pytest.raises(ValueError):
            classes.grouping(bad, None, list("012345"))
    hard = classes.soft_to_categorical(df, list("012345"))
    assert {r["vector_name"]: r["type"] for r in hard.collect()} == {"v0": "3", "v1": "3", "v2": "0", "v3": "0"}
    assert not [x for x in hard.columns if x.startswith("prob")]


def test_graph(spark):
    e = spark.createDataFrame([("v1", "r1", "contains"), ("v1", "r2", "intersects"), ("v2", "r2", "contains")], "vector_name string, raster_name string, relation string")
    assert {r[0] for r in graph.vertices_opposite(e, "v1", "vector_name").collect()} == {"r1", "r2"}
    assert {r[0] for r in graph.vertices_opposite(e, "r2", "raster_name", "contains").collect()} == {"v2"}
    assert graph.exists_edge(e, "v1", "r1") and not graph.exists_edge(e, "v2", "r1") and graph.edge_data(e, "v1", "r2") == "intersects"
    with pytest.raises(KeyError):
        graph.edge_data(e, "v2", "r1")
    again = spark.createDataFrame([("v1", "r1", "intersects")], e.schema)
    with pytest.raises(ValueError):
        graph.add_edges(e, again)
    assert graph.edge_data(graph.add_edges(e, again, force=True), "v1", "r1") == "intersects"
    one = spark.createDataFrame([("v1",)], "vector_name string")
    assert graph.delete_vertices(e, one, "vector_name").count() == 1
    with pytest.raises(ValueError):
        graph.delete_vertices(e, one, "vector_name", force=False)
    assert graph.delete_vertices(e, spark.createDataFrame([("nobody",)], "vector_name string"), "vector_name", force=False).count() == 3
    assert graph.delete_edges(e, again).count() == 2 and graph.equal(e, e.orderBy("raster_name")) and not graph.equal(e, again)
    assert graph.opposite("vector_name") == "raster_name"
    with pytest.raises(ValueError):
        graph.opposite("colour")


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000), (7, 7), (6001, 6000), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)} | {5000: 5000, 6000: 6000, 6001: 6000}
    assert got == want
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", few=10_000).collect()} == want
    for few in (0, 10):
        assert components(spark.createDataFrame([], "a long, b long"), "a", "b", few).count() == 0


def test_preclusters_of_both_axes_and_of_some_rasters(spark):
    """Two columns of two apart in y; a fifth raster overlaps both columns in x, but at another height."""
    r = boxes(spark, "raster_name", {"a1": (0, 0, 4, 4), "a2": (0, 10, 4, 14), "b1": (6, 0, 9, 4), "b2": (6, 10, 9, 14), "wide": (3, 30, 7, 33)})
    d = SpatialDataset.from_scratch(spark, None, r)

    def groups(*args):
        out = {}
        for x in clusters.precluster(*args).collect():
            out.setdefault(x["island"], set()).add(x["raster_name"])
        return sorted(map(sorted, out.values()))

    assert groups(d.rasters, d.vectors, d.edges, "x") == [["a1", "a2", "b1", "b2", "wide"]]
    assert groups(d.rasters, d.vectors, d.edges, "xy") == [["a1", "b1"], ["a2", "b2"], ["wide"]]
    assert groups(d.rasters, d.vectors, d.edges, "yx") == [["a1"], ["a2"], ["b1"], ["b2"], ["wide"]]
    some = spark.createDataFrame([("a1",), ("b1",), ("b2",)], "raster_name string")
    assert groups(d.rasters, d.vectors, d.edges, "x", some) == [["a1"], ["b1", "b2"]]
    found = clusters.raster_clusters(d.rasters, d.edges, "overlap", some).collect()
    assert len(found) == 3 and len({x["cluster"] for x in found}) == 3
    with pytest.raises(ValueError):
        clusters.precluster(d.rasters, d.vectors, d.edges, "z")


def test_join_facts_with_a_hot_key(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(6000)] + [(9999, None)], "id long, key string")
    facts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1 or key < 'k3'")
    got = {r["id"]: r["low"] for r in join_facts(rows, facts, ["key"], ["low"], "n", F.col("id"), 6001).collect()}
    assert len(got) == 6001 and got[1] == 1 and got[2] == 1 and got[9999] is None and got[3000] is None and got[12] == 12


def test_shared_rasters_when_planning(spark):
    """Two pairs of near vectors: a raster taken for one serves the other; the far pair has one raster only."""
    v = boxes(spark, "vector_name", {"a1": (0, 0, 1, 1), "a2": (2, 2, 3, 3), "b1": (50, 50, 51, 51), "b2": (52, 52, 53, 53)})
    c = boxes(spark, "raster_name", {"t1": (-5, -5, 9, 9), "t2": (-6, -6, 8, 8), "t3": (40, 40, 60, 60), "t4": (0.5, 0.5, 2.5, 2.5)})
    empty = SpatialDataset.from_scratch(spark, v)
    from swathe.functions.geometry import with_bounds

    catalog = with_bounds(c).withColumn("score", F.when(F.col("raster_name") == "t1", 2).otherwise(1))
    edges = spatial_edges(empty.vectors, catalog)
    for target, want in ((1, {"t1", "t3"}), (2, {"t1", "t2", "t3"})):
        plan = planning.plan_downloads(empty.vectors, edges, catalog, target, "score")
        assert {r["raster_name"] for r in plan.collect()} == want


def test_derived_datasets_are_updated_by_adding(spark):
    from swathe.operators import derive

    v = boxes(spark, "vector_name", {"a": (1, 1, 3, 3), "b": (2, 2, 4, 5), "c": (90, 90, 91, 92)})
    r = boxes(spark, "raster_name", {"x.tif": (0, 0, 20, 20), "y.tif": (80, 80, 100, 100)})
    d = SpatialDataset.from_scratch(spark, v, r)
    grid = derive.cut_grid(d, derive.GridCut(10, 10))
    assert consistent(grid.target).rasters.count() == 8 and grid.cut_log.count() == 2
    assert {e[:2] for e in edges_of(grid.target) if e[2] == "c"} >= {("a", "x_1_0.tif"), ("b", "x_1_0.tif")}
    same = derive.cut_grid(d, derive.GridCut(10, 10), grid)
    assert same.target.rasters.count() == 8
    more = d.add_rasters(boxes(spark, "raster_name", {"z.tif": (0, 0, 10, 10)})).add_vectors(boxes(spark, "vector_name", {"n": (5, 5, 6, 6)}))
    again = derive.cut_grid(more, derive.GridCut(10, 10), grid)
    assert consistent(again.target).rasters.count() == 9 and again.target.vectors.count() == 4
    assert {x[0] for x in again.relabel.collect()} == {"x_1_0.tif"}
    around = derive.cut_around(d, derive.AroundCut(1, 8, 8, mode="centered"))
    counts = {x["vector_name"]: x["raster_count"] for x in consistent(around.target).vectors.collect()}
    assert counts == {"a": 1, "b": 1, "c": 1} and around.target.rasters.count() == 2  # one cutout serves a and b
    assert derive.cut_around(d, derive.AroundCut(1, 8, 8, mode="centered"), around).target.rasters.count() == 2
    kinds = d.vectors.withColumn("type", F.when(F.col("vector_name") == "c", "far").otherwise("near"))
    combined = derive.combine_dataset(SpatialDataset(kinds, d.rasters, d.edges, d.attrs), {"kept": ["near"]})
    assert {x[0] for x in combined.rasters.select("raster_name").collect()} == {"x.tif"} and combined.vectors.count() == 2


def test_interchange_folder(spark, tmp_path):
    v = boxes(spark, "vector_name", {"p1": (0, 0, 1, 1), "p2": (40, 4, 41, 5)}).withColumn("type", F.lit("k"))
    d = SpatialDataset.from_scratch(spark, v, boxes(spark, "raster_name", {"r1": (-1, -1, 2, 2)}), background_class="b")
    d.export(str(tmp_path / "x"))
    back = SpatialDataset.from_data_dir(spark, str(tmp_path / "x"))
    assert edges_of(consistent(back)) == edges_of(d) and back.attrs == d.attrs
    assert {x["vector_name"]: x["type"] for x in back.vectors.collect()} == {"p1": "k", "p2": "k"}
