import math

import pytest
from pyspark.sql import functions as F

from swathe.functions import crs
from swathe.functions import geometry as G
from swathe.operators import labels, windows
from swathe.operators.join import _gridded, box_pairs, grid_levels, spatial_edges


def polygon(*points, holes=()):
    rings = [list(points), *map(list, holes)]
    return ("Polygon", [[[(float(x), float(y)) for x, y in [*r, r[0]]] for r in rings]])


def line(*points):
    return ("LineString", [[[(float(x), float(y)) for x, y in points]]])


def point(x, y):
    return ("Point", [[[(float(x), float(y))]]])


SQUARE = polygon((0, 0), (4, 0), (4, 4), (0, 4))
RING = polygon((0, 0), (10, 0), (10, 10), (0, 10), holes=[[(3, 3), (7, 3), (7, 7), (3, 7)]])
BENT = polygon((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))  # a U
SLANT = polygon((0, 5), (5, 0), (10, 5), (5, 10))
CASES = [
    (SQUARE, polygon((1, 1), (2, 1), (2, 2)), True, True),
    (SQUARE, polygon((0, 0), (2, 0), (2, 2), (0, 2)), True, True),  # shares a border
    (SQUARE, SQUARE, True, True),
    (SQUARE, polygon((4, 0), (6, 0), (6, 4), (4, 4)), True, False),  # touches
    (SQUARE, polygon((5, 5), (6, 5), (6, 6)), False, False),
    (SQUARE, polygon((-1, -1), (9, -1), (9, 9), (-1, 9)), True, False),  # inside the other
    (RING, polygon((4, 4), (6, 4), (6, 6), (4, 6)), False, False),  # in the hole
    (RING, polygon((1, 1), (9, 1), (9, 9), (1, 9)), True, False),  # around the hole
    (RING, polygon((1, 1), (2, 1), (2, 9), (1, 9)), True, True),
    (BENT, polygon((1, 1), (9, 1), (9, 9), (1, 9)), True, False),
    (BENT, polygon((0, 5), (10, 5), (10, 6), (0, 6)), True, False),  # corners on the border, middle outside
    (BENT, polygon((3, 3), (7, 3), (7, 9), (3, 9)), False, False),  # in the gap, inside the bounds
    (SLANT, polygon((4, 4), (6, 4), (6, 6), (4, 6)), True, True),
    (SLANT, polygon((0, 0), (1, 0), (1, 1), (0, 1)), False, False),  # inside the bounds alone
    (SQUARE, point(2, 2), True, True),
    (SQUARE, point(0, 2), True, False),  # on the border
    (SQUARE, point(9, 9), False, False),
    (SQUARE, line((1, 1), (3, 3)), True, True),
    (SQUARE, line((0, 0), (4, 0)), True, False),
    (SQUARE, line((-1, 2), (5, 2)), True, False),
    (point(1, 1), point(1, 1), True, False),
    (line((0, 0), (2, 2)), line((0, 2), (2, 0)), True, False),
]


def test_predicates_and_join(spark):
    rows = [(f"c{k}", a, b, i, c) for k, (a, b, i, c) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"name string, a {G.SHAPE}, b {G.SHAPE}, i boolean, c boolean")
    a, b = F.col("a"), F.col("b")
    out = df.select("name", "i", "c", G.intersects(a, b).alias("gi"), G.intersects(b, a).alias("gj"), G.contains(a, b).alias("gc"))
    for r in out.collect():
        assert (r["gi"], r["gj"], r["gc"]) == (r["i"], r["i"], r["c"]), r
    far = df.select("name", *[G.map_points(F.col(x), lambda p, q: (p + F.expr("int(substr(name, 2)) * 100"), q)).alias(x) for x in "ab"])  # cases apart
    edges = spatial_edges(
        G.with_bounds(far.select(F.col("name").alias("vector_name"), F.col("b").alias("geom"))), G.with_bounds(far.select(F.col("name").alias("raster_name"), F.col("a").alias("geom")))
    )
    got = {(r["vector_name"], r["relation"]) for r in edges.collect()}
    assert got == {(f"c{k}", "contains" if c else "intersects") for k, (_, _, i, c) in enumerate(CASES) if i}


def test_box_join_of_all_sizes_equals_all_pairs(spark):
    rows = [(k, float((k * 37) % 101 - 50), float((k * 53) % 97 - 50), float((1 << k % 9) - 1) / 2) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double").selectExpr("id", "x AS minx", "y AS miny", "x + w AS maxx", "y + w AS maxy")
    got = sorted((r["l_id"], r["r_id"]) for r in box_pairs(df, df).collect())
    want = sorted((a, b) for a, ax, ay, aw in rows for b, bx, by, bw in rows if ax <= bx + bw and bx <= ax + aw and ay <= by + bw and by <= ay + aw)
    assert got == want


@pytest.mark.parametrize("unit", [1.0, 1e-3, 1e5])
def test_join_tests_few_pairs_in_any_unit(spark, unit):
    """Small boxes around one place, in degrees or in metres: the pairs that share a cell are a bounded multiple of the hits."""
    side, n = 0.02 * unit, 60
    df = spark.range(n * n).selectExpr("id", *[f"(id {op} {n}) * {side * 1.5} + {13.3 * unit} AS min{a}" for a, op in (("x", "%"), ("y", "div"))])
    df = df.selectExpr("*", *[f"min{a} + {side} AS max{a}" for a in "xy"])
    finest, left, right = grid_levels(df, df)
    assert left == right == [finest] and side <= 2.0**finest < 2 * side
    cells = _gridded(df, finest, right, "g_").groupBy("g_level", "g_cx", "g_cy").count().selectExpr("sum(count * count)").first()[0]
    assert box_pairs(df, df).count() == n * n and cells < 40 * n * n


def test_join_of_points_alone(spark):
    df = spark.createDataFrame([(k, float(k % 7) / 1000, float(k % 5)) for k in range(70)], "id long, x double, y double").selectExpr("id", "x AS minx", "y AS miny", "x AS maxx", "y AS maxy")
    assert box_pairs(df, df).count() == 70 * 2
    assert box_pairs(df.limit(0), df).count() == 0


def test_bounds_in_another_system(spark):
    box = spark.createDataFrame([(500000.0, 5799800.0, 509000.0, 5800000.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    x0, y0, x1, y1 = box.select(*crs.transform_bounds(*cols, 32632, 4326)).first()
    assert 8.99 < x0 <= 9.0 < x1 < 9.2 and 52.3 < y0 < y1 < 52.4
    back = box.select(*crs.transform_bounds(*cols, 32632, 32633)).first()
    corner = box.select(*crs.from_degrees(*crs.to_degrees(F.col("a"), F.col("b"), 32632), 32633)).first()
    assert back[0] - 1e-6 <= corner[0] <= back[2] and back[1] - 1e-6 <= corner[1] <= back[3]
    shape = box.select(crs.transform(G.box_shape(*cols), 32632, 32633).alias("g"))
    r = G.with_bounds(shape.withColumnRenamed("g", "geom")).first()
    assert [r[c] for c in G.BOX] == pytest.approx(list(back), abs=30)


def test_bounds_rounding_and_boxes(spark):
    df = G.with_bounds(spark.createDataFrame([(SQUARE,), (SLANT,), (point(1, 2),)], f"geom {G.SHAPE}"))
    assert [(r["minx"], r["maxy"], r["is_box"]) for r in df.collect()] == [(0.0, 4.0, True), (0.0, 10.0, False), (1.0, 2.0, False)]
    r = df.limit(1).select(G.rounded(G.map_points(F.col("geom"), lambda x, y: (x + 0.125, y + 0.375)), 2).alias("g")).first()["g"]
    assert r["parts"][0][0][0]["x"] == 0.12 and r["parts"][0][0][0]["y"] == 0.38


@pytest.mark.parametrize("epsg", [3857, 32632, 32633, 32729])
def test_systems_there_and_back(spark, epsg):
    lon0 = 9.0 if epsg == 3857 else epsg % 100 * 6 - 183
    places = [(lon0 + dx, lat) for dx in (-3.5, -1, 0, 2.9) for lat in (-70, -38.7, 0, 52.5, 80)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in places], "x double, y double")
    moved = crs.from_degrees(F.col("x"), F.col("y"), epsg)
    back = df.select("x", "y", moved[0].alias("e"), moved[1].alias("n")).select("x", "y", *crs.to_degrees(F.col("e"), F.col("n"), epsg))
    for x, y, bx, by in back.collect():
        assert abs(x - bx) < 1e-7 and abs(y - by) < 1e-7


def test_known_coordinates(spark):
    one = spark.range(1)
    e, n = one.select(*crs.from_degrees(F.lit(9.0), F.lit(0.0), 32632)).first()
    assert e == pytest.approx(500000) and n == pytest.approx(0, abs=1e-6)
    e, n = one.select(*crs.from_degrees(F.lit(9.0), F.lit(45.0), 32632)).first()
    assert e == pytest.approx(500000) and n == pytest.approx(4982950.400, abs=0.01)  # meridian arc 4984944.378 * 0.9996
    x, y = one.select(*crs.from_degrees(F.lit(180.0), F.lit(0.0), 3857)).first()
    assert x == pytest.approx(math.pi * 6378137) and abs(y) < 1e-6
    with pytest.raises(ValueError):
        crs.from_degrees(F.lit(0.0), F.lit(0.0), 2154)


def test_grid_of_a_tile(spark):
    tile = spark.createDataFrame([("tile.tif", 0.0, 0.0, 10980.0, 10980.0)], "raster_name string, minx double, miny double, maxx double, maxy double")
    cut = windows.footprint(windows.grid_windows(windows.with_pixels(tile), 183, 183))
    assert cut.count() == 3600
    last = cut.where("new_name = 'tile_59_0.tif'").first()
    assert (last["col_off"], last["row_off"], last["miny"], last["maxx"]) == (0, 59 * 183, 0.0, 183.0)
    small = windows.with_pixels(tile.withColumn("maxx", F.lit(100.0)))
    assert windows.grid_windows(small, 183, 183).count() == 0


def test_pixels_of_a_slanted_shape(spark):
    v = G.with_bounds(spark.createDataFrame([("s", SLANT), ("b", polygon((0, 0), (2, 0), (2, 3), (0, 3)))], f"vector_name string, geom {G.SHAPE}"))
    r = windows.with_pixels(spark.createDataFrame([("r", 0.0, 0.0, 10.0, 10.0)], "raster_name string, minx double, miny double, maxx double, maxy double"))
    edges = spark.createDataFrame([("s", "r"), ("b", "r")], "vector_name string, raster_name string")
    got = {(p["vector_name"], p["row"], p["col"]) for p in labels.covered_pixels(edges, v, r).collect()}
    inside = {("s", row, col) for row in range(10) for col in range(10) if abs(col + 0.5 - 5) + abs(10 - row - 0.5 - 5) < 5}
    assert {p for p in got if p[0] == "s"} >= inside and len({p for p in got if p[0] == "s"} - inside) <= 20  # centres on the border may go either way
    assert {p for p in got if p[0] == "b"} == {("b", row, col) for row in (7, 8, 9) for col in (0, 1)}
    kinds = v.withColumn("type", F.when(F.col("vector_name") == "s", "one").otherwise("two"))
    burnt = labels.label_categorical(edges, kinds, r, ["one", "two"])
    lines = {x["row"]: x["label"] for x in labels.dense(burnt, r, ["label"]).collect()}
    assert len(lines) == 10 and lines[9][:2] == [2, 2] and lines[5][5] == 1 and lines[0][0] == 0
    with pytest.raises(ValueError):
        labels.check_types(kinds, ["one"])


def test_clipping_to_a_box(spark):
    rows = [("square", SQUARE, (1, 1, 9, 3), 6.0, (1, 1, 4, 3)), ("slant", SLANT, (0, 0, 5, 5), 12.5, (0, 0, 5, 5)), ("ring", RING, (0, 0, 5, 10), 50 - 8.0, (0, 0, 5, 10)),
            ("bent", BENT, (0, 5, 10, 10), 20.0, (0, 5, 10, 10)), ("apart", SQUARE, (5, 5, 6, 6), None, None), ("touch", SQUARE, (4, 0, 6, 6), None, None), ("whole", SLANT, (-9, -9, 99, 99), 50.0, (0, 0, 10, 10))]
    df = spark.createDataFrame([(n, g, *map(float, b)) for n, g, b, _, _ in rows], f"name string, g {G.SHAPE}, a double, b double, c double, d double")
    got = G.with_bounds(df.select("name", G.clip_to_box(F.col("g"), *[F.col(x) for x in "abcd"]).alias("geom"))).withColumn("area", G.area(F.col("geom")))
    found = {r["name"]: r for r in got.collect()}
    for name, _, _, size, box in rows:
        assert found[name]["area"] == (None if size is None else pytest.approx(size)), name
        assert box is None or tuple(found[name][c] for c in G.BOX) == pytest.approx(box)


def test_an_inner_edge_through_corners_of_the_outer_shape(spark):
    """From one tip of the outer shape to the next through the open gap between them: no proper crossing."""
    zigzag = polygon((0, 0), (12, 0), (12, 4), (9, 2), (6, 4), (3, 2), (0, 4))
    rows = [("out", zigzag, polygon((0, 4), (12, 4), (6, 0)), False), ("in", zigzag, polygon((0, 0), (12, 0), (6, 2)), True), ("flat", zigzag, line((0, 4), (12, 4)), False)]
    df = spark.createDataFrame(rows, f"name string, a {G.SHAPE}, b {G.SHAPE}, c boolean")
    for r in df.select("name", "c", G.contains(F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == r["c"], r


def test_union_coverage_of_slanted_footprints(spark):
    left, right = polygon((-1, -1), (5, -1), (5, 11), (-1, 11)), polygon((4, -2), (12, -1), (11, 12), (5, 11))
    names = {"both": polygon((0, 0), (10, 0), (10, 10), (0, 10)), "slant": SLANT, "bent": BENT, "beyond": polygon((3, 3), (40, 3), (3, 20))}
    v = G.with_bounds(spark.createDataFrame(list(names.items()), f"vector_name string, geom {G.SHAPE}"))
    r = G.with_bounds(spark.createDataFrame([("l", left), ("r", right)], f"raster_name string, geom {G.SHAPE}"))
    gap = G.with_bounds(spark.createDataFrame([("l", left), ("r", polygon((6, -2), (12, -1), (11, 12), (5, 11)))], f"raster_name string, geom {G.SHAPE}"))
    from swathe.operators.planning import not_covered_by_union

    assert {x[0] for x in not_covered_by_union(v, r, spatial_edges(v, r)).collect()} == {"beyond"}
    assert {x[0] for x in not_covered_by_union(v, gap, spatial_edges(v, gap)).collect()} == {"both", "slant", "bent", "beyond"}


def test_windows_around_a_slanted_vector(spark):
    """Windows that meet the bounds of a diagonal alone are left out."""
    thin = polygon((0, 0), (1, 0), (40, 39), (40, 40), (39, 40), (0, 1))
    v = G.with_bounds(spark.createDataFrame([("v", thin)], f"vector_name string, geom {G.SHAPE}"))
    r = windows.with_pixels(spark.createDataFrame([("r.tif", -20.0, -20.0, 60.0, 60.0)], "raster_name string, minx double, miny double, maxx double, maxy double"))
    pairs = spark.createDataFrame([("v", "r.tif")], "vector_name string, raster_name string")
    got = windows.around_vectors(pairs, r, v).collect()
    boxes = windows.around_vectors(pairs, r, v.drop("geom", "is_box")).collect()
    assert len(boxes) == 25 and 5 <= len(got) < 15 and {g["new_name"] for g in got} <= {b["new_name"] for b in boxes}
    half = windows.with_pixels(spark.createDataFrame([("r.tif", -20.0, -20.0, 20.0, 60.0)], "raster_name string, minx double, miny double, maxx double, maxy double"))
    part = windows.around_vectors(pairs, half, v, "variable", scaling=1.0).first()
    assert part["maxy"] < 30  # of the shape, not of its bounds, up to 21 lies in that raster
