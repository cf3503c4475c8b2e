"""Every query of the library that has SQL, against DuckDB on the smallest tables; greedy ones against plain loops."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from swathe import queries
from swathe.operators import planning
from swathe.operators.join import spatial_edges

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("part", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(r[i] for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def tables(duck):
    edges = duck.sql(queries.SQL["spatial_join_edges"]).fetchall()
    inside = {}
    for v, r, relation in edges:
        if relation == "contains":
            inside.setdefault(v, set()).add(r)
    return edges, inside


def test_plan_downloads_equals_one_loop(spark, duck):
    edges, inside = tables(duck)
    score = dict(duck.sql("SELECT concat('r', CAST(c_custkey AS VARCHAR), '.tif'), c_acctbal FROM customer").fetchall())
    have, taken = dict.fromkeys(inside, 0), {}
    for v in sorted(inside):
        for r in sorted(inside[v], key=lambda r: (-score[r], r)):
            if have[v] < 2 and r not in taken:
                taken[r] = v
                for m in inside:
                    have[m] += r in inside[m]
    assert {r["raster_name"]: r["for_vector"] for r in queries.plan_downloads(spark, SF).collect()} == taken


def test_plan_downloads_in_rounds_and_without_what_is_unavailable(spark):
    v, r = queries.vectors(spark, SF), queries.rasters(spark, SF)
    edges, v = spatial_edges(v, r), v.withColumn("raster_count", F.lit(0).cast("long"))
    whole = {tuple(x) for x in planning.plan_downloads(v, edges, r, 2, "score").collect()}
    assert {tuple(x) for x in planning.plan_downloads(v, edges, r, 2, "score", few=5).collect()} == whole
    gone = spark.createDataFrame([(x,) for x, _ in sorted(whole)[:3]], "raster_name string")
    rest = planning.plan_downloads(v, edges, r, 2, "score", gone)
    assert not {x[0] for x in rest.collect()} & {x for x, _ in sorted(whole)[:3]}
    with pytest.raises(ValueError):
        planning.plan_downloads(v, edges, r.unionAll(r.limit(1)), 2, "score")
    assert planning.downloaded_twice(rest, r.where("raster_name = 'none'")).count() == 0
    assert planning.downloaded_twice(rest.unionAll(rest.limit(1)), r.limit(0)).count() == 1
    failed = spark.createDataFrame([(sorted(whole)[0][0], "no such product")], "raster_name string, message string")
    plan = spark.createDataFrame(sorted(whole), "raster_name string, for_vector string")
    told = {x["vector_name"]: x["download_exception"] for x in planning.record_downloads(v, plan, failed).collect()}
    assert len(told) == v.count() and {k for k, x in told.items() if x} == {sorted(whole)[0][1]}


def plain_cuts(boxes, pixels, edges, target, size):
    """One loop over the vectors by name; centred windows of size x size pixels of one unit."""
    near, inside = {}, {}
    for v, r, relation in edges:
        near.setdefault(r, []).append(v)
        if relation == "contains":
            inside.setdefault(v, []).append(r)
    have, cut, out = dict.fromkeys(boxes, 0), set(), set()
    for v in sorted(inside):
        x0, y0, x1, y1 = boxes[v]
        for r in sorted(inside[v], key=lambda r: (int(hashlib.md5(f"10|{v}|{r}".encode()).hexdigest()[:8], 16), r)):
            if have[v] >= target:
                break
            if (v, r) in cut:
                continue
            cut.add((v, r))
            west, north = pixels[r]
            n_c, n_r = -(-(x1 - x0) // size), -(-(y1 - y0) // size)
            left = (x0 + x1 - 2 * west) // 2 - size * n_c // 2
            top = (2 * north - y0 - y1) // 2 - size * n_r // 2
            for i in range(n_r):
                for j in range(n_c):
                    a, d = west + left + j * size, north - top - i * size
                    if a > x1 or a + size < x0 or d < y0 or d - size > y1:
                        continue
                    out.add((v, r, a, d))
                    for m in near[r]:
                        b = boxes[m]
                        if a <= b[0] and b[2] <= a + size and d - size <= b[1] and b[3] <= d:
                            have[m] += 1
                            cut.add((m, r))
    return out


@pytest.mark.parametrize("few", [10, planning.FEW_CHOICES])
def test_cut_around_vectors_equals_one_loop(spark, duck, few):
    edges, _ = tables(duck)
    boxes = {r[0]: r[1:] for r in duck.sql(f"WITH {queries.BASE} SELECT vector_name, minx, miny, maxx, maxy FROM v").fetchall()}
    pixels = {r[0]: r[1:] for r in duck.sql(f"WITH {queries.BASE} SELECT raster_name, minx, maxy FROM r").fetchall()}
    d = queries.dataset(spark, SF)
    for target in (1, 2):
        got = planning.cut_around_vectors(d.vectors, d.rasters, d.edges, target, few=few).collect()
        assert {(c["vector_name"], c["raster_name"], c["minx"], c["maxy"]) for c in got} == plain_cuts(boxes, pixels, edges, target, 8)


@pytest.mark.parametrize("mode", ["random", "variable"])
def test_cut_around_vectors_with_pixels_of_other_sizes(spark, mode):
    """The same dataset in units of a tenth: with pixels of that size the windows are the same."""
    d = queries.dataset(spark, SF)
    small = [t.withColumns({c: F.col(c) / 16 for c in ("minx", "miny", "maxx", "maxy")}) for t in (d.vectors, d.rasters)]
    from swathe.operators.windows import with_pixels

    cols = ["vector_name", "raster_name", "new_name", "col_off", "row_off", "w", "h"]
    one = planning.cut_around_vectors(d.vectors, d.rasters, d.edges, mode=mode).select(*cols)
    other = planning.cut_around_vectors(small[0], with_pixels(small[1], 1 / 16), d.edges, mode=mode).select(*cols)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() > 20
