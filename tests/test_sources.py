import dataclasses
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.operators import windows
from swathe.operators.join import spatial_edges
from swathe.plans import recipe
from swathe.sources import files, geojson, tiff
from swathe.streaming.maintain import stream_edges

QUAD = [[13.5, 52.2, 0], [13.6, 53.2, 0], [12.0, 53.2, 0], [11.9, 52.2, 0], [13.5, 52.2, 0]]
SHAPES = {
    "quad": ("Polygon", [QUAD]),
    "two": ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]),
    "spot": ("Point", [1, 2]),
    "spots": ("MultiPoint", [[1, 2], [3, 4]]),
    "way": ("LineString", [[0, 0], [1, 1]]),
    "ways": ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]),
}


@pytest.mark.parametrize("lines", [False, True])
def test_geojson_there_and_back(spark, tmp_path, lines):
    features = [{"type": "Feature", "properties": {"vector_name": n, "raster_count": k, "say": 'a "b"'}, "geometry": {"type": t, "coordinates": c}} for k, (n, (t, c)) in enumerate(SHAPES.items())]
    features.append({"type": "Feature", "id": "bare", "properties": {}, "geometry": None})
    text = "\n".join(map(json.dumps, features)) if lines else json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
    (tmp_path / "in.geojson").write_text(text)
    df = geojson.read_geojson(spark, str(tmp_path / "in.geojson"), "vector_name", {"raster_count": "long", "say": "string"}, lines=lines)
    rows = {r["vector_name"]: r for r in df.collect()}
    assert rows.keys() == {*SHAPES, "bare"} and rows["bare"]["geom"] is None and rows["ways"]["raster_count"] == 5
    assert (rows["quad"]["minx"], rows["quad"]["maxy"]) == (11.9, 53.2) and len(rows["two"]["geom"]["parts"]) == 2
    geojson.write_geojson(df, str(tmp_path / "out"), "vector_name")
    back = {r["vector_name"]: r for r in geojson.read_geojson(spark, str(tmp_path / "out"), "vector_name", {"raster_count": "long", "say": "string"}, lines=True).collect()}
    assert {n: r["geom"] for n, r in back.items()} == {n: r["geom"] for n, r in rows.items()} and back["quad"]["say"] == 'a "b"'
    assert set(geojson.read_geojson(spark, str(tmp_path / "in.geojson"), "vector_name", lines=lines).columns) >= {"raster_count", "say"}
    kml = [r[0] for r in geojson.kml_placemarks(df.where("vector_name in ('quad', 'two')"), "vector_name", "say").collect()]
    assert len(kml) == 2 and all(x.startswith("<Placemark><name>") and "<Polygon>" in x for x in kml)


def test_adjacency_there_and_back(spark, tmp_path):
    edges = spark.createDataFrame([("a", "x", "contains"), ("a", "y", "intersects")], "vector_name string, raster_name string, relation string")
    v, r = spark.createDataFrame([("a",), ("b",)], "vector_name string"), spark.createDataFrame([("x",), ("y",), ("z",)], "raster_name string")
    text = geojson.adjacency_text(v, r, edges)
    assert json.loads(text) == {"vectors": {"a": {"x": "contains", "y": "intersects"}, "b": {}}, "rasters": {"x": {"a": "contains"}, "y": {"a": "intersects"}, "z": {}}}
    (tmp_path / "g.json").write_text(text)
    assert sorted(map(tuple, geojson.read_adjacency(spark, str(tmp_path / "g.json")).collect())) == sorted(map(tuple, edges.collect()))
    (tmp_path / "bad.json").write_text('{"vectors": {"a": {"x": "contains"}}, "rasters": {"x": {}}}')
    with pytest.raises(ValueError):
        geojson.read_adjacency(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4", "f8"])
@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_there_and_back(dtype, deflate):
    x = np.arange(3 * 20 * 30).reshape(3, 20, 30).astype(dtype)
    data = tiff.write_tiff(x, (10.0, 0.0, 500000.0, 0.0, -10.0, 5800000.0), 32632, deflate)
    h = tiff.read_header(data)
    assert (h.width, h.height, h.bands, h.epsg, h.bounds) == (30, 20, 3, 32632, (500000.0, 5799800.0, 500300.0, 5800000.0))
    assert (tiff.read_window(data) == x).all()
    part = tiff.read_window(data, [3, 1], (25, 15, 10, 10))
    assert (part[:, :5, :5] == x[[2, 0], 15:, 25:]).all() and not part[:, 5:].any()
    with pytest.raises(ValueError):
        tiff.read_window(data, [4])
    with pytest.raises(ValueError):
        tiff.read_header(b"no picture")
    turned = tiff.write_tiff(x[:1], (1.0, 2.0, 3.0, 4.0, 5.0, 6.0), 4326, deflate)
    assert tiff.read_header(turned).affine == (1.0, 2.0, 3.0, 4.0, 5.0, 6.0) and tiff.read_header(turned).epsg == 4326


def test_scanning_and_cutting_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"t{k}.tif").write_bytes(tiff.write_tiff(np.full((2, 16, 16), k, "u1"), (10.0, 0.0, 500000.0 + 160 * k, 0.0, -10.0, 5800000.0), 32632))
    (tmp_path / "broken.tif").write_bytes(b"II*\0")
    (tmp_path / "note.txt").write_text("no raster")
    found = tiff.scan_rasters(spark, str(tmp_path), 32632)
    rows = {r["raster_name"]: r for r in found.collect()}
    assert rows.keys() == {"t0.tif", "t1.tif", "t2.tif"} and rows["t1.tif"]["minx"] == 500160.0 and rows["t1.tif"]["n_bands"] == 2
    degrees = tiff.scan_rasters(spark, str(tmp_path), 4326).where("raster_name = 't0.tif'").first()
    assert 8.9 < degrees["minx"] < degrees["maxx"] < 9.1 and 52.3 < degrees["miny"] < degrees["maxy"] < 52.4
    cuts = windows.grid_windows(found, 8, 8).select("raster_name", "new_name", "col_off", "row_off", "w", "h")
    made = {r["new_name"]: bytes(r["content"]) for r in tiff.cut_files(found, cuts).collect()}
    assert len(made) == 12
    h = tiff.read_header(made["t2_1_0.tif"])
    assert h.bounds == (500320.0, 5799840.0, 500400.0, 5799920.0) and (tiff.read_window(made["t2_1_0.tif"]) == 2).all()
    arrays = tiff.cut_files(found, cuts, [2], "npy").collect()
    assert {r["new_name"] for r in arrays} == {n.replace(".tif", ".npy") for n in made}
    import io

    assert np.load(io.BytesIO(bytes(arrays[0]["content"]))).shape == (8, 8, 1)
    assert np.load(io.BytesIO(tiff.npy_bytes(np.zeros((1, 4, 5)), squeeze=True))).shape == (4, 5)


def test_only_what_a_window_needs_is_read(tmp_path):
    x = np.arange(2 * 1024 * 512, dtype="u2").reshape(2, 1024, 512)
    (tmp_path / "big.tif").write_bytes(tiff.write_tiff(x, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 32632, deflate=False, strip=32))
    with files.open_path(f"file://{tmp_path}/big.tif") as f:
        data = files.Ranged(f)
        assert tiff.read_header(data).width == 512 and data.read < 2000
        data.read = 0
        got = tiff.read_window(data, [2], (100, 40, 50, 20), tiff.read_header(data))
        assert (got[0] == x[1, 40:60, 100:150]).all() and data.read < 40_000


def test_a_raster_to_3600_cutouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    x = np.arange(1080 * 1080, dtype="u2").reshape(1, 1080, 1080)
    (tmp_path / "in/tile.tif").write_bytes(tiff.write_tiff(x, (10.0, 0.0, 500000.0, 0.0, -10.0, 5800000.0), 32632))
    found = tiff.scan_rasters(spark, f"{tmp_path}/in", 32632)
    cuts = windows.grid_windows(found, 18, 18)
    done = files.write_files(tiff.cut_files(found, cuts), f"{tmp_path}/out").collect()
    assert len(done) == len(list((tmp_path / "out").iterdir())) == 3600
    data = (tmp_path / "out/tile_59_3.tif").read_bytes()
    assert (tiff.read_window(data)[0] == x[0, 59 * 18 :, 54:72]).all() and tiff.read_header(data).bounds[0] == 500540.0
    gone = files.delete_files(spark.createDataFrame([(done[0]["path"],), (f"{tmp_path}/none",)], "path string")).collect()
    assert sorted(r["deleted"] for r in gone) == [False, True] and len(list((tmp_path / "out").iterdir())) == 3599
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(spark.createDataFrame([("../x", b"1")], "new_name string, content binary"), str(tmp_path)).collect()


def test_directories_are_cut_alike_and_converted(spark, tmp_path):
    def put(kind, name, bands, shift=0.0):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / name).write_bytes(tiff.write_tiff(np.arange(bands * 256, dtype="u1").reshape(bands, 16, 16), (1.0, 0.0, shift, 0.0, -1.0, 16.0), 4326))

    for name in ("p.tif", "q.tif"):
        put("rasters", name, 3)
        put("masks", name, 2)
    put("labels", "p.tif", 1)
    folders = {k: f"{tmp_path}/{k}" for k in ("rasters", "masks", "labels")}
    out = {k: f"{tmp_path}/out/{k}" for k in folders}
    cuts = windows.grid_windows(tiff.scan_rasters(spark, folders["rasters"], 4326), 8, 8)
    done = tiff.cut_directories(spark, folders, cuts, out, bands={"rasters": [3, 1], "masks": None, "labels": [1]}).collect()
    assert {k: sum(r["kind"] == k for r in done) for k in folders} == {"rasters": 8, "masks": 8, "labels": 4}
    got = tiff.read_window((tmp_path / "out/rasters/q_1_0.tif").read_bytes())
    assert (got == np.arange(768, dtype="u1").reshape(3, 16, 16)[[2, 0], 8:, :8]).all()
    with pytest.raises(KeyError):
        tiff.cut_directories(spark, folders, cuts, out, bands={"rasters": [1]})
    with pytest.raises(ValueError, match="missing"):
        tiff.cut_directories(spark, folders, cuts, out, optional=())
    put("labels", "q.tif", 1, shift=0.5)
    with pytest.raises(ValueError, match="differ"):
        tiff.cut_directories(spark, folders, cuts, out)
    arrays = tiff.convert_to_npy(spark, folders, {k: f"{tmp_path}/npy/{k}" for k in folders}, {"rasters": [2], "masks": None, "labels": None}).collect()
    assert len(arrays) == 6 and np.load(tmp_path / "npy/rasters/p.npy").shape == (16, 16) and np.load(tmp_path / "npy/masks/p.npy").shape == (16, 16, 2)
    assert {r[0] for r in tiff.npy_table(cuts.limit(1)).select("raster_name").collect()} <= {"p.npy", "q.npy"}


def test_label_files(spark, tmp_path):
    rasters = windows.with_pixels(spark.createDataFrame([("r.tif", 0.0, 0.0, 4.0, 3.0), ("s.tif", 0.0, 0.0, 2.0, 2.0)], "raster_name string, minx double, miny double, maxx double, maxy double"))
    pixels = spark.createDataFrame([("r.tif", 0, 1, 2, 0.25), ("r.tif", 2, 3, 1, 0.5)], "raster_name string, row int, col int, label int, p double")
    made = {r["raster_name"]: bytes(r["content"]) for r in tiff.label_files(pixels, rasters).collect()}
    assert tiff.read_window(made["r.tif"])[0].tolist() == [[0, 2, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]] and tiff.read_header(made["r.tif"]).dtype == np.uint8
    assert not tiff.read_window(made["s.tif"]).any()
    soft = pixels.withColumn("rest", 1 - F.col("p"))
    got = {r["raster_name"]: tiff.read_window(bytes(r["content"])) for r in tiff.label_files(soft, rasters, ("rest", "p"), "float32", (1, 0)).collect()}
    assert got["r.tif"].dtype == np.float32 and got["r.tif"][:, 0, 1].tolist() == [0.75, 0.25] and got["s.tif"][0].all()
    wrong = tiff.label_mismatches(rasters, spark.createDataFrame([("r.tif",), ("x.tif",)], "raster_name string")).collect()
    assert {tuple(r) for r in wrong} == {("s.tif", "raster without label"), ("x.tif", "label without raster")}


def test_streamed_vectors_get_the_edges_of_a_batch_join(spark, tmp_path):
    schema = "vector_name string, minx double, miny double, maxx double, maxy double"
    rows = [(f"v{k}", float(k), float(k % 7), float(k + 2), float(k % 7 + 1)) for k in range(60)]
    rasters = spark.createDataFrame([(f"r{k}", k * 10.0, 0.0, k * 10.0 + 12, 9.0) for k in range(6)], schema.replace("vector", "raster"))
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_edges(stream, rasters, f"{tmp_path}/edges", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    cols = ["vector_name", "raster_name", "relation"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/edges").select(*cols).collect()))
    assert got == sorted(map(tuple, spatial_edges(spark.createDataFrame(rows, schema), rasters).select(*cols).collect()))


@dataclasses.dataclass
class Inner:
    sizes: tuple
    folder: Path


@dataclasses.dataclass
class Outer:
    name: str
    inner: Inner
    rest: dict


def test_recipes_there_and_back():
    part = Outer("x", Inner((1, 2.5, None), Path("/a/b")), {"k": [1, True], "$kind": "odd", "deep": {"t": (1,)}})
    assert recipe.loads(recipe.dumps(part), {"Inner": Inner, "Outer": Outer}) == part
    with pytest.raises(ValueError):
        recipe.loads(recipe.dumps(part), {"Outer": Outer})
    with pytest.raises(TypeError):
        recipe.dumps({"x": object()})
