"""Baseline GeoTIFF files and .npy arrays with numpy and zlib alone: headers, windows, writing.

Strips or tiles, uncompressed or deflate, bands interleaved by pixel or in planes. Other codecs raise.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.functions.crs import transform_bounds
from swathe.plans.durable import durable, partitions_for
from swathe.sources.files import Opener, Ranged, open_path, write_files

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_FORMATS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Header:
    width: int
    height: int
    bands: int
    dtype: np.dtype
    epsg: int | None
    affine: tuple[float, float, float, float, float, float]  # x = a * col + b * row + c, y = d * col + e * row + f
    tags: dict[int, tuple]
    order: str

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.affine
        xs, ys = zip(*((a * i + b * j + c, d * i + e * j + f) for i in (0, self.width) for j in (0, self.height)))
        return min(xs), min(ys), max(xs), max(ys)


def read_header(data: bytes | Ranged) -> Header:
    """The first directory of a file; of a ``Ranged`` one only the parts that it names are read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a baseline TIFF file")
    at = struct.unpack(f"{order}I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    n_tags = struct.unpack(f"{order}H", data[at : at + 2])[0]
    entries = data[at + 2 : at + 2 + 12 * n_tags]
    for k in range(n_tags):
        tag, kind, n = struct.unpack_from(f"{order}HHI", entries, 12 * k)
        size = _SIZES.get(kind, 1) * n
        place = struct.unpack_from(f"{order}I", entries, 12 * k + 8)[0]
        body = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else data[place : place + size]
        tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", body) if kind in _CODES else (body,)
    bits, kind = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    if bits % 8 or kind not in _FORMATS:
        raise ValueError(f"samples of {bits} bits, format {kind}, are not supported")
    keys = tags.get(34735, ())
    epsg = next((keys[i + 3] for want in (3072, 2048) for i in range(4, len(keys) - 3, 4) if keys[i] == want and keys[i + 1] == 0), None)
    if 34264 in tags:
        m = tags[34264]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        sx, sy, (i, j, _, x, y, _) = *tags[33550][:2], tags[33922][:6]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        affine = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    return Header(tags[256][0], tags[257][0], tags.get(277, (1,))[0], np.dtype(f"{order}{_FORMATS[kind]}{bits // 8}"), epsg, affine, tags, order)


def read_window(data: bytes | Ranged, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, header: Header | None = None) -> np.ndarray:
    """(bands, rows, cols) of a window (col_off, row_off, width, height); pixels outside the raster are 0. Bands count from 1.

    Only the strips or tiles that meet the window are decoded.
    """
    h = header or read_header(data)
    codec, planar, predictor = h.tags.get(259, (1,))[0], h.tags.get(284, (1,))[0], h.tags.get(317, (1,))[0]
    if codec not in (1, 8, 32946) or predictor != 1:
        raise ValueError(f"compression {codec} with predictor {predictor} is not supported")
    bands = list(range(1, h.bands + 1)) if bands is None else list(bands)
    if bad := [b for b in bands if not 1 <= b <= h.bands]:
        raise ValueError(f"the file has no bands {bad}")
    x0, y0, w, n = window or (0, 0, h.width, h.height)
    out = np.zeros((len(bands), n, w), h.dtype.newbyteorder("="))
    tiled = 322 in h.tags
    tw, th = (h.tags[322][0], h.tags[323][0]) if tiled else (h.width, min(h.tags.get(278, (h.height,))[0], h.height))
    places, sizes = (h.tags[324], h.tags[325]) if tiled else (h.tags[273], h.tags[279])
    across, down = -(-h.width // tw), -(-h.height // th)
    planes = h.bands if planar == 2 else 1
    near_x, near_y = range(max(x0 // tw, 0), min((x0 + w - 1) // tw + 1, across)), range(max(y0 // th, 0), min((y0 + n - 1) // th + 1, down))
    for plane, cy, cx in product(range(planes), near_y, near_x):
        k = (plane * down + cy) * across + cx
        wanted = [i for i, b in enumerate(bands) if planar != 2 or b - 1 == plane]
        a, z = max(cx * tw, x0), min(cx * tw + tw, x0 + w, h.width)
        p, q = max(cy * th, y0), min(cy * th + th, y0 + n, h.height)
        if not wanted or a >= z or p >= q:
            continue
        raw = data[places[k] : places[k] + sizes[k]]
        raw = zlib.decompress(raw) if codec != 1 else raw
        rows = th if tiled else min(th, h.height - cy * th)
        block = np.frombuffer(raw, h.dtype, rows * tw * (h.bands // planes)).reshape(rows, tw, h.bands // planes)
        for i in wanted:
            band = 0 if planar == 2 else bands[i] - 1
            out[i, p - y0 : q - y0, a - x0 : z - x0] = block[p - cy * th : q - cy * th, a - cx * tw : z - cx * tw, band]
    return out


def write_tiff(pixels: np.ndarray, affine: tuple[float, ...], epsg: int | None, deflate: bool = True, strip: int = 128) -> bytes:
    """A little-endian GeoTIFF of (bands, rows, cols), in planes of strips of ``strip`` rows."""
    bands, rows, cols = pixels.shape
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    strip = max(1, min(strip, rows))
    planes = [np.ascontiguousarray(p[y : y + strip], pixels.dtype.newbyteorder("<")).tobytes() for p in pixels for y in range(0, max(rows, 1), strip)]
    planes = [zlib.compress(p, 6) for p in planes] if deflate else planes
    a, b, c, d, e, f = affine
    north_up = not b and not d and e < 0
    tags: list[tuple[int, int, tuple]] = [
        (256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (pixels.dtype.itemsize * 8,) * bands), (259, 3, (8 if deflate else 1,)), (262, 3, (1,)),
        (273, 4, tuple([0] * len(planes))), (277, 3, (bands,)), (278, 4, (strip,)), (279, 4, tuple(map(len, planes))), (284, 3, (2,)), (339, 3, (kind,) * bands),
    ]
    tags += [(33550, 12, (a, -e, 0.0)), (33922, 12, (0.0, 0.0, 0.0, c, f, 0.0))] if north_up else [(34264, 12, (a, b, 0.0, c, d, e, 0.0, f, *[0.0] * 7, 1.0))]
    if epsg is not None:
        geographic = epsg == 4326
        tags.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)))
    tags.sort()
    extra_at = 8 + 2 + 12 * len(tags) + 4
    extra = bytearray()
    sizes = [struct.calcsize(f"<{len(v)}{_CODES[t]}") for _, t, v in tags]
    data_at = extra_at + sum(s + s % 2 for s in sizes if s > 4)
    offsets, at = [], data_at
    for p in planes:
        offsets.append(at)
        at += len(p)
    out = io.BytesIO()
    out.write(struct.pack("<2sHIH", b"II", 42, 8, len(tags)))
    for (tag, t, v), size in zip(tags, sizes):
        body = struct.pack(f"<{len(v)}{_CODES[t]}", *(offsets if tag == 273 else v))
        out.write(struct.pack("<HHI", tag, t, len(v)))
        if size <= 4:
            out.write(body.ljust(4, b"\0"))
        else:
            out.write(struct.pack("<I", extra_at + len(extra)))
            extra += body + b"\0" * (size % 2)
    out.write(struct.pack("<I", 0))
    out.write(bytes(extra))
    out.write(b"".join(planes))
    return out.getvalue()


def window_affine(affine: tuple[float, ...], col: int, row: int) -> tuple[float, ...]:
    a, b, c, d, e, f = affine
    return (a, b, a * col + b * row + c, d, e, d * col + e * row + f)


def npy_bytes(pixels: np.ndarray, channels_last: bool = True, squeeze: bool = False) -> bytes:
    """The .npy file of (bands, rows, cols), as rows, cols, bands if ``channels_last``; one band may be squeezed out."""
    x = pixels.transpose(1, 2, 0) if channels_last else pixels
    x = pixels[0] if squeeze and len(pixels) == 1 else x
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(x))
    return out.getvalue()


_HEADER = "raster_name string, orig_crs_epsg_code int, width long, height long, n_bands int, dtype string, a double, b double, c double, d double, e double, f double, ominx double, ominy double, omaxx double, omaxy double"


def _header_reader(opener: Opener):
    names = [x.split()[0] for x in f"path string, {_HEADER}".split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 10]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name in zip(batch.column("path").to_pylist(), batch.column("raster_name").to_pylist()):
                with opener(path) as file:
                    try:
                        h = read_header(Ranged(file))
                    except (ValueError, KeyError, struct.error):
                        continue
                rows.append((path, name, h.epsg, h.width, h.height, h.bands, h.dtype.newbyteorder("=").name, *h.affine, *h.bounds))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[] for _ in kinds], kinds)], names)

    return run


def list_files(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, raster_name, length) of the files of a directory tree: listed by Spark, contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("raster_name"), "length")


def scan_rasters(spark: SparkSession, path: str, epsg: int, pattern: str = "*.tif", default_epsg: int | None = None, opener: Opener = open_path) -> DataFrame:
    """The rasters table of a directory: name, path, header, and the box of each in the system ``epsg``; broken files are
    left out.

    Spark lists the files; of each only the header is read, in tasks, by ``opener`` (path to an open file). Systems other
    than those of ``functions.crs`` raise when the rows are made.
    """
    rows = durable(list_files(spark, path, pattern).select("path", "raster_name").mapInArrow(_header_reader(opener), f"path string, {_HEADER}"))
    if default_epsg is not None:
        rows = rows.withColumn("orig_crs_epsg_code", F.coalesce("orig_crs_epsg_code", F.lit(default_epsg)))
    return with_boxes(rows, ["ominx", "ominy", "omaxx", "omaxy"], "orig_crs_epsg_code", epsg).drop("ominx", "ominy", "omaxx", "omaxy")


def with_boxes(rows: DataFrame, bounds: list[str], code: str, epsg: int) -> DataFrame:
    """Adds minx, miny, maxx, maxy: ``bounds``, which are in the system of the column ``code``, in the system ``epsg``."""
    codes = [r[0] for r in rows.select(code).distinct().collect() if r[0] is not None]
    names, boxes = ("minx", "miny", "maxx", "maxy"), F.lit(None)
    for c in codes:
        moved = transform_bounds(*[F.col(b) for b in bounds], int(c), epsg)
        boxes = F.when(F.col(code) == c, F.struct(*[m.cast("double").alias(n) for m, n in zip(moved, names)])).otherwise(boxes)
    rows = rows.withColumn("__box", boxes.cast("struct<minx:double,miny:double,maxx:double,maxy:double>"))
    return rows.withColumns({n: F.col(f"__box.{n}") for n in names}).drop("__box")


def choose_bands(bands: Mapping[str, Sequence[int] | None] | None, kind: str) -> list[int] | None:
    """The bands to take of a directory: all where no choice is given at all; a directory that a choice leaves out raises."""
    if bands is None:
        return None
    if kind not in bands:
        raise KeyError(f"no bands are chosen for {kind!r}")
    return None if bands[kind] is None else list(bands[kind])


def cut_files(files: DataFrame, windows: DataFrame, bands: list[int] | None = None, form: str = "tif", opener: Opener = open_path, channels_last: bool = True, squeeze: bool = False) -> DataFrame:
    """(new_name, raster_name, content): the files of the windows (raster_name, new_name, col_off, row_off, w, h).

    ``files``: (raster_name, path). A row is one window, and of its file the strips or tiles that meet it are read, so a
    raster's windows may lie in many tasks and no raster is held whole. Windows of a task are in order of place.
    """
    plan = windows.select("raster_name", "new_name", "col_off", "row_off", "w", "h").join(files.select("raster_name", "path"), "raster_name")
    parts = partitions_for(windows, 8 << 20)
    plan = plan.repartition(parts, "path", F.floor(F.col("row_off") / 4096)).sortWithinPartitions("path", "row_off", "col_off")
    columns = ("raster_name", "new_name", "path", "col_off", "row_off", "w", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        try:
            for batch in batches:
                for name, new, path, *window in zip(*(batch.column(c).to_pylist() for c in columns)):
                    if path != now:
                        if file:
                            file.close()
                        now, file = path, opener(path)
                        data = Ranged(file)
                        h = read_header(data)
                    x = read_window(data, bands, tuple(window), h)
                    made = write_tiff(x, window_affine(h.affine, *window[:2]), h.epsg) if form == "tif" else npy_bytes(x, channels_last, squeeze)
                    new = new if form == "tif" else new.removesuffix(".tif") + ".npy"
                    yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([name]), pa.array([made], pa.binary())], ["new_name", "raster_name", "content"])
        finally:
            if file:
                file.close()

    return plan.mapInArrow(run, "new_name string, raster_name string, content binary")


_SAME = ("orig_crs_epsg_code", "width", "height", "a", "b", "c", "d", "e", "f")


def disagreements(rasters: DataFrame, other: DataFrame) -> DataFrame:
    """Names of rasters whose header in another directory has a different size, place or system."""
    b = other.select("raster_name", F.struct(*_SAME).alias("__other"))
    return rasters.select("raster_name", F.struct(*_SAME).alias("__own")).join(b, "raster_name").where(~F.col("__own").eqNullSafe(F.col("__other"))).select("raster_name")


def cut_directories(
    spark: SparkSession, folders: Mapping[str, str], windows: DataFrame, out: Mapping[str, str], optional: Sequence[str] = ("labels",),
    bands: Mapping[str, Sequence[int] | None] | None = None, opener: Opener = open_path,
) -> DataFrame:
    """(kind, name, path, n_bytes): the same windows cut out of every directory (``folders``: kind to path; the first is the
    rasters' own) and written to ``out``.

    Files must agree in size, place and system with those of the first directory, else it raises; so does a raster of the
    windows that a directory lacks, unless its kind is ``optional``: then the windows are left out there.
    """
    chosen = {k: choose_bands(bands, k) for k in folders}
    wanted = windows.select("raster_name").distinct()
    tables = {k: durable(list_files(spark, f).select("path", "raster_name").mapInArrow(_header_reader(opener), f"path string, {_HEADER}")) for k, f in folders.items()}
    first, done = next(iter(folders)), []
    for kind, table in tables.items():
        lost = [r[0] for r in wanted.join(table.select("raster_name"), "raster_name", "left_anti").limit(5).collect()] if kind not in optional else []
        bad = [r[0] for r in disagreements(tables[first], table).join(wanted, "raster_name", "left_semi").limit(5).collect()]
        if lost or bad:
            raise ValueError(f"{kind}: files are missing: {lost}" if lost else f"{kind}: size, place or system differ from {first}: {bad}")
        made = write_files(cut_files(table, windows, chosen[kind], opener=opener), out[kind])
        done.append(durable(made.select(F.lit(kind).alias("kind"), "*")))
    return reduce(DataFrame.unionByName, done)


def convert_to_npy(
    spark: SparkSession, folders: Mapping[str, str], out: Mapping[str, str], bands: Mapping[str, Sequence[int] | None] | None = None, channels_last: bool = True,
    squeeze: bool = True, opener: Opener = open_path,
) -> DataFrame:
    """(kind, name, path, n_bytes): every raster of every directory as a ``.npy`` file of the bands chosen for it."""
    done = []
    for kind, folder in folders.items():
        chosen = choose_bands(bands, kind)
        table = durable(list_files(spark, folder).select("path", "raster_name").mapInArrow(_header_reader(opener), f"path string, {_HEADER}"))
        zero = F.lit(0).cast("long")
        whole = table.select("raster_name", F.col("raster_name").alias("new_name"), zero.alias("col_off"), zero.alias("row_off"), F.col("width").alias("w"), F.col("height").alias("h"))
        made = write_files(cut_files(table, whole, chosen, "npy", opener, channels_last, squeeze), out[kind])
        done.append(durable(made.select(F.lit(kind).alias("kind"), "*")))
    return reduce(DataFrame.unionByName, done)


def npy_table(rasters: DataFrame) -> DataFrame:
    """The rasters of a dataset under the names of their ``.npy`` files."""
    return rasters.withColumn("raster_name", F.regexp_replace("raster_name", r"\.tif$", ".npy"))


def label_files(pixels: DataFrame, rasters: DataFrame, bands: Sequence[str] = ("label",), dtype: str = "uint8", fill: Sequence[float] | None = None) -> DataFrame:
    """(new_name, raster_name, content): a GeoTIFF of each raster's label pixels, one band per column of ``bands``.

    ``pixels``: (raster_name, row, col, *bands), sparse; others are ``fill`` (0). ``rasters`` has width, height and the
    affine, and may have orig_crs_epsg_code. Categorical labels are one uint8 band; soft ones float32 bands, background
    first, if ``bands`` begins with it and its fill is 1. A raster is one group: what a task holds is its bands.
    """
    code = F.col("orig_crs_epsg_code") if "orig_crs_epsg_code" in rasters.columns else F.lit(None).cast("int")
    sheet = rasters.select("raster_name", "width", "height", *[F.col(c) if c in rasters.columns else F.lit(0.0).alias(c) for c in "abcdef"], code.alias("epsg"))
    cells = pixels.select("raster_name", F.col("row").cast("long"), F.col("col").cast("long"), *[F.col(f"`{b}`").cast("double").alias(f"b{k}") for k, b in enumerate(bands)])
    empty = list(fill) if fill is not None else [0.0] * len(bands)

    def run(sheet: pa.Table, cells: pa.Table) -> pa.Table:
        rows = []
        for r in sheet.to_pylist():
            x = np.empty((len(empty), r["height"], r["width"]), dtype)
            for k, value in enumerate(empty):
                x[k] = value
                x[k, cells.column("row").to_numpy(), cells.column("col").to_numpy()] = cells.column(f"b{k}").to_numpy()
            rows.append((r["raster_name"], r["raster_name"], write_tiff(x, tuple(r[c] for c in "abcdef"), r["epsg"])))
        cols = zip(*rows) if rows else [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("new_name", "raster_name", "content"), cols, (pa.string(), pa.string(), pa.binary()))})

    return sheet.groupBy("raster_name").cogroup(cells.groupBy("raster_name")).applyInArrow(run, "new_name string, raster_name string, content binary")


def label_mismatches(rasters: DataFrame, labels: DataFrame) -> DataFrame:
    """(raster_name, problem): rasters without a label file and label files without a raster."""
    both = rasters.select("raster_name", F.lit(1).alias("a")).join(labels.select("raster_name", F.lit(1).alias("b")), "raster_name", "full")
    return both.where("a is null or b is null").select("raster_name", F.when(F.col("a").isNull(), "label without raster").otherwise("raster without label").alias("problem"))
