"""Pixel windows (cutouts): grids, windows around vectors, windows from boxes. North-up pixels of ``size`` units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.functions.geometry import BOX, areal, box_shape, clip_to_box, intersects, once, points
from swathe.plans.skew import shuffled


def seeded(seed: int, *parts: Column) -> Column:
    """A number in [0, 2^32) from the digest of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.tif$", "")


def with_pixels(rasters: DataFrame, size: float = 1.0) -> DataFrame:
    """Adds width, height and affine a, c, e, f (x = c + col * a, y = f + row * e) of a north-up raster over its box."""
    return rasters.withColumns(
        {
            "width": F.floor((F.col("maxx") - F.col("minx")) / size).cast("long"),
            "height": F.floor((F.col("maxy") - F.col("miny")) / size).cast("long"),
            "a": F.lit(float(size)), "c": F.col("minx").cast("double"), "e": F.lit(-float(size)), "f": F.col("maxy").cast("double"),
        }
    )


def footprint(df: DataFrame) -> DataFrame:
    """Adds the box of a window (col_off, row_off, width, height) of a north-up raster with affine a, c, e, f."""
    x0, y1 = F.col("c") + F.col("col_off") * F.col("a"), F.col("f") + F.col("row_off") * F.col("e")
    return df.withColumns({"minx": x0, "maxy": y1, "maxx": x0 + F.col("w") * F.col("a"), "miny": y1 + F.col("h") * F.col("e")})


def grid_windows(rasters: DataFrame, rows: int, cols: int) -> DataFrame:
    """Whole windows of rows x cols pixels; partial ones at the far edges are left out. Names: stem_row_col.tif."""
    df = rasters.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("width") / cols).cast("long"))).alias("i"))
    df = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("height") / rows).cast("long"))).alias("j"))
    df = df.where(((F.col("i") + 1) * cols <= F.col("width")) & ((F.col("j") + 1) * rows <= F.col("height")))
    name = F.format_string("%s_%d_%d.tif", stem(F.col("raster_name")), F.col("j"), F.col("i"))
    return df.withColumns({"new_name": name, "col_off": F.col("i") * cols, "row_off": F.col("j") * rows, "w": F.lit(cols).cast("long"), "h": F.lit(rows).cast("long")}).drop("i", "j")


def bbox_windows(rasters: DataFrame, boxes: DataFrame, inside: DataFrame, rows: int, cols: int) -> DataFrame:
    """For boxes within a raster (``inside``: vector_name, raster_name) a window of fixed size centred on the box.

    Names number a raster's boxes in order of vector_name; offsets are cut towards zero.
    """
    boxes = boxes.select("vector_name", *[F.col(c).alias(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    df = inside.join(shuffled(rasters), "raster_name").join(shuffled(boxes), "vector_name")
    i = F.row_number().over(Window.partitionBy("raster_name").orderBy("vector_name")) - 1

    def place(lo: Column, hi: Column, new: int) -> Column:
        return (lo + (hi - lo) / 2 - F.lit(new) / 2).cast("long")

    col_lo, col_hi = (F.col("b_minx") - F.col("c")) / F.col("a"), (F.col("b_maxx") - F.col("c")) / F.col("a")
    row_lo, row_hi = (F.col("b_maxy") - F.col("f")) / F.col("e"), (F.col("b_miny") - F.col("f")) / F.col("e")
    out = df.withColumns({"i": i, "col_off": place(col_lo, col_hi, cols), "row_off": place(row_lo, row_hi, rows), "w": F.lit(cols).cast("long"), "h": F.lit(rows).cast("long")})
    return out.withColumn("new_name", F.format_string("%s_%d.tif", stem(F.col("raster_name")), F.col("i"))).drop("i")


def around_vectors(
    pairs: DataFrame, rasters: DataFrame, vectors: DataFrame, mode: str = "centered", rows: int = 8, cols: int = 8, scaling: float = 1.2, seed: int = 10, strict: bool = False
) -> DataFrame:
    """Windows that cover each vector of ``pairs`` (vector_name, raster_name) in its raster.

    The vector's box, clipped to the raster, gives a range of pixels; the smallest grid of windows that covers it is placed
    ``centered`` on the box's middle, at a seeded ``random`` place that covers it, or with ``variable`` windows of
    max(scaling * extent, size) rounded up. Windows that miss the vector are left out. Shapes that are no boxes are clipped and
    tested exactly. A box inside one pixel row or
    column gives no window. ``random`` clamps an empty range of places, or leaves the pair out if ``strict``.
    """
    if mode not in ("centered", "random", "variable"):
        raise ValueError(mode)
    shaped = {"geom", "is_box"} <= set(vectors.columns)
    v = vectors.select("vector_name", *[F.col(c).cast("double").alias(f"v_{c}") for c in BOX], *([F.col("geom").alias("v_geom"), F.col("is_box").alias("v_is_box")] if shaped else []))
    df = pairs.select("vector_name", "raster_name").join(shuffled(rasters), "raster_name").join(shuffled(v), "vector_name")
    lo_x, hi_x = F.greatest("v_minx", F.col("minx").cast("double")), F.least("v_maxx", F.col("maxx").cast("double"))
    lo_y, hi_y = F.greatest("v_miny", F.col("miny").cast("double")), F.least("v_maxy", F.col("maxy").cast("double"))
    df = df.withColumns({"bx0": lo_x, "bx1": hi_x, "by0": lo_y, "by1": hi_y})
    if shaped:  # the bounds of what the shape shares with the raster's box
        part = clip_to_box(F.col("v_geom"), F.col("minx").cast("double"), F.col("miny").cast("double"), F.col("maxx").cast("double"), F.col("maxy").cast("double"))
        areal_ = areal(F.col("v_geom")) & ~F.coalesce("v_is_box", F.lit(False))
        df = df.withColumn("v_part", F.when(areal_, part)).withColumn("v_points", points(F.col("v_part")))
        for c, f, axis in (("bx0", F.array_min, "x"), ("bx1", F.array_max, "x"), ("by0", F.array_min, "y"), ("by1", F.array_max, "y")):
            df = df.withColumn(c, F.when(F.col("v_part").isNotNull(), f(F.transform("v_points", lambda p: p[axis]))).otherwise(F.col(c)))

    def col_at(x: Column) -> Column:
        return F.floor((x - F.col("c")) / F.col("a")).cast("long")

    def row_at(y: Column) -> Column:
        return F.floor((y - F.col("f")) / F.col("e")).cast("long")

    df = df.withColumns({
        "min_col": col_at(F.col("bx0")), "max_col": col_at(F.col("bx1")), "min_row": row_at(F.col("by1")), "max_row": row_at(F.col("by0")),
        "mid_col": col_at((F.col("bx0") + F.col("bx1")) / 2), "mid_row": row_at((F.col("by0") + F.col("by1")) / 2),
    })
    span_c, span_r = F.col("max_col") - F.col("min_col"), F.col("max_row") - F.col("min_row")
    if mode == "variable":
        size_c = F.ceil(F.greatest(span_c * F.lit(float(scaling)), F.lit(float(cols)))).cast("long")
        size_r = F.ceil(F.greatest(span_r * F.lit(float(scaling)), F.lit(float(rows)))).cast("long")
    else:
        size_c, size_r = F.lit(cols).cast("long"), F.lit(rows).cast("long")
    df = df.withColumns({"w": size_c, "h": size_r})
    df = df.withColumns({"n_cols": F.ceil(span_c / F.col("w")).cast("long"), "n_rows": F.ceil(span_r / F.col("h")).cast("long")}).where("n_cols > 0 and n_rows > 0")
    if mode == "random":
        for axis, size, extent in (("col", "w", "width"), ("row", "h", "height")):
            cover = F.col(size) * F.col(f"n_{axis}s")
            df = df.withColumn(f"{axis}_lo", F.greatest(F.lit(0), F.col(f"max_{axis}") - cover)).withColumn(f"{axis}_hi", F.least(F.col(f"min_{axis}"), F.col(extent) - cover))
            h = seeded(seed, F.lit(axis), F.col("vector_name"), F.col("raster_name"))
            df = df.withColumn(f"{axis}0", F.col(f"{axis}_lo") + h % F.greatest(F.col(f"{axis}_hi") - F.col(f"{axis}_lo") + 1, F.lit(1)))
        df = df.where("col_lo <= col_hi and row_lo <= row_hi") if strict else df
        df = df.drop("col_lo", "col_hi", "row_lo", "row_hi")
    else:
        df = df.withColumns({f"{a}0": F.col(f"mid_{a}") - F.floor(F.col(s) * F.col(f"n_{a}s") / 2).cast("long") for a, s in (("col", "w"), ("row", "h"))})
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1)))
    df = df.withColumns({"col_off": F.col("col0") + F.col("j") * F.col("w"), "row_off": F.col("row0") + F.col("i") * F.col("h")})
    one = F.format_string("%s_%s.tif", stem(F.col("raster_name")), F.col("vector_name"))
    many = F.format_string("%s_%s_%d_%d.tif", stem(F.col("raster_name")), F.col("vector_name"), F.col("i"), F.col("j"))
    df = footprint(df.withColumn("new_name", F.when(F.col("n_rows") * F.col("n_cols") == 1, one).otherwise(many)))
    meets = (F.col("minx") <= F.col("bx1")) & (F.col("maxx") >= F.col("bx0")) & (F.col("miny") <= F.col("by1")) & (F.col("maxy") >= F.col("by0"))
    if shaped:
        touches = once(box_shape(*[F.col(c) for c in BOX]), lambda cell: once(F.col("v_geom"), lambda g: intersects(cell, g)))
        meets = meets & F.when(F.col("v_part").isNotNull(), touches).otherwise(F.lit(True))
    return df.where(meets).select("vector_name", "raster_name", "new_name", "col_off", "row_off", "w", "h", "minx", "miny", "maxx", "maxy")


def not_cut(rasters: DataFrame, cut_log: DataFrame) -> DataFrame:
    return rasters.join(shuffled(cut_log.select("raster_name").distinct()), "raster_name", "left_anti")


def candidates(source_edges: DataFrame, cut_log: DataFrame) -> DataFrame:
    """(vector_name, raster_name): containing source rasters that weren't yet cut for the vector."""
    keys = ["vector_name", "raster_name"]
    return source_edges.where("relation = 'contains'").select(*keys).join(shuffled(cut_log.select(*keys).distinct()), keys, "left_anti")


def select_rasters(found: DataFrame, deficits: DataFrame, seed: int = 10) -> DataFrame:
    """Of each vector's candidates as many as it lacks (``deficits``: vector_name, deficit), in a seeded order."""
    order = Window.partitionBy("vector_name").orderBy(seeded(seed, F.col("vector_name"), F.col("raster_name")), "raster_name")
    ranked = found.join(shuffled(deficits), "vector_name").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("deficit")).select("vector_name", "raster_name")
