"""Acquisition planning: which vectors still need rasters, and which product of a catalogue to take next."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.functions.geometry import BOX
from swathe.operators import windows
from swathe.operators.windows import seeded, stem
from swathe.plans.components import components
from swathe.plans.durable import durable
from swathe.plans.skew import shuffled


def vectors_to_download(vectors: DataFrame, target: int, names: DataFrame | None = None) -> DataFrame:
    """Vectors with a box whose raster_count is below ``target``; or the named ones, unknown names raise."""
    if names is not None:
        unknown = [r[0] for r in names.join(shuffled(vectors.select("vector_name")), "vector_name", "left_anti").limit(5).collect()]
        if unknown:
            raise ValueError(f"unknown vectors: {unknown}")
        return vectors.join(shuffled(names.select("vector_name")), "vector_name", "left_semi").where("minx is not null")
    return vectors.where(F.col("minx").isNotNull() & (F.col("raster_count") < target))


def not_covered_by_union(vectors: DataFrame, rasters: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of vectors that the union of their intersecting rasters does not contain. Where a vector or one of its rasters
    is no box (``geom``, ``is_box``) see ``_rest_is_empty``; boxes alone stay in the JVM:

    Coordinate compression: the raster edges inside the vector's box cut it into cells, and each must lie in a raster. Only
    vectors that no single raster contains are looked at. Arrays of a vector's rasters stay inside the JVM.
    """
    easy = edges.where("relation = 'contains'").select("vector_name").distinct()
    shaped = None
    if "geom" in vectors.columns and "geom" in rasters.columns:
        no_box = lambda df: df.where(~F.coalesce("is_box", F.lit(False)))
        odd = no_box(vectors).select("vector_name").unionByName(edges.join(shuffled(no_box(rasters).select("raster_name")), "raster_name").select("vector_name")).distinct()
        odd = durable(odd.join(shuffled(easy), "vector_name", "left_anti"))
        near = edges.join(shuffled(odd), "vector_name", "left_semi").join(shuffled(rasters.select("raster_name", F.col("geom").alias("r_geom"))), "raster_name")
        near = near.groupBy("vector_name").agg(F.collect_list("r_geom").alias("r_geoms"))
        shapes = vectors.join(shuffled(odd), "vector_name", "left_semi").select("vector_name", "geom").join(shuffled(near), "vector_name", "left")
        shaped = shapes.mapInArrow(_uncovered, "vector_name string")
        vectors = vectors.join(shuffled(odd), "vector_name", "left_anti")
    hard = vectors.select("vector_name", *[F.col(c).cast("double").alias(f"v_{c}") for c in BOX]).join(shuffled(easy), "vector_name", "left_anti")
    r = rasters.select("raster_name", *[F.col(c).cast("double").alias(c) for c in BOX])
    near = edges.join(shuffled(hard.select("vector_name")), "vector_name", "left_semi").join(shuffled(r), "raster_name").groupBy("vector_name").agg(F.collect_set(F.struct(*BOX)).alias("boxes"))
    df = hard.join(shuffled(near), "vector_name", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<minx:double,miny:double,maxx:double,maxy:double>>")))

    def cuts(axis: str) -> Column:
        lo, hi = F.col(f"v_min{axis}"), F.col(f"v_max{axis}")
        every = F.flatten(F.transform("boxes", lambda b: F.array(b[f"min{axis}"], b[f"max{axis}"])))
        return F.array_sort(F.array_distinct(F.concat(F.array(lo, hi), F.filter(every, lambda x: (x > lo) & (x < hi)))))

    df = df.withColumns({"xs": cuts("x"), "ys": cuts("y")})

    def middles(column: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(column) - 1, F.lit(1))), lambda i: (F.get(F.col(column), i - 1) + F.coalesce(F.get(F.col(column), i), F.get(F.col(column), i - 1))) / 2)

    df = df.withColumns({"mx": middles("xs"), "my": middles("ys")})
    hit = lambda x, y: F.exists("boxes", lambda b: (b["minx"] <= x) & (x <= b["maxx"]) & (b["miny"] <= y) & (y <= b["maxy"]))
    left = df.where(~F.forall("mx", lambda x: F.forall("my", lambda y: hit(x, y)))).select("vector_name")
    return left if shaped is None else left.unionByName(shaped)


def _cut(ring: list[tuple[float, float]], p: tuple[float, float], q: tuple[float, float], keep_left: bool) -> list[tuple[float, float]]:
    """The part of a ring left (or right) of the line from p to q."""
    side = [((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])) * (1 if keep_left else -1) for x, y in ring]
    out = []
    for k, (a, s) in enumerate(zip(ring, side)):
        b, t = ring[(k + 1) % len(ring)], side[(k + 1) % len(ring)]
        if s >= 0:
            out.append(a)
        if (s > 0 and t < 0) or (s < 0 and t > 0):
            w = s / (s - t)
            out.append((a[0] + w * (b[0] - a[0]), a[1] + w * (b[1] - a[1])))
    return out


def _size(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]])) / 2


def _triangles(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """A simple ring as triangles that turn left, by cutting off ears."""
    ring = ring if _size(ring) >= 0 else ring[::-1]
    out = []
    while len(ring) > 3:
        for k in range(len(ring)):
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            turn = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            others = [p for p in ring if p not in (a, b, c)]
            holds = any(all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for p, q in ((a, b), (b, c), (c, a))) for x, y in others)
            if turn <= 0 and not holds and turn == 0 or turn > 0 and not holds:
                if turn > 0:
                    out.append([a, b, c])
                ring = ring[:k] + ring[k + 1 :]
                break
        else:
            break
    return [*out, ring] if len(ring) == 3 and _size(ring) > 0 else out


def _rest_is_empty(vector: dict, rasters: list[dict]) -> bool:
    """Whether nothing with an area is left of a vector without the rasters: its shells in triangles, of each of which every
    raster's triangles are cut away in turn. Holes of a vector count as filled; a raster with holes covers nothing, and only
    areal shapes are covered. Slivers under 1e-12 of the vector's area are rounding."""
    if vector is None or vector["kind"] not in ("Polygon", "MultiPolygon"):
        return False

    def rings(shape: dict, whole: bool) -> list:
        return [[(p["x"], p["y"]) for p in part[0][:-1]] for part in shape["parts"] if whole or len(part) == 1]

    pieces = [t for r in rings(vector, True) for t in _triangles(r)]
    least = 1e-12 * sum(map(_size, pieces))
    for raster in rasters or ():
        for tri in (t for r in rings(raster, False) for t in _triangles(r)) if raster["kind"] in ("Polygon", "MultiPolygon") else ():
            kept = []
            for piece in pieces:
                for p, q in zip(tri, [*tri[1:], tri[0]]):
                    outer = _cut(piece, p, q, False)
                    if len(outer) > 2 and _size(outer) > least:
                        kept.append(outer)
                    piece = _cut(piece, p, q, True)
                    if len(piece) < 3 or _size(piece) <= least:
                        break
            pieces = kept
            if not pieces:
                return True
    return not pieces


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("vector_name", "geom", "r_geoms")))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, v, r in rows if not _rest_is_empty(v, r)], pa.string())], ["vector_name"])


def best_product(edges: DataFrame, catalog: DataFrame, order: str, descending: bool = True, where: Column | None = None, taken: DataFrame | None = None) -> DataFrame:
    """(vector_name, raster_name): of the products that contain a vector, pass the filter and aren't there yet, the first
    by one property, then by name."""
    products = catalog if where is None else catalog.where(where)
    products = products if taken is None else products.join(shuffled(taken.select("raster_name")), "raster_name", "left_anti")
    rows = edges.where("relation = 'contains'").join(shuffled(products.select("raster_name", order)), "raster_name")
    key = F.struct(-F.col(order) if descending else F.col(order), "raster_name")
    return rows.groupBy("vector_name").agg(F.min_by("raster_name", key).alias("raster_name"))


def product_file(title: Column, suffix: str = "") -> Column:
    """The file name of a product: its title without the suffix and with unsafe characters replaced."""
    plain = F.regexp_replace(title, f"{suffix}$", "") if suffix else title
    return F.concat(F.regexp_replace(plain, r"[^A-Za-z0-9_.-]", "_"), F.lit(".tif"))


def dem_name(x: Column, y: Column) -> Column:
    """Name of the one-degree tile with the lower left corner below a point, such as N052E013."""
    lat, lon = F.floor(y), F.floor(x)
    return F.concat(
        F.when(lat >= 0, "N").otherwise("S"), F.lpad(F.abs(lat).cast("string"), 3, "0"), F.when(lon >= 0, "E").otherwise("W"), F.lpad(F.abs(lon).cast("string"), 3, "0")
    )


def dem_folder(x: Column, y: Column) -> Column:
    """The five-degree cell that a tile is filed under."""
    return dem_name(F.floor(x / 5) * 5, F.floor(y / 5) * 5)


def dem_tiles(vectors: DataFrame, mode: str = "grid", taken: DataFrame | None = None) -> DataFrame:
    """(vector_name, folder, tile): tiles at the ``vertices`` of each box, or on a one-degree ``grid`` over it.

    The grid steps from the lower left corner by whole degrees, ceil(extent) steps further, both ends in.
    """
    v = vectors.select("vector_name", *[F.col(c).cast("double").alias(c) for c in BOX])
    if mode == "vertices":
        corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("minx", "maxx") for y in ("miny", "maxy")])
        rows = v.select("vector_name", F.explode(corners).alias("p")).select("vector_name", "p.x", "p.y")
    elif mode == "grid":
        steps = {a: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"max{a}") - F.col(f"min{a}")).cast("long")) for a in "xy"}
        rows = v.withColumn("i", F.explode(steps["x"])).withColumn("j", F.explode(steps["y"]))
        rows = rows.select("vector_name", (F.col("minx") + F.col("i")).alias("x"), (F.col("miny") + F.col("j")).alias("y"))
    else:
        raise ValueError(mode)
    tiles = rows.select("vector_name", dem_folder(F.col("x"), F.col("y")).alias("folder"), dem_name(F.col("x"), F.col("y")).alias("tile")).distinct()
    return tiles if taken is None else tiles.join(shuffled(taken.select("tile")), "tile", "left_anti").select("vector_name", "folder", "tile")


#: Open choices that one task goes through in a plain loop; above it, choices that don't hang on each other are made by
#: rounds of joins. Share of the waiting vectors under which a round is too slow and connected parts are looped over.
FEW_CHOICES, SLOW = 200_000, 0.02


def _ready(choices: DataFrame, every: DataFrame) -> tuple[DataFrame, int, int]:
    """(vectors that no waiting vector of a lesser name shares a raster with, how many, how many wait).

    ``choices``: (vector_name, raster_name) that are open; ``every``: rows that tell with which rasters a waiting vector may
    interact. One aggregation by raster and one by vector; at most one of the vectors at a raster is ready.
    """
    waiting = every.join(shuffled(choices.select("vector_name").distinct()), "vector_name", "left_semi").select("vector_name", "raster_name")
    least = waiting.groupBy("raster_name").agg(F.min("vector_name").alias("first"))
    free = durable(waiting.join(shuffled(least), "raster_name").groupBy("vector_name").agg(F.bool_and(F.col("first") == F.col("vector_name")).alias("free")))
    ready = free.where("free").select("vector_name")
    return ready, ready.count(), free.count()


def _by_component(edges: DataFrame, keep: list[str]) -> DataFrame:
    """Edges with the component of the vector-raster graph they belong to: greedy choices interact inside one alone."""
    ends = edges.select(F.concat(F.lit("v:"), "vector_name").alias("a"), F.concat(F.lit("r:"), "raster_name").alias("b"))
    found = components(ends, "a", "b")
    return edges.select("vector_name", "raster_name", *keep).join(shuffled(found), F.concat(F.lit("v:"), "vector_name") == F.col("node")).drop("node")


def plan_downloads(
    vectors: DataFrame, edges: DataFrame, catalog: DataFrame, target: int, order: str, unavailable: DataFrame | None = None, few: int = FEW_CHOICES
) -> DataFrame:
    """(raster_name, for_vector): the products that a greedy round downloads, and the vector each was taken for.

    ``edges``: vectors x catalogue. In order of vector_name each vector that still lacks rasters takes containing products,
    largest ``order`` first, until it has ``target``; a product counts for every vector it contains. ``unavailable``
    (raster_name) can't be had and is left out. Products and vectors that are null or repeated raise.

    Vectors that no earlier one shares an open product with choose at once, round by round, as one loop over all would;
    when few choices are open one task loops over them. Rounds that decide little give way to a loop per connected part.
    """
    check_products(catalog)
    catalog = catalog if unavailable is None else catalog.join(shuffled(unavailable.select("raster_name").distinct()), "raster_name", "left_anti")
    inside = edges.where("relation = 'contains'").select("vector_name", "raster_name")
    rows = inside.join(shuffled(catalog.select("raster_name", F.col(order).cast("double").alias("rank"))), "raster_name")
    rows = durable(rows.join(shuffled(vectors.select("vector_name", F.col("raster_count").alias("have"))), "vector_name").select("vector_name", "raster_name", "rank", "have"))
    schema, done = "raster_name string, for_vector string", []

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(pdf.vector_name, pdf.have))
        pdf = pdf.sort_values(["vector_name", "rank", "raster_name"], ascending=[True, False, True], kind="stable")
        members: dict[str, list[str]] = {}
        for v, r in zip(pdf.vector_name, pdf.raster_name):
            members.setdefault(r, []).append(v)
        taken: dict[str, str] = {}
        for v, r in zip(pdf.vector_name, pdf.raster_name):
            if have[v] < target and r not in taken:
                taken[r] = v
                for m in members[r]:
                    have[m] += 1
        return pd.DataFrame({"raster_name": list(taken), "for_vector": list(taken.values())}, dtype="object")

    while True:
        open_ = rows.where(F.col("have") < target)
        if open_.count() <= few:
            done.append(open_.groupBy().applyInPandas(greedy, schema))  # vectors that have enough don't choose
            break
        ready, n, waiting = _ready(open_, open_)
        if n < SLOW * waiting:
            done.append(_by_component(rows, ["rank", "have"]).groupBy("component").applyInPandas(greedy, schema))
            break
        place = Window.partitionBy("vector_name").orderBy(F.col("rank").desc(), "raster_name")
        taken = open_.join(shuffled(ready), "vector_name", "left_semi").withColumn("place", F.row_number().over(place)).where(F.col("place") <= target - F.col("have"))
        taken = durable(taken.select("raster_name", F.col("vector_name").alias("for_vector")))
        done.append(taken)
        gained = rows.join(shuffled(taken), "raster_name", "left_semi").groupBy("vector_name").agg(F.count("*").alias("more"))
        rest = rows.join(shuffled(taken), "raster_name", "left_anti").join(shuffled(gained), "vector_name", "left")
        rows = durable(rest.select("vector_name", "raster_name", "rank", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have")))
    return reduce(DataFrame.unionByName, done)


def check_products(catalog: DataFrame) -> None:
    """Raises for products without a name or listed twice."""
    bad = [r[0] for r in catalog.groupBy("raster_name").count().where("raster_name is null or count > 1").limit(5).collect()]
    if bad:
        raise ValueError(f"products without a name or listed twice: {bad}")


def record_downloads(vectors: DataFrame, plan: DataFrame, failed: DataFrame) -> DataFrame:
    """``vectors`` with download_exception: the first message, by product, of ``failed`` (raster_name, message) among the
    products planned for the vector; what was recorded before stays where there is none."""
    why = plan.join(shuffled(failed), "raster_name").groupBy(F.col("for_vector").alias("vector_name")).agg(F.min_by("message", "raster_name").alias("__why"))
    old = F.col("download_exception") if "download_exception" in vectors.columns else F.lit(None).cast("string")
    return vectors.join(shuffled(why), "vector_name", "left").withColumn("download_exception", F.coalesce("__why", old)).drop("__why")


def downloaded_twice(plan: DataFrame, rasters: DataFrame) -> DataFrame:
    """Planned products that the dataset has already, or that are planned more than once."""
    again = plan.groupBy("raster_name").count().where("count > 1").select("raster_name")
    return again.unionByName(plan.select("raster_name").join(shuffled(rasters.select("raster_name")), "raster_name", "left_semi")).distinct()


def cut_around_vectors(
    vectors: DataFrame, rasters: DataFrame, edges: DataFrame, target: int = 1, rows: int = 8, cols: int = 8, seed: int = 10, have: DataFrame | None = None,
    mode: str = "centered", scaling: float = 1.2, few: int = FEW_CHOICES, rank: Column | None = None,
) -> DataFrame:
    """(new_name, vector_name, raster_name, col_off, row_off, w, h, minx, miny, maxx, maxy): greedy cutting.

    In order of vector_name, each vector that fewer than ``target`` cutouts contain takes containing rasters, in a seeded
    order or by ``rank`` (of vector_name, raster_name and raster columns; least first), that weren't cut for it. A new cutout
    counts for every vector it contains, and its source counts as cut for those. Windows are those of
    ``windows.around_vectors`` in the ``mode``, by the rasters' own pixels (width, height, a, c, e, f), or pixels of one unit
    where these columns lack. ``have`` (vector_name, raster_count): what vectors have to begin with, none otherwise.
    Rounds, loops and connected parts as in ``plan_downloads``; rasters of intersecting vectors count as shared.
    """
    rasters = rasters if {"width", "height", "a", "c", "e", "f"} <= set(rasters.columns) else windows.with_pixels(rasters)
    start = vectors.select("vector_name", F.lit(0).alias("have")) if have is None else have.select("vector_name", F.col("raster_count").alias("have"))
    draw = seeded(seed, F.col("vector_name"), F.col("raster_name")) if rank is None else rank
    near = durable(edges.select("vector_name", "raster_name", "relation").join(shuffled(start.select("vector_name")), "vector_name", "left_semi"))
    inside = near.where("relation = 'contains'").join(shuffled(start), "vector_name").join(shuffled(rasters), "raster_name")
    choices = durable(inside.select("vector_name", "raster_name", draw.alias("draw"), "have"))
    box = vectors.select("vector_name", *[F.col(c).cast("double").alias(f"m_{c}") for c in BOX])
    schema, done = "new_name string, vector_name string, raster_name string, col_off long, row_off long, w long, h long, minx double, miny double, maxx double, maxy double", []
    names = [f.split()[0] for f in schema.split(", ")]

    def cuts(pairs: DataFrame) -> DataFrame:
        return windows.around_vectors(pairs, rasters, vectors, mode, rows, cols, scaling, seed).select(*names)

    def served(cut: DataFrame, others: DataFrame) -> DataFrame:
        """(vector_name, raster_name, by, gain): in how many of a cut's windows other vectors at the raster lie."""
        members = others.select(F.col("vector_name").alias("m"), "raster_name").join(shuffled(box.withColumnRenamed("vector_name", "m")), "m")
        lie = (F.col("minx") <= F.col("m_minx")) & (F.col("m_maxx") <= F.col("maxx")) & (F.col("miny") <= F.col("m_miny")) & (F.col("m_maxy") <= F.col("maxy"))
        hit = cut.join(shuffled(members), "raster_name").where(lie)
        return hit.groupBy(F.col("m").alias("vector_name"), "raster_name", F.col("vector_name").alias("by")).agg(F.count("*").alias("gain"))

    def loop(open_: DataFrame, parts: DataFrame | None) -> DataFrame:
        """The plain loop over choices, whose windows and what these serve are worked out before."""
        made = durable(cuts(open_))
        gains = served(made, near.join(shuffled(open_.select("vector_name").distinct()), "vector_name", "left_semi"))
        serves = gains.groupBy(F.col("by").alias("vector_name"), "raster_name").agg(F.collect_list(F.struct("vector_name", "gain")).alias("serves"))
        table = open_.join(shuffled(serves), ["vector_name", "raster_name"], "left")
        table = table.withColumn("part", F.lit("")) if parts is None else table.join(shuffled(parts), "vector_name")

        def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
            have, cut, taken = dict(zip(pdf.vector_name, pdf.have)), set(), []
            pdf = pdf.sort_values(["vector_name", "draw", "raster_name"], kind="stable")
            for v, r, serves in zip(pdf.vector_name, pdf.raster_name, pdf.serves):
                if have[v] >= target or (v, r) in cut:
                    continue
                cut.add((v, r))
                taken.append((v, r))
                for m in serves if serves is not None else ():
                    if m["vector_name"] in have:
                        have[m["vector_name"]] += m["gain"]
                        cut.add((m["vector_name"], r))
            return pd.DataFrame(taken, columns=["vector_name", "raster_name"], dtype="object")

        chosen = durable(table.groupBy("part").applyInPandas(greedy, "vector_name string, raster_name string"))
        return made.join(shuffled(chosen), ["vector_name", "raster_name"], "left_semi").select(*names)

    while True:
        open_ = choices.where(F.col("have") < target)
        if open_.count() <= few:
            done.append(loop(open_, None))
            break
        ready, n, waiting = _ready(open_, near)
        if n < SLOW * waiting:
            shared = near.join(shuffled(open_.select("vector_name").distinct()), "vector_name", "left_semi")
            done.append(loop(open_, _by_component(shared, []).select("vector_name", F.col("component").alias("part")).distinct()))
            break
        mine = open_.join(shuffled(ready), "vector_name", "left_semi")
        made = durable(cuts(mine))
        own = served(made, mine).where("vector_name = by").select("vector_name", "raster_name", "gain")
        before = Window.partitionBy("vector_name").orderBy("draw", "raster_name").rowsBetween(Window.unboundedPreceding, -1)
        turn = mine.join(shuffled(own), ["vector_name", "raster_name"], "left").withColumn("so_far", F.coalesce(F.sum(F.coalesce("gain", F.lit(0))).over(before), F.lit(0)))
        taken = durable(turn.where(F.col("have") + F.col("so_far") < target).select("vector_name", "raster_name"))
        made = made.join(shuffled(taken), ["vector_name", "raster_name"], "left_semi").select(*names)
        done.append(made)
        gains = durable(served(made, near).select("vector_name", "raster_name", "gain"))
        gone = gains.select("vector_name", "raster_name").unionByName(taken).distinct()
        more = gains.groupBy("vector_name").agg(F.sum("gain").alias("more"))
        rest = choices.join(shuffled(gone), ["vector_name", "raster_name"], "left_anti").join(shuffled(more), "vector_name", "left")
        choices = durable(rest.select("vector_name", "raster_name", "draw", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have")))
    return reduce(DataFrame.unionByName, done)


__all__ = [
    "best_product", "check_products", "cut_around_vectors", "dem_tiles", "downloaded_twice", "not_covered_by_union", "plan_downloads", "product_file", "record_downloads",
    "stem", "vectors_to_download",
]
