"""Geometry as columns: boxes in four numbers, general shapes as nested arrays, exact tests as higher-order functions.

A shape is ``struct<kind string, parts array<array<array<struct<x double, y double>>>>>``: part, ring, point; the first
ring of a part is its shell, further ones are holes. Points and lines are one ring each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
BOX = ("minx", "miny", "maxx", "maxy")


def box_intersects(a: str, b: str) -> Column:
    """Closed boxes with the column prefixes ``a`` and ``b`` have a point in common."""
    return (
        (F.col(f"{a}minx") <= F.col(f"{b}maxx"))
        & (F.col(f"{a}maxx") >= F.col(f"{b}minx"))
        & (F.col(f"{a}miny") <= F.col(f"{b}maxy"))
        & (F.col(f"{a}maxy") >= F.col(f"{b}miny"))
    )


def box_contains(outer: str, inner: str) -> Column:
    return (
        (F.col(f"{outer}minx") <= F.col(f"{inner}minx"))
        & (F.col(f"{inner}maxx") <= F.col(f"{outer}maxx"))
        & (F.col(f"{outer}miny") <= F.col(f"{inner}miny"))
        & (F.col(f"{inner}maxy") <= F.col(f"{outer}maxy"))
    )


def points(shape: Column) -> Column:
    """All points of a shape."""
    return F.flatten(F.flatten(shape["parts"]))


def segments(shape: Column) -> Column:
    """All segments (p, q) of a shape; a single point is a segment of no length."""

    def of_ring(ring: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("p"), F.get(ring, i).alias("q")))
        one = F.transform(ring, lambda p: F.struct(p.alias("p"), p.alias("q")))
        return F.when(F.size(ring) > 1, many).otherwise(one)

    return F.flatten(F.transform(F.flatten(shape["parts"]), of_ring))


def turn(p: Column, q: Column, r: Column) -> Column:
    """Twice the signed area of p, q, r: above 0 if r lies left of the way from p to q."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def _spans(p: Column, q: Column, r: Column) -> Column:
    return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))


def on_segment(s: Column, r: Column) -> Column:
    return (turn(s["p"], s["q"], r) == 0) & _spans(s["p"], s["q"], r)


def crosses(s: Column, t: Column) -> Column:
    """The insides of two segments meet at one point."""
    return (turn(s["p"], s["q"], t["p"]) * turn(s["p"], s["q"], t["q"]) < 0) & (turn(t["p"], t["q"], s["p"]) * turn(t["p"], t["q"], s["q"]) < 0)


def meets(s: Column, t: Column) -> Column:
    """Two closed segments have a point in common."""
    return crosses(s, t) | on_segment(s, t["p"]) | on_segment(s, t["q"]) | on_segment(t, s["p"]) | on_segment(t, s["q"])


def areal(shape: Column) -> Column:
    return shape["kind"].isin("Polygon", "MultiPolygon")


def inside(point: Column, shape: Column) -> Column:
    """The point is in an areal shape by the parity of crossings over all rings; the boundary itself is undecided here."""

    def crossing(s: Column) -> Column:
        p, q = s["p"], s["q"]
        at = p["x"] + (point["y"] - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) * (q["x"] - p["x"])
        return ((p["y"] > point["y"]) != (q["y"] > point["y"])) & (point["x"] < at)

    return areal(shape) & (F.size(F.filter(segments(shape), crossing)) % 2 == 1)


def on_boundary(point: Column, shape: Column) -> Column:
    return F.exists(segments(shape), lambda s: on_segment(s, point))


def intersects(a: Column, b: Column) -> Column:
    """Closed shapes have a point in common: segments meet, or a part of one lies inside the other."""
    edges = F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: meets(s, t)))
    return edges | F.exists(points(a), lambda p: inside(p, b)) | F.exists(points(b), lambda p: inside(p, a))


def contains(outer: Column, inner: Column) -> Column:
    """No point of ``inner`` is outside the areal ``outer`` and their insides meet; a shared boundary is fine."""

    corners = points(outer)

    def middles(s: Column) -> Column:
        """The middles of the stretches into which the outer's corners cut an inner segment."""
        p, q = s["p"], s["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        length = dx * dx + dy * dy
        on = F.filter(corners, lambda c: on_segment(s, c))
        place = F.transform(on, lambda c: ((c["x"] - p["x"]) * dx + (c["y"] - p["y"]) * dy) / F.when(length > 0, length).otherwise(F.lit(1.0)))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), place)))
        return once(cuts, lambda c: F.transform(
            F.sequence(F.lit(1), F.size(c) - 1),
            lambda i: F.struct((p["x"] + (F.get(c, i - 1) + F.get(c, i)) / 2 * dx).alias("x"), (p["y"] + (F.get(c, i - 1) + F.get(c, i)) / 2 * dy).alias("y")),
        ))

    probes = F.concat(points(inner), F.flatten(F.transform(segments(inner), middles)))
    covered = F.forall(probes, lambda p: inside(p, outer) | on_boundary(p, outer))
    clean = ~F.exists(segments(outer), lambda s: F.exists(segments(inner), lambda t: crosses(s, t)))
    no_hole = ~F.exists(points(outer), lambda p: inside(p, inner) & ~on_boundary(p, inner))
    meet = areal(inner) | F.exists(probes, lambda p: inside(p, outer) & ~on_boundary(p, outer))
    return areal(outer) & covered & clean & no_hole & meet


def box_shape(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corners = [(minx, miny), (minx, maxy), (maxx, maxy), (maxx, miny), (minx, miny)]
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("parts"))


def with_bounds(df: DataFrame, shape: str = "geom") -> DataFrame:
    """Adds minx, miny, maxx, maxy and is_box of a shape column: what joins shuffle and prune on."""
    g = F.col(shape)
    xs, ys = F.transform(points(g), lambda p: p["x"]), F.transform(points(g), lambda p: p["y"])
    df = df.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})
    corner = F.forall(points(g), lambda p: p["x"].isin(F.col("minx"), F.col("maxx")) & p["y"].isin(F.col("miny"), F.col("maxy")))
    straight = F.forall(segments(g), lambda s: (s["p"]["x"] == s["q"]["x"]) | (s["p"]["y"] == s["q"]["y"]))
    is_box = (g["kind"] == "Polygon") & (F.size(points(g)) == 5) & corner & straight & (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy"))
    return df.withColumn("is_box", F.coalesce(is_box, F.lit(False)))


def map_points(shape: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The shape with each point (x, y) replaced by f(x, y)."""

    def move(p: Column) -> Column:
        x, y = f(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    parts = F.transform(shape["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, move)))
    return F.struct(shape["kind"].alias("kind"), parts.alias("parts"))


def rounded(shape: Column, digits: int) -> Column:
    """Coordinates rounded half to even."""
    return map_points(shape, lambda x, y: (F.bround(x, digits), F.bround(y, digits)))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where ``value`` occurs once in the expression however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _half(ring: Column, axis: str, bound: Column, low: bool) -> Column:
    """The points of a ring on one side of an axis-parallel line, with those where it is crossed; open, not closed."""
    other = "y" if axis == "x" else "x"

    def step(points_: Column) -> Column:
        def of(p: Column, q: Column) -> Column:
            inside_ = (lambda r: r[axis] >= bound) if low else (lambda r: r[axis] <= bound)
            at = p[other] + (bound - p[axis]) / F.when(q[axis] == p[axis], F.lit(1.0)).otherwise(q[axis] - p[axis]) * (q[other] - p[other])
            cut = F.struct(*[(bound.cast("double") if a == axis else at).alias(a) for a in "xy"])
            here = F.struct(p["x"].alias("x"), p["y"].alias("y"))
            crossed = F.when(inside_(p) != inside_(q), F.array(cut)).otherwise(F.filter(F.array(cut), lambda _: F.lit(False)))
            return F.when(inside_(p), F.concat(F.array(here), crossed)).otherwise(crossed)

        n = F.size(points_)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: of(F.get(points_, i), F.get(points_, (i + 1) % n))))

    return once(ring, lambda r: F.when(F.size(r) > 0, step(r)).otherwise(r))


def clip_to_box(shape: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """What an areal shape shares with a box: each ring cut along the box's four sides. Null if nothing with an area is left.

    Rings that leave the box and return keep edges along its sides, which have no area: bounds, parity and areas are exact.
    """
    box = ((("x", minx, True), ("x", maxx, False)), (("y", miny, True), ("y", maxy, False)))

    def ring(r: Column) -> Column:
        r = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))
        for pair in box:
            for axis, bound, low in pair:
                r = _half(r, axis, bound, low)
        return once(r, lambda x: F.when(F.size(x) > 2, F.concat(x, F.slice(x, 1, 1))))

    def part(rings: Column) -> Column:
        made = F.transform(rings, ring)
        return once(made, lambda m: F.when(F.get(m, 0).isNotNull(), F.filter(m, lambda r: r.isNotNull())))

    parts = F.filter(F.transform(shape["parts"], part), lambda p: p.isNotNull())
    made = once(parts, lambda p: F.when(F.size(p) > 0, F.struct(F.when(F.size(p) > 1, "MultiPolygon").otherwise("Polygon").alias("kind"), p.alias("parts"))))
    return once(made, lambda g: F.when(area(g) > 0, g))


def area(shape: Column) -> Column:
    """Area of an areal shape: shells less their holes, whichever way rings turn."""

    def of_ring(ring: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
        cross = F.transform(at, lambda i: F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))) / 2

    def of_part(part: Column) -> Column:
        sizes = F.transform(part, of_ring)
        return once(sizes, lambda s: 2 * F.get(s, 0) - F.aggregate(s, F.lit(0.0), lambda a, x: a + x))

    return F.aggregate(F.transform(shape["parts"], of_part), F.lit(0.0), lambda a, x: a + x)
