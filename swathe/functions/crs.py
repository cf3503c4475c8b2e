"""Coordinate systems as columns: longitude and latitude (4326), web mercator (3857) and UTM zones (326xx, 327xx)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
_K0, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def _zone(epsg: int) -> tuple[float, float]:
    """(central meridian in radians, false northing) of a UTM zone."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return math.radians(epsg % 100 * 6 - 183), 0.0 if epsg < 32700 else _SOUTH
    raise ValueError(f"EPSG {epsg} is not supported: 4326, 3857, 326xx and 327xx are")


Stage = Callable[[Column], Column]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _series(terms: tuple[float, ...], p: Column, other: bool) -> Column:
    """Sum over j of terms[j - 1] * cos(2jx) sinh(2jy) if ``other``, else sin(2jx) cosh(2jy), of a point (x, y)."""
    f, g = (F.cos, F.sinh) if other else (F.sin, F.cosh)
    return sum((a * f(2 * j * p["x"]) * g(2 * j * p["y"]) for j, a in enumerate(terms, 1)), F.lit(0.0))


def _from_degrees(epsg: int) -> list[Stage]:
    if epsg == 4326:
        return []
    if epsg == 3857:
        return [lambda p: _point(F.radians(p["x"]) * _A, F.lit(_A) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)))]
    meridian, north = _zone(epsg)

    def conformal(p: Column) -> Column:
        s = F.sin(F.radians(p["y"]))
        return _point(F.radians(p["x"]) - meridian, F.sinh(F.atanh(s) - _E * F.atanh(_E * s)))

    def angles(p: Column) -> Column:
        d, t = p["x"], p["y"]
        return _point(F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t)))

    def metres(p: Column) -> Column:
        x, y = p["y"] + _series(_ALPHA, p, True), p["x"] + _series(_ALPHA, p, False)
        return _point(x * (_K0 * _RADIUS) + _EAST, y * (_K0 * _RADIUS) + north)

    return [conformal, angles, metres]


def _to_degrees(epsg: int) -> list[Stage]:
    if epsg == 4326:
        return []
    if epsg == 3857:
        return [lambda p: _point(F.degrees(p["x"] / _A), F.degrees(2 * F.atan(F.exp(p["y"] / _A)) - math.pi / 2))]
    meridian, north = _zone(epsg)

    def angles(p: Column) -> Column:
        return _point((p["y"] - north) / (_K0 * _RADIUS), (p["x"] - _EAST) / (_K0 * _RADIUS))

    def plain(p: Column) -> Column:
        return _point(p["x"] - _series(_BETA, p, False), p["y"] - _series(_BETA, p, True))

    def sphere(p: Column) -> Column:
        return _point(F.atan2(F.sinh(p["y"]), F.cos(p["x"])) + meridian, F.asin(F.sin(p["x"]) / F.cosh(p["y"])))

    def ellipsoid(p: Column) -> Column:
        lat = p["y"] + sum((d * F.sin(2 * j * p["y"]) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
        return _point(F.degrees(p["x"]), F.degrees(lat))

    return [angles, plain, sphere, ellipsoid]


def move_points(found: Column, source: int, target: int) -> Column:
    """An array of points (x, y) in another system. Each step of the projection is a lambda of its own over the array, so
    that what it needs of the step before occurs once in the expression."""
    for stage in [*_to_degrees(source), *_from_degrees(target)] if source != target else []:
        found = F.transform(found, stage)
    return found


def from_degrees(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    p = F.get(move_points(F.array(_point(lon, lat)), 4326, epsg), 0)
    return p["x"], p["y"]


def to_degrees(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    p = F.get(move_points(F.array(_point(x, y)), epsg, 4326), 0)
    return p["x"], p["y"]


def transform(shape: Column, source: int, target: int) -> Column:
    """The shape's vertices in another system; the same column if the systems are equal. Only x and y are kept."""
    if source == target:
        return shape
    parts = F.transform(shape["parts"], lambda part: F.transform(part, lambda ring: move_points(ring, source, target)))
    return F.struct(shape["kind"].alias("kind"), parts.alias("parts"))


def transform_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column, source: int, target: int, steps: int = 21) -> list[Column]:
    """Bounds in another system of a box whose edges are sampled at ``steps`` points each: one struct column's fields."""
    if source == target:
        return [minx, miny, maxx, maxy]

    def edge(k: Column) -> Column:
        t = k / F.lit(float(steps - 1))
        x, y = minx + (maxx - minx) * t, miny + (maxy - miny) * t
        return F.array(_point(x, miny), _point(x, maxy), _point(minx, y), _point(maxx, y))

    moved = move_points(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), edge)), source, target)
    xs, ys = F.transform(moved, lambda p: p["x"]), F.transform(moved, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
