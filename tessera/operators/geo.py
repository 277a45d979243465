"""Points, boxes and polygons as plain columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a closed ring of struct<lng, lat> (even-odd rule)."""
    n = F.size(ring)

    def cross(count, i):
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        spans = (a["lat"] > y) != (b["lat"] > y)
        at = a["lng"] + (y - a["lat"]) * (b["lng"] - a["lng"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return count + F.when(spans & (x < at), 1).otherwise(0)

    return F.when(n < 4, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0), cross) % 2 == 1)


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon of rings, holes counting by the even-odd rule."""
    return F.aggregate(F.transform(rings, lambda r: in_ring(r, x, y).cast("int")), F.lit(0), lambda a, b: a + b) % 2 == 1


def polygon_join(points: DataFrame, x: str, y: str, shapes: DataFrame, rings: str, cell: float = 1.0) -> DataFrame:
    """points x shapes that hold them: by grid cell of the boxes, then box, then polygon.

    shapes needs min_x, min_y, max_x, max_y.
    """
    at = lambda c: F.floor(c / cell)
    laid = shapes.withColumn("_i", F.explode(F.sequence(at(F.col("min_x")), at(F.col("max_x"))))).withColumn("_j", F.explode(F.sequence(at(F.col("min_y")), at(F.col("max_y")))))
    near = points.withColumns({"_i": at(F.col(x)), "_j": at(F.col(y))}).join(laid, ["_i", "_j"])
    box = (F.col(x) >= F.col("min_x")) & (F.col(x) <= F.col("max_x")) & (F.col(y) >= F.col("min_y")) & (F.col(y) <= F.col("max_y"))
    return near.where(box).where(in_polygon(F.col(rings), F.col(x), F.col(y))).drop("_i", "_j")


def bounds(rings: Column) -> dict[str, Column]:
    """min and max columns of a polygon."""
    flat = F.flatten(rings)
    return {"min_x": F.array_min(F.transform(flat, lambda p: p["lng"])), "min_y": F.array_min(F.transform(flat, lambda p: p["lat"])), "max_x": F.array_max(F.transform(flat, lambda p: p["lng"])), "max_y": F.array_max(F.transform(flat, lambda p: p["lat"]))}


def centroid(ring: Column) -> Column:
    """struct<lng, lat>: the mean of a closed ring's corners."""
    corners = F.slice(ring, 1, F.size(ring) - 1)
    mean = lambda f: F.aggregate(F.transform(corners, lambda p: p[f]), F.lit(0.0), lambda a, v: a + v) / F.size(corners)
    return F.struct(mean("lng").alias("lng"), mean("lat").alias("lat"))


def _sides(ring: Column, value) -> Column:
    """The sum of value(a, b, cross product) over the sides of a closed ring."""

    def add(total, i):
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        return total + value(a, b, a["lng"] * b["lat"] - b["lng"] * a["lat"])

    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), add))


def signed_area(ring: Column) -> Column:
    """A closed ring's area in square units of its corners, negative if it runs clockwise; 0 for fewer than three corners."""
    return _sides(ring, lambda a, b, cross: cross) / 2


def _first_less_rest(values: Column) -> Column:
    """The first of an array less the sum of the others; 0 for none."""
    return F.aggregate(F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(-v)), F.lit(0.0), lambda a, v: a + v)


def area(rings: Column) -> Column:
    """A polygon's area: its first ring less its holes, however they run; the holes are taken to lie inside and apart."""
    return _first_less_rest(F.transform(rings, lambda r: F.abs(signed_area(r))))


def weighted_centroid(rings: Column) -> Column:
    """struct<lng, lat>: a polygon's centre of mass, holes left out; the mean of the corners where the area is 0."""
    moment = lambda f: _first_less_rest(F.transform(rings, lambda r: _sides(r, lambda a, b, cross: (a[f] + b[f]) * cross) * F.signum(signed_area(r)) / 6))
    whole, plain = area(rings), centroid(F.element_at(rings, 1))
    at = lambda f: F.when(whole > 0, moment(f) / whole).otherwise(plain[f])
    return F.when(F.size(rings) > 0, F.struct(at("lng").alias("lng"), at("lat").alias("lat")))


def _farthest(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the greatest value of each run lies, the first of equals; runs are not empty."""
    d = np.where(np.isnan(d), np.inf, d)
    run = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(d == np.maximum.reduceat(d, starts)[run])
    return at[np.unique(run[at], return_index=True)[1]]


def _kept_of_all(x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Which corners of closed rings, one behind the other, stay: the first, the one farthest from it, and between two that stay
    the one farthest from their chord, if it is farther than the tolerance.  All open chords of all rings take a step at once."""
    keep = np.zeros(len(x), bool)
    first, last = np.repeat(starts, sizes), starts + sizes - 1
    far = _farthest((x - x[first]) ** 2 + (y - y[first]) ** 2, starts, sizes)
    keep[np.concatenate([starts, far, last])] = True
    a, b = np.concatenate([starts, far]), np.concatenate([far, last])
    while True:
        wide = b - a >= 2
        a, b = a[wide], b[wide]
        if not len(a):
            return keep
        n = b - a - 1
        begin = np.cumsum(n) - n
        inner = np.repeat(a + 1 - begin, n) + np.arange(n.sum())
        from_, cx, cy = np.repeat(a, n), np.repeat(x[b] - x[a], n), np.repeat(y[b] - y[a], n)
        dx, dy, size = x[inner] - x[from_], y[inner] - y[from_], cx * cx + cy * cy
        along = np.where(size > 0, np.clip((dx * cx + dy * cy) / np.where(size > 0, size, 1), 0, 1), 0)
        d = np.hypot(dx - along * cx, dy - along * cy)
        at = _farthest(d, begin, n)
        out = d[at] > tolerance
        mid = inner[at][out]
        keep[mid] = True
        a, b = np.concatenate([a[out], mid]), np.concatenate([mid, b[out]])


def _kept(x: np.ndarray, tolerance: float) -> np.ndarray:
    """The same of one ring."""
    return _kept_of_all(x[:, 0], x[:, 1], np.array([0]), np.array([len(x)]), tolerance)


def simplify(rings: Column, tolerance: float) -> Column:
    """The polygon with fewer corners: none that is left out lies farther than the tolerance from the outline.

    A hole that fewer than three corners are left of goes; a first ring of which that is so stays as it was.  Null stays null.
    """
    ring = "array<struct<lng:double,lat:double>>"

    @F.arrow_udf(f"array<{ring}>")
    def run(polygons: pa.Array) -> pa.Array:
        length = lambda lists: pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        of_polygon, every = length(polygons), polygons.flatten()
        sizes, corners = length(every), every.flatten()
        x, y = (pc.struct_field(corners, f).to_numpy(zero_copy_only=False).astype(float) for f in ("lng", "lat"))
        owner, large = np.repeat(np.arange(len(sizes)), sizes), sizes >= 4
        keep = np.ones(len(x), bool)
        if large.any():
            among, n = large[owner], sizes[large]
            keep[among] = _kept_of_all(x[among], y[among], np.cumsum(n) - n, n, tolerance)
        left = np.bincount(owner, keep, len(sizes)).astype(np.int64)
        first = np.zeros(len(sizes), bool)
        first[(np.cumsum(of_polygon) - of_polygon)[of_polygon > 0]] = True
        enough = left >= 4
        shown = enough | first
        stays = np.where(enough[owner], keep, first[owner])
        parts = pa.ListArray.from_arrays(offsets(np.where(enough, left, sizes)[shown]), corners.filter(pa.array(stays)))
        n = np.bincount(np.repeat(np.arange(len(of_polygon)), of_polygon), shown, len(of_polygon)).astype(np.int64)
        return pa.ListArray.from_arrays(offsets(n), parts, mask=polygons.is_null())

    return run(rings.cast(f"array<{ring}>"))


def valid_wgs84(rings: Column) -> Column:
    """Whether all corners are degrees."""
    return F.forall(F.flatten(rings), lambda p: p["lng"].between(-180, 180) & p["lat"].between(-90, 90))


def feature(geometry: Column, properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
