"""Points, lines and convex polygons: WKT text, rings as array<struct<x,y>>, and convex geometry in Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WKT = r"(?i)^\s*(POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)+\s*$"


def ring_of(wkt: Column) -> Column:
    """The vertices of a POINT, LINESTRING or hole-free POLYGON; null for other or broken text, which callers drop."""
    pairs = F.split(F.trim(F.regexp_extract(wkt, WKT, 2)), r"\s*,\s*")
    number = lambda p, k: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    ring = F.transform(pairs, lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    whole = F.forall(ring, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return F.when(F.regexp_like(wkt, F.lit(WKT)) & whole, ring)


#: A polygon with holes: its rings in parentheses of their own.
RINGS = r"(?i)^\s*POLYGON\s*\(\s*\([^()]*\)(\s*,\s*\([^()]*\))*\s*\)\s*$"


def holes_of(wkt: Column) -> Column:
    """The holes of a POLYGON as an array of rings, empty without any; null for broken text."""
    number = lambda p, k: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    ring = lambda text: F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    rings = F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]*)\)"), 1), ring)
    whole = F.forall(rings, lambda r: F.forall(r, lambda v: v["x"].isNotNull() & v["y"].isNotNull()))
    return F.when(F.regexp_like(wkt, F.lit(RINGS)) & whole, F.slice(rings, 2, 1 << 30))


def outline_of(wkt: Column) -> Column:
    """The outer ring of a POLYGON with or without holes, or what ring_of gives."""
    outer = F.regexp_replace(wkt, r"(?s)^(\s*\w+\s*\(\s*\([^()]*\)).*$", "$1)")
    return F.when(F.regexp_like(wkt, F.lit(RINGS)) & holes_of(wkt).isNotNull(), ring_of(outer)).otherwise(ring_of(wkt))


def kind_of(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, WKT, 1))


def to_wkt(ring: Column) -> Column:
    """POLYGON text of a ring, closed if it isn't."""
    closed = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    plain = lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(closed, lambda v: F.concat(plain(v["x"]), F.lit(" "), plain(v["y"]))), ","), F.lit("))"))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get(ring, k - 1)["x"] * F.get(ring, k)["y"] - F.get(ring, k)["x"] * F.get(ring, k - 1)["y"])
    return F.when(n > 2, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(F.lit(0.0))


def envelope(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]


def hilbert(x: Column, y: Column, bits: int = 20) -> Column:
    """Place along the Hilbert curve of a 2^bits square of the cell (x, y), by the bit-wise walk from the top."""

    def place(x: pd.Series, y: pd.Series) -> pd.Series:
        none = x.isna() | y.isna()
        u, v = (c.fillna(0).to_numpy().astype(np.int64) for c in (x, y))
        d = np.zeros(len(u), np.int64)
        for k in range(bits - 1, -1, -1):
            s = np.int64(1) << k
            rx, ry = (u & s > 0).astype(np.int64), (v & s > 0).astype(np.int64)
            d += s * s * ((3 * rx) ^ ry)
            u, v = u & (s - 1), v & (s - 1)
            flip, turn = (ry == 0) & (rx == 1), ry == 0
            u, v = np.where(flip, s - 1 - u, u), np.where(flip, s - 1 - v, v)
            u, v = np.where(turn, v, u), np.where(turn, u, v)
        return pd.Series(d).astype("Int64").mask(none.to_numpy())

    return F.pandas_udf(place, "long")(x.cast("long"), y.cast("long"))


Points = list[tuple[float, float]]


def convex_hull(points: Points) -> Points:
    """Counter-clockwise hull without the closing vertex."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: Points) -> Points:
        out: Points = []
        for p in seq:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def polygon_area(points: Points) -> float:
    if len(points) < 3:
        return 0.0
    p = np.array(points)
    q = np.roll(p, -1, axis=0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def clip(subject: Points, window: Points) -> Points:
    """The part of a convex polygon inside another one: cut by each edge of the window in turn."""
    out = convex_hull(subject)
    edges = convex_hull(window)
    for a, b in zip(edges, edges[1:] + edges[:1], strict=True):
        kept: Points = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            here, there = cross(a, b, p), cross(a, b, q)
            if here >= 0:
                kept.append(p)
            if (here > 0 > there) or (here < 0 < there):
                t = here / (here - there)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            break
    return out


def segment_distance(p, a, b) -> float:
    ax, ay, bx, by = *a, *b
    length = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0.0 if not length else max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / length))
    return float(np.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)))


def convex_intersects(a: Points, b: Points) -> bool:
    """Closed sets: touching counts. Separating axes; also for points and segments."""
    for poly in (a, b):
        hull = convex_hull(poly)
        for p, q in zip(hull, hull[1:] + hull[:1], strict=True):
            for nx, ny in (((q[1] - p[1]), (p[0] - q[0])), ((q[0] - p[0]), (q[1] - p[1]))):
                one, two = [nx * x + ny * y for x, y in a], [nx * x + ny * y for x, y in b]
                if max(one) < min(two) or max(two) < min(one):
                    return False
    return len(a) > 1 or len(b) > 1 or a[0] == b[0]


def convex_distance(a: Points, b: Points) -> float:
    if convex_intersects(a, b):
        return 0.0
    best = np.inf
    for one, two in ((a, b), (b, a)):
        hull = convex_hull(two)
        best = min([best, *(segment_distance(p, u, v) for p in one for u, v in zip(hull, hull[1:] + hull[:1], strict=True))])
    return best


def buffered(points: Points, d: float, quadrant: int = 8) -> Points:
    """A convex shape (point, segment or polygon) grown by d, its round corners as `quadrant` chords a quarter."""
    if d <= 0:
        raise ValueError("the distance must be positive")
    steps = 4 * quadrant
    return convex_hull([(x + d * math.cos(2 * math.pi * k / steps), y + d * math.sin(2 * math.pi * k / steps)) for x, y in points for k in range(steps)])
