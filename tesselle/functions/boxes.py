"""Axis-aligned boxes and points as column expressions, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in miles, and metres to the mile, as the great-circle formula takes them.
EARTH_MILES, METRES = 3958.75, 1609.0


class Box:
    """The columns x0, y0, x1, y1 of one side, by prefix."""

    def __init__(self, prefix: str):
        self.x0, self.y0, self.x1, self.y1 = (F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))

    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def grown(self, d: float) -> tuple[Column, Column, Column, Column]:
        return self.x0 - d, self.y0 - d, self.x1 + d, self.y1 + d


def _sides(a: Box, b: Box) -> tuple[Column, Column]:
    return F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)


def intersects(a: Box, b: Box) -> Column:
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def interiors_meet(a: Box, b: Box) -> Column:
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def touches(a: Box, b: Box) -> Column:
    return intersects(a, b) & ~interiors_meet(a, b)


def contains(a: Box, b: Box) -> Column:
    return (a.x0 <= b.x0) & (a.y0 <= b.y0) & (a.x1 >= b.x1) & (a.y1 >= b.y1)


def equals(a: Box, b: Box) -> Column:
    return (a.x0 == b.x0) & (a.y0 == b.y0) & (a.x1 == b.x1) & (a.y1 == b.y1)


def overlaps(a: Box, b: Box) -> Column:
    return interiors_meet(a, b) & ~contains(a, b) & ~contains(b, a)


def crosses(a: Box, b: Box) -> Column:
    """Of two upright or level lines: each passes through the inside of the other. Of a line and an area: the line is partly
    inside and partly outside. Two areas never cross, nor do points. A line is a box of no width or no height."""
    flat = lambda s: (s.x0 == s.x1) != (s.y0 == s.y1)
    wide = lambda s: (s.x0 < s.x1) & (s.y0 < s.y1)

    def enters(line: Box, area: Box) -> Column:
        level = (line.y0 == line.y1) & (area.y0 < line.y0) & (line.y0 < area.y1) & (line.x0 < area.x1) & (area.x0 < line.x1)
        upright = (line.x0 == line.x1) & (area.x0 < line.x0) & (line.x0 < area.x1) & (line.y0 < area.y1) & (area.y0 < line.y1)
        return (level | upright) & ~contains(area, line)

    def through(one: Box, two: Box) -> Column:
        return (one.y0 == one.y1) & (two.x0 == two.x1) & (one.x0 < two.x0) & (two.x0 < one.x1) & (two.y0 < one.y0) & (one.y0 < two.y1)

    return (flat(a) & wide(b) & enters(a, b)) | (wide(a) & flat(b) & enters(b, a)) | (flat(a) & flat(b) & (through(a, b) | through(b, a)))


def intersection_area(a: Box, b: Box) -> Column:
    w, h = _sides(a, b)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def union_area(a: Box, b: Box) -> Column:
    return a.area() + b.area() - intersection_area(a, b)


def distance(a: Box, b: Box) -> Column:
    w, h = _sides(a, b)
    dx, dy = F.greatest(-w, F.lit(0)).cast("double"), F.greatest(-h, F.lit(0)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def within_distance(a: Box, b: Box, d: float) -> Column:
    return distance(a, b) <= d


def jaccard(a: Box, b: Box) -> Column:
    return intersection_area(a, b) / union_area(a, b)


def dice(a: Box, b: Box) -> Column:
    return 2 * intersection_area(a, b) / (a.area() + b.area())


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by the haversine formula. x is the latitude and y the longitude, as in the engine this one stands in for."""
    p, q = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((q - p) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = u * u + F.cos(p) * F.cos(q) * v * v
    return F.lit(EARTH_MILES * METRES * 2) * F.atan2(F.sqrt(h), F.sqrt(1 - h))
