"""Outlines of labelled objects, holes included: edges between pixels that only one object has, linked into rings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Corner = tuple[int, int]


def rings(edges: list[tuple[int, int, int, int]]) -> list[list[Corner]]:
    """Directed unit edges (x0, y0, x1, y1), the object on their left, as closed rings without the closing corner. Where two
    rings meet at a corner, each turns left, so objects that touch by a corner only have a ring each there."""
    after: dict[Corner, list[Corner]] = {}
    for x0, y0, x1, y1 in sorted(edges):
        after.setdefault((x0, y0), []).append((x1, y1))
    out = []
    while after:
        start = min(after)
        ring, at, came = [start], start, None
        while True:
            ways = after[at]
            if came is None or len(ways) == 1:
                step = ways[0]
            else:
                turn = lambda w: (at[0] - came[0]) * (w[1] - at[1]) - (at[1] - came[1]) * (w[0] - at[0])  # noqa: E731, B023
                step = max(ways, key=turn)
            ways.remove(step)
            if not ways:
                del after[at]
            came, at = at, step
            if at == start:
                break
            ring.append(at)
        out.append(ring)
    return out


def contours(mask: DataFrame) -> DataFrame:
    """tile, label, hole, ring (corners of pixels), area: every outline of every labelled object.

    A pixel (x, y) is the unit square from its own coordinates on. Outer rings have a positive area, holes a negative one, so an
    object's areas add up to its pixels. Edges that two pixels of an object have in common cancel out before
    anything goes to Python, so a task gets outlines only. Straight runs keep only their ends. Label 0 is background.
    """
    x, y = F.col("x"), F.col("y")
    corner = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    sides = F.array(corner(x, y, x + 1, y), corner(x + 1, y, x + 1, y + 1), corner(x + 1, y + 1, x, y + 1), corner(x, y + 1, x, y))
    own = mask.filter("label <> 0 and y is not null and x is not null").select("tile", "label", "y", "x").distinct()
    edges = own.select("tile", "label", F.explode(sides).alias("e"))
    place = [F.least("e.x0", "e.x1").alias("px"), F.least("e.y0", "e.y1").alias("py"), (F.col("e.x0") != F.col("e.x1")).alias("level")]
    single = edges.groupBy("tile", "label", *place).agg(F.count("*").alias("n"), F.first("e").alias("e")).filter("n = 1")
    flat = single.groupBy("tile", "label").agg(F.flatten(F.collect_list(F.array("e.x0", "e.y0", "e.x1", "e.y1"))).cast("array<long>").alias("edges"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tile, label, numbers in zip(frame["tile"], frame["label"], frame["edges"], strict=True):
                n = numbers.tolist()
                for ring in rings([tuple(n[k : k + 4]) for k in range(0, len(n), 4)]):
                    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
                    bent = [p for k, p in enumerate(ring) if (ring[k - 1][0] == p[0]) != (p[0] == ring[(k + 1) % len(ring)][0])]
                    out.append((tile, label, area < 0, [{"x": float(x), "y": float(y)} for x, y in bent], area))
            yield pd.DataFrame(out, columns=["tile", "label", "hole", "ring", "area"])

    return flat.select(F.col("tile").cast("int"), F.col("label").cast("long"), "edges").mapInPandas(run, "tile int, label long, hole boolean, ring array<struct<x:double,y:double>>, area double")
