"""Joins of simple polygons: each is cut into rectangles or triangles once, pairs whose boxes meet are found tile by tile, and
exact geometry decides on whole batches of them.

Polygons of upright and level edges are cut into rectangles. How depends on the order of their coordinates only, so polygons
of the same form are cut together, and their pairs need no more than least and greatest values.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygons
from .durable import durable
from .tiles import distances as boxes_apart
from .tiles import near, numbers, streamed_in_tiles

MEASURED = "id1 long, id2 long, area1 double, area2 double, inter double, distance double, meets boolean"
#: Each predicate over the measures of pairs; two areas never cross.
PREDICATES = {
    "st_intersects": lambda meets, inter, area1, area2, distance, d: meets,
    "st_adjacent": lambda meets, inter, area1, area2, distance, d: meets,
    "st_disjoint": lambda meets, inter, area1, area2, distance, d: ~meets,
    "st_touches": lambda meets, inter, area1, area2, distance, d: meets & (inter == 0),
    "st_overlaps": lambda meets, inter, area1, area2, distance, d: (inter > 0) & (inter < area1) & (inter < area2),
    "st_contains": lambda meets, inter, area1, area2, distance, d: (inter > 0) & (inter == area2),
    "st_within": lambda meets, inter, area1, area2, distance, d: (inter > 0) & (inter == area1),
    "st_equals": lambda meets, inter, area1, area2, distance, d: (inter > 0) & (inter == area1) & (inter == area2),
    "st_crosses": lambda meets, inter, area1, area2, distance, d: np.zeros(len(meets), bool),
    "st_dwithin": lambda meets, inter, area1, area2, distance, d: distance <= d,
}


PIECES = "id long, rects array<double>, parts array<double>, signs array<double>, rings array<double>, sizes array<int>, area double, x0 double, y0 double, x1 double, y1 double"


@functools.lru_cache(10_000)
def _form(sizes: tuple[int, ...], places: bytes) -> tuple | bool:
    """Rectangles, opened rings and box of a polygon whose corners are given by their places among its distinct coordinates (all
    x, then all y); all are places, too. False if a ring crosses itself, true if it has to be cut as other polygons are."""
    x, y = np.frombuffer(places, np.int32).reshape(2, -1).tolist()
    at = np.cumsum([0, *sizes]).tolist()
    rings = [polygons.opened(list(zip(x[low:high], y[low:high], strict=True))) for low, high in zip(at, at[1:], strict=False)]
    if any(len(ring) < 4 for ring in rings):
        return True
    if any(polygons.crosses_itself(ring) for ring in rings):
        return False
    rects = polygons.rectangles(rings)
    whole = sum((-1 if k else 1) * polygons.polygon_area(ring) for k, ring in enumerate(rings))
    if any(polygons.touches_itself(ring) for ring in rings) or sum((r[2] - r[0]) * (r[3] - r[1]) for r in rects) != whole:
        return True
    ends = [f(v) for f in (min, max) for v in zip(*rings[0], strict=True)]
    return np.array(rects), np.array([p for ring in rings for p in ring]), [len(ring) for ring in rings], ends


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the places of its values among its distinct ones, and these."""
    order = np.argsort(values, axis=1, kind="stable")
    ranged = np.take_along_axis(values, order, axis=1)
    step = np.zeros(values.shape, np.int32)
    step[:, 1:] = np.cumsum(ranged[:, 1:] != ranged[:, :-1], axis=1)
    places, distinct = np.empty_like(step), np.zeros_like(values)
    np.put_along_axis(places, order, step, axis=1)
    np.put_along_axis(distinct, step, ranged, axis=1)
    return places, distinct


def _alike(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct rows, and where each is."""
    distinct, which = np.unique(rows, axis=0, return_inverse=True)
    order = np.argsort(which.reshape(-1), kind="stable")
    yield from zip(distinct, np.split(order, np.cumsum(np.bincount(which.reshape(-1)))[:-1]), strict=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows (id, ...) shared out, so that polygons from a single file are made and cut by all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, "id") if df.rdd.getNumPartitions() < cores else df


def pieces(df: DataFrame) -> DataFrame:
    """id, rects (rectangles, 4 numbers each) or else parts (triangles, 6 numbers each) and signs (1, or -1 for parts of holes),
    rings (opened ones, 2 numbers a corner), sizes (corners of each ring), area and the box of each polygon (id, ring, and
    holes if there is such a column).

    Each polygon is cut once, before it meets any other. Holes lie inside their polygon and apart from each other. Polygons
    with a ring that is null or empty, or crosses or touches itself, are dropped; null holes are none.
    """
    kinds = [pa.int64(), *[pa.list_(pa.float64())] * 4, pa.list_(pa.int32()), *[pa.float64()] * 5]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(points: list[tuple[float, float]]) -> tuple[list, list]:
        parts = [p for p in polygons.triangles(points) if len(p) == 3 and polygons.polygon_area(p) > 0]
        return [p if polygons.cross(*p) > 0 else p[::-1] for p in parts], polygons.opened(points) or points[:1]

    def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rings = batch["id"], batch["rings"]
            owner = np.repeat(np.arange(len(rings)), np.diff(rings.offsets.to_numpy()))
            inner = rings.flatten()
            size = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 2
            xy = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 2)
            start = np.cumsum(size) - size
            owner, size, start = (v[size > 0] for v in (owner, size, start))
            count = np.bincount(owner, minlength=len(rings))
            first = np.cumsum(count) - count
            out, others = [], []
            for n in np.unique(count[count > 0]).tolist():
                who = np.flatnonzero(count == n)
                rows = first[who][:, None] + np.arange(n)
                for sizes, among in _alike(size[rows]):
                    sizes, mine = sizes.tolist(), who[among]
                    corner = np.concatenate([start[rows[among, k]][:, None] + np.arange(m) for k, m in enumerate(sizes)], axis=1)
                    following = np.concatenate([at + np.roll(np.arange(m), -1) for m, at in zip(sizes, np.cumsum([0, *sizes]).tolist(), strict=False)])
                    x, y = xy[corner, 0], xy[corner, 1]
                    plain = ((x == x[:, following]) | (y == y[:, following])).all(axis=1) & np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
                    others += mine[~plain].tolist()
                    mine, (px, x), (py, y) = mine[plain], _ranked(x[plain]), _ranked(y[plain])
                    for form, like in _alike(np.concatenate([px, py], axis=1)) if len(mine) else ():
                        made = _form(tuple(sizes), form.tobytes())
                        if made is True:
                            others += mine[like].tolist()
                        if isinstance(made, bool):
                            continue
                        rects, points, opened, ends = made
                        own, up = x[like], y[like]
                        sides = [own[:, rects[:, 0]], up[:, rects[:, 1]], own[:, rects[:, 2]], up[:, rects[:, 3]]]
                        area = ((sides[2] - sides[0]) * (sides[3] - sides[1])).sum(axis=1)
                        corners = np.stack([own[:, points[:, 0]], up[:, points[:, 1]]], axis=2)
                        flat = [lists(v.reshape(len(like), -1), pa.float64()) for v in (np.stack(sides, axis=2), np.empty((len(like), 0)), np.empty((len(like), 0)), corners)]
                        box = [own[:, ends[0]], up[:, ends[1]], own[:, ends[2]], up[:, ends[3]]]
                        out.append(pa.Table.from_arrays([ids.take(pa.array(mine[like])), *flat, lists(np.tile(opened, (len(like), 1)), pa.int32()), *map(pa.array, (area, *box))], schema=pa.schema(list(zip(names, kinds, strict=True)))))
            rows = []
            for k in others:
                every = [xy[start[r] : start[r] + size[r]].tolist() for r in range(first[k], first[k] + count[k])]
                try:
                    found = [cut([tuple(p) for p in ring]) for ring in every]
                except ValueError:
                    continue
                parts = [p for own, _ in found for p in own]
                signs = [1.0 if n == 0 else -1.0 for n, (own, _) in enumerate(found) for _ in own]
                area = sum(sign * polygons.polygon_area(p) for sign, p in zip(signs, parts, strict=True))
                x, y = zip(*found[0][1], strict=True)
                rows.append((ids[k].as_py(), [], np.array(parts).reshape(-1), signs, np.concatenate([np.array(r).reshape(-1) for _, r in found]), [len(r) for _, r in found], area, min(x), min(y), max(x), max(y)))
            if rows:
                out.append(pa.Table.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    numbers = lambda ring: F.flatten(F.transform(ring, lambda v: F.array(v["x"].cast("double"), v["y"].cast("double"))))
    whole = F.forall("ring", lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    none = F.array().cast("array<array<double>>")
    holes = F.coalesce(F.transform("holes", numbers), none) if "holes" in df.columns else none
    rows = spread(df).filter(F.size("ring") > 0).filter(whole).select(F.col("id").cast("long").alias("id"), F.concat(F.array(numbers(F.col("ring"))), holes).alias("rings"))
    return rows.mapInArrow(run, PIECES)


def measures(a: DataFrame, b: DataFrame, d: float = 0.0, distances: bool = True, wanted: Callable | None = None, columns: str = MEASURED) -> DataFrame:
    """id1, id2, area1, area2, inter, distance, meets of each pair (id, ring, and holes if any) whose boxes are within d of
    each other.

    A polygon is its outer ring less its holes, so areas in common are sums over pairs of parts with the product of their
    signs. The common area is set to the smaller area where it differs from it by a rounding error. Without holes
    two polygons meet if any of their parts do; with holes if they have area in common or their rings touch. Without
    `distances`, that of pairs that don't meet is null. Polygons meet in tiles; all pairs of parts in a batch of pairs are
    measured together, and pairs that aren't `wanted` (meets, inter, area1, area2, distance as arrays) stay there. `columns`
    may name fewer of these.

    Two polygons of rectangles need no other measures than those of pairs of rectangles, which are disjoint parts of them.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """All values of a column of lists, and where each list begins and the last one ends."""
        column = table[name].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        ends = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]

    class Side:
        """The polygons of a table as flat arrays: rectangles, triangles, rings and their edges."""

        def __init__(self, table: pa.Table):
            self.box, self.area = numbers(table), table["area"].to_numpy()
            flat, at = lists(table, "rects")
            self.rects, self.rect = np.ascontiguousarray(flat.reshape(-1, 4).T), at // 4
            self.number = np.diff(self.rect)
            flat, at = lists(table, "parts")
            self.parts, self.first = flat.reshape(-1, 3, 2), at // 6
            self.signs = lists(table, "signs")[0]
            flat, at = lists(table, "rings")
            self.corners, self.corner = flat.reshape(-1, 2), at // 2
            self.sizes, self.size = lists(table, "sizes")
            # each corner's following one in its own ring
            self.following = np.arange(1, len(self.corners) + 1)
            ends = np.cumsum(self.sizes)
            self.following[ends - 1] = ends - self.sizes
            self.far = np.maximum.reduceat(np.abs(self.corners).max(axis=1), self.corner[:-1]) if len(table) else np.empty(0)

        def halve(self) -> None:
            """Two triangles for each rectangle, so that they can meet triangles."""
            x0, y0, x1, y1 = self.rects
            halves = np.stack([np.stack(c, axis=1) for c in ((x0, y0), (x1, y0), (x1, y1), (x0, y0), (x1, y1), (x0, y1))], axis=1).reshape(-1, 3, 2)
            many = np.diff(self.first)
            owner = np.concatenate([np.repeat(np.arange(len(many)), many), np.repeat(np.arange(len(many)), 2 * self.number)])
            order = np.argsort(owner, kind="stable")
            self.parts = np.concatenate([self.parts, halves])[order]
            self.signs = np.concatenate([self.signs, np.ones(len(halves))])[order]
            self.first = np.concatenate([[0], np.cumsum(many + 2 * self.number)])

        def rings(self, k: int) -> list[list[tuple[float, float]]]:
            out, at = [], self.corner[k]
            for size in self.sizes[self.size[k] : self.size[k + 1]].tolist():
                out.append([tuple(p) for p in self.corners[at : at + size].tolist()])
                at += size
            return out

        def shapes(self, k: int) -> list:
            return [[tuple(p) for p in t] for t in self.parts[self.first[k] : self.first[k + 1]].tolist()] or [self.rings(k)[0]]

    def all_of(one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs (i, j) of lists that begin where `one` and `two` say: the pair's number, and each item with each item."""
        n, m = one[i + 1] - one[i], two[j + 1] - two[j]
        pair = np.repeat(np.arange(len(i)), n * m)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        return pair, one[i][pair] + at // np.maximum(m[pair], 1), two[j][pair] + at % np.maximum(m[pair], 1)

    def gaps(one: Side, i: np.ndarray, two: Side, j: np.ndarray) -> np.ndarray:
        """Least distances of the pairs' boundaries."""
        out = np.full(len(i), np.inf)
        for s, p, t, q in ((one, i, two, j), (two, j, one, i)):
            pair, corner, edge = all_of(s.corner, p, t.corner, q)
            np.minimum.at(out, pair, polygons.segment_distances(s.corners[corner], t.corners[edge], t.corners[t.following[edge]]))
        return out

    def rounded(inter: np.ndarray, area1: np.ndarray, area2: np.ndarray) -> np.ndarray:
        slack = polygons.SAME * np.maximum(area1, area2)
        inter[inter <= slack] = 0.0
        for area in (np.maximum(area1, area2), np.minimum(area1, area2)):
            inter = np.where((inter > 0) & (np.abs(inter - area) <= slack), area, inter)
        return inter

    def of_rectangles(one: Side, i: np.ndarray, two: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `measured`, of pairs of polygons of so and so many rectangles, the same numbers for all of them."""
        inter, meets, away = np.zeros(len(i)), np.zeros(len(i), bool), np.full(len(i), np.inf if distances else np.nan)
        theirs = [[side[two.rect[j] + v] for side in two.rects] for v in range(two.number[j[0]])]
        for u in range(one.number[i[0]]):
            x0, y0, x1, y1 = (side[one.rect[i] + u] for side in one.rects)
            for p0, q0, p1, q1 in theirs:
                w, h = np.minimum(x1, p1) - np.maximum(x0, p0), np.minimum(y1, q1) - np.maximum(y0, q0)
                meets |= (w >= 0) & (h >= 0)
                if distances:
                    np.minimum(away, np.square(np.minimum(w, 0.0)) + np.square(np.minimum(h, 0.0)), out=away)
                inter += np.maximum(w, 0.0) * np.maximum(h, 0.0)
        away = np.where(meets, 0.0, np.sqrt(away))
        return rounded(inter, one.area[i], two.area[j]), away, meets

    def measured(one: Side, i: np.ndarray, two: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The common area and the distance of pairs, and whether they meet."""
        n, m = one.number[i], two.number[j]
        if (n == n[0]).all() and (m == m[0]).all():
            return of_rectangles(one, i, two, j) if n[0] and m[0] else of_triangles(one, i, two, j)
        inter, distance, meets = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i), bool)
        for (n, m), at in _alike(np.stack([np.where(m > 0, n, 0), np.where(n > 0, m, 0)], axis=1)):
            inter[at], distance[at], meets[at] = (of_rectangles if n and m else of_triangles)(one, i[at], two, j[at])
        return inter, distance, meets

    def of_triangles(one: Side, i: np.ndarray, two: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, first, second = all_of(one.first, i, two.first, j)
        p, q = one.parts[first], two.parts[second]
        close = ((p.min(axis=1) <= q.max(axis=1)) & (q.min(axis=1) <= p.max(axis=1))).all(axis=1)
        sign = one.signs[first[close]] * two.signs[second[close]]
        pair, p, q = pair[close], p[close], q[close]
        met = polygons.triangles_meet(p, q)
        meets = np.bincount(pair[met], minlength=len(i)) > 0
        inter = np.bincount(pair[met], sign[met] * polygons.common_areas(p[met], q[met]), minlength=len(i))
        area1, area2 = one.area[i], two.area[j]
        inter = rounded(inter, area1, area2)
        pierced = (np.diff(one.size)[i] > 1) | (np.diff(two.size)[j] > 1)
        open_ = ~meets | pierced & (inter == 0)
        bare = (np.diff(one.first)[i] == 0) | (np.diff(two.first)[j] == 0)
        for k in np.flatnonzero(open_ & bare).tolist():  # one of them has no area
            meets[k] = polygons.intersects(one.shapes(i[k]), two.shapes(j[k]))
        distance = np.where(meets, 0.0, np.nan)
        asked = np.flatnonzero(open_ & (meets & pierced | ~meets & distances))
        gap = gaps(one, i[asked], two, j[asked])
        meets[asked] &= gap <= polygons.SAME * np.maximum(1.0, one.far[i[asked]])
        distance[asked] = gap if distances else np.nan
        distance[meets] = 0.0
        return inter, distance, meets

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def measure() -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.empty(0, int), np.empty(0, int))
            waiting.clear()
            inter, distance, meets = measured(one, i, two, j) if len(i) else (np.empty(0), np.empty(0), np.empty(0, bool))
            if wanted is not None:
                keep = np.flatnonzero(wanted(meets, inter, one.area[i], two.area[j], distance))
                i, j, inter, distance, meets = (x[keep] for x in (i, j, inter, distance, meets))
            of = {"id1": lambda: ids[0].take(pa.array(i)), "id2": lambda: ids[1].take(pa.array(j)), "area1": lambda: pa.array(one.area[i]), "area2": lambda: pa.array(two.area[j])}
            of |= {"inter": lambda: pa.array(inter), "distance": lambda: pa.array(distance, from_pandas=True), "meets": lambda: pa.array(meets)}
            return pa.RecordBatch.from_arrays([of[c]() for c in names], names)

        one, two, ids = Side(left), Side(right), [x["id"].combine_chunks() for x in (left, right)]
        if (one.number == 0).any() or (two.number == 0).any():
            one.halve()
            two.halve()
        for at, among in near(one.box, two.box, d) if len(left) and len(right) else ():
            p, q = np.nonzero(boxes_apart(one.box[at], two.box[among]) <= d)
            waiting.append((at[p], among[q]))
            if sum(len(p) for p, _ in waiting) > 20_000:
                yield measure()
        yield measure()

    a, b = durable(pieces(a)), durable(pieces(b))
    return streamed_in_tiles(a, b, d, run, columns)


def polygon_join(a: DataFrame, b: DataFrame, predicate: str, d: float = 0.0) -> DataFrame:
    """The pairs that fulfil a predicate, with their statistics. st_disjoint is asked of pairs within d only."""
    found = _found(a, b, predicate, d, MEASURED)
    union = F.col("area1") + F.col("area2") - F.col("inter")
    both = F.col("area1") + F.col("area2")
    return found.select("id1", "id2", "area1", "area2", F.col("inter").alias("intersect_area"), union.alias("union_area"), F.when(union > 0, F.col("inter") / union).otherwise(0.0).alias("jaccard"), F.when(both > 0, 2 * F.col("inter") / both).otherwise(0.0).alias("dice"), "distance")


def polygon_pairs(a: DataFrame, b: DataFrame, predicate: str, d: float = 0.0) -> DataFrame:
    """id1, id2 of the pairs that fulfil a predicate."""
    return _found(a, b, predicate, d, "id1 long, id2 long")


def _found(a: DataFrame, b: DataFrame, predicate: str, d: float, columns: str) -> DataFrame:
    if predicate not in PREDICATES:
        raise ValueError(f"no such predicate: {predicate}")
    if d < 0 or predicate == "st_dwithin" and d == 0:
        raise ValueError("the distance must be positive")
    true = PREDICATES[predicate]
    return measures(a, b, d, predicate in ("st_disjoint", "st_dwithin"), lambda *measure: true(*measure, d), columns)


def buffered_areas(df: DataFrame, d: float, quadrant: int = 8) -> DataFrame:
    """id, ring, area: boxes (id, x0, y0, x1, y1) grown by d, with round corners of `quadrant` chords a quarter."""

    if d <= 0:
        raise ValueError("the distance must be positive")
    steps = 4 * quadrant
    turns = [(d * math.cos(2 * math.pi * k / steps), d * math.sin(2 * math.pi * k / steps)) for k in range(steps)]

    # from the lowest of the leftmost corners on, counter-clockwise
    quarters = [np.array([turns[(k * quadrant + s) % steps] for s in range(quadrant + 1)]) for k in (2, 3, 0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, y0, x1, y1 = (batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x0", "y0", "x1", "y1"))
            x0, x1, y0, y1 = np.minimum(x0, x1), np.maximum(x0, x1), np.minimum(y0, y1), np.maximum(y0, y1)
            corners = [np.stack(c, axis=1)[:, None] + q for c, q in zip(((x0, y0), (x1, y0), (x1, y1), (x0, y1)), quarters, strict=True)]
            rings = np.concatenate(corners, axis=1)
            off = rings - rings[:, :1]
            turned = np.roll(off, -1, axis=1)
            area = np.abs((off[..., 0] * turned[..., 1] - off[..., 1] * turned[..., 0]).sum(axis=1)) / 2
            kept = (rings != np.roll(rings, 1, axis=1)).any(axis=2)  # a box of no width or height has corners in one place
            points = rings[kept]
            ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
            ring = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.int64()), ring, pa.array(area)], ["id", "ring", "area"])

    df = df.select("id", "x0", "y0", "x1", "y1").dropna()
    return df.mapInArrow(run, "id long, ring array<struct<x:double,y:double>>, area double")
