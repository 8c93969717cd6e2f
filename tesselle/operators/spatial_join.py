"""Tiled spatial joins.

Of two boxes that may meet, the wider one is copied to the grid cells that the narrower one's lower-left corner can lie in, and
the narrower one goes to the cell of that corner. Both meet in an equi-join on the cell, and the exact predicate runs on what
is left. A pair has one such corner, so no pair is made twice, and there is no nested loop.

Grids come in levels, one for each power of 4 of the boxes' widths, and cells are about half as wide as the pairs that meet
there. A pair meets at the coarser level of its two boxes. So neither a few wide boxes nor clusters of small ones make cells
with more candidates than there are boxes about as near as they are wide.

The join's partitions are numbered by the candidates that are expected, not by the bytes that are shuffled: a small table can
make a great many pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.boxes import Box
from .durable import durable

BOX = ("x0", "y0", "x1", "y1")
#: Levels finer than this share of the whole space aren't used: boxes of no size go there.
FINEST = 2.0**-20


def _width(df: DataFrame, d: float) -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double") + F.lit(2.0 * d)


def _level(width: Column, finest: int) -> Column:
    """The finest level, of those from `finest` on, whose cells are as wide as a box."""
    own = F.ceil(F.log(F.when(width > 0, width)) / F.lit(math.log(4.0))).cast("int")
    return F.greatest(F.coalesce(own, F.lit(finest)), F.lit(finest))


@dataclass
class Extent:
    """Number, largest and mean sides of the boxes of a level."""

    n: int = 0
    most: tuple[float, float] = (0.0, 0.0)
    total: tuple[float, float] = (0.0, 0.0)

    def __add__(self, other: Extent) -> Extent:
        return Extent(self.n + other.n, tuple(map(max, self.most, other.most)), tuple(map(sum, zip(self.total, other.total, strict=True))))


@dataclass
class Extents:
    """Of both sides: boxes by level, the sides of the box around all, and the largest coordinate."""

    finest: int
    a: dict[int, Extent]
    b: dict[int, Extent]
    span: tuple[float, float]
    far: float


def extents(a: DataFrame, b: DataFrame, d: float) -> Extents:
    """A handful of numbers, from one pass. The first side's boxes are grown by d."""
    side = lambda df, k, d: df.select(*BOX, _width(df, d).alias("w"), F.lit(2.0 * d).alias("more"), F.lit(k).alias("side"))
    both = side(a, 0, d).union(side(b, 1, 0.0)).dropna()
    sides = [(F.col(f"{c}1") - F.col(f"{c}0")).cast("double") + F.col("more") for c in "xy"]
    ends = [f(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)]
    rows = both.groupBy("side", _level(F.col("w"), -10_000).alias("level")).agg(F.count("*"), *[F.max(v) for v in sides], *[F.sum(v) for v in sides], *ends).collect()
    if not rows:
        return Extents(0, {}, {}, (0.0, 0.0), 0.0)
    low, high = ([float(f(r[k] for r in rows)) for k in at] for f, at in ((min, (7, 8)), (max, (9, 10))))
    span = (high[0] - low[0], high[1] - low[1])
    finest = math.ceil(math.log(max(*span, float(d), 1e-9) * FINEST, 4.0))
    found: tuple[dict[int, Extent], dict[int, Extent]] = ({}, {})
    for r in rows:
        level = max(r[1], finest)
        found[r[0]][level] = found[r[0]].get(level, Extent()) + Extent(r[2], (float(r[3]), float(r[4])), (float(r[5]), float(r[6])))
    return Extents(finest, *found, span, max(map(abs, [*low, *high])) + d)


def levels(a: DataFrame, b: DataFrame, d: float) -> tuple[int, list[int], list[int]]:
    """The finest level, and the levels that either side has boxes of."""
    e = extents(a, b, d)
    return e.finest, sorted(e.a), sorted(e.b)


@dataclass
class Grid:
    """The cells in which boxes of a level are covered by one side and met by the corners of the other, no wider, one."""

    level: int
    size: tuple[float, float]
    reach: tuple[float, float]
    copies: float
    candidates: float


def _grids(wide: dict[int, Extent], narrow: dict[int, Extent], e: Extents, strict: bool, cell: float | None) -> list[Grid]:
    out = []
    least = max(*e.span, 1e-9) * FINEST
    for level, own in wide.items():
        others = sum((x for k, x in narrow.items() if k < level or k == level and not strict), Extent())
        if not others.n:
            continue
        mean = [t / own.n for t in own.total]
        # padded, as sums of floating numbers are rounded
        reach = tuple(m + 1e-9 * (m + e.far) for m in others.most)
        size = tuple(cell or max((m + r) / 2, (most + r) / 8, least) for m, r, most in zip(mean, reach, own.most, strict=True))
        copies = own.n * math.prod((m + r) / s + 1 for m, r, s in zip(mean, reach, size, strict=True))
        out.append(Grid(level, size, reach, copies + others.n, copies * others.n / math.prod(max(1.0, w / s) for w, s in zip(e.span, size, strict=True))))
    return out


def _celled(df: DataFrame, prefix: str, d: float, level: Column, covers: list[tuple[int, Grid]], corners: list[tuple[int, Grid, bool]]) -> DataFrame:
    """Copies of each box: for the cells that it covers on its own level's grid, and for its corner's cell on others'."""
    spot = lambda grid, g, cover: F.struct(F.lit(grid).alias("grid"), *[F.lit(v).alias(n) for n, v in zip(("sx", "sy"), g.size, strict=True)], *[F.lit(v if cover else 0.0).alias(n) for n, v in zip(("rx", "ry"), g.reach, strict=True)], F.lit(cover).alias("cover"))
    places = [F.when(level == g.level, spot(k, g, True)) for k, g in covers]
    places += [F.when(level < g.level if strict else level <= g.level, spot(k, g, False)) for k, g, strict in corners]
    placed = df.withColumn("p", F.explode(F.array_compact(F.array(*places)))).select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns], "p.*")
    x0, y0, x1, y1 = Box(prefix).grown(d)
    at = lambda v, c: F.floor(v / F.col(f"s{c}")).cast("long")
    cells = lambda lo, hi, c: F.explode(F.sequence(at(lo - F.col(f"r{c}"), c), at(F.when(F.col("cover"), hi).otherwise(lo), c)))
    return placed.withColumn("cx", cells(x0, x1, "x")).withColumn("cy", cells(y0, y1, "y")).drop("sx", "sy", "rx", "ry", "cover")


def partitions(df: DataFrame, rows: float, work: float) -> int:
    """Enough for so many rows, 100,000 each, and so much work, 8,000,000 each; small tables go to few."""
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return max(1, min(8000, math.ceil(max(rows / 100_000, work / 8_000_000, min(2 * cores, rows / 4_000)))))


def spatial_join(a: DataFrame, b: DataFrame, predicate: Callable[[Box, Box], Column], d: float = 0.0, cell: float | None = None, on: Sequence[str] = ()) -> DataFrame:
    """All pairs whose boxes, the first grown by d, meet and fulfil the predicate; columns as a_... and b_....

    Both sides need x0, y0, x1, y1. Rows with a null among these meet nothing; repeated rows make repeated pairs. Columns
    named by `on` must be equal and are part of the join's key. A given `cell` makes a single grid of it.
    """
    a, b = a.dropna(subset=list(BOX)), b.dropna(subset=list(BOX))
    one, two = Box("a_"), Box("b_")
    x0, y0, x1, y1 = one.grown(d)
    e = extents(a, b, d)
    own_a, own_b = _level(_width(a, d), e.finest), _level(_width(b, 0), e.finest)
    if cell is not None:  # one level
        own_a = own_b = F.lit(0)
        e.a, e.b = ({0: sum(side.values(), Extent())} if side else {} for side in (e.a, e.b))
    first = _grids(e.a, e.b, e, False, cell)
    second = _grids(e.b, e.a, e, True, cell)
    if not first and not second:
        a, b, first = a.filter(F.lit(False)), b.filter(F.lit(False)), [Grid(0, (1.0, 1.0), (0.0, 0.0), 0, 0)]
    n = partitions(a, sum(g.copies for g in (*first, *second)), sum(g.candidates for g in (*first, *second)))
    first, second = list(enumerate(first)), list(enumerate(second, len(first)))
    if n > 50 and not on:  # a table may be a single file, and copies are made where it is read
        a, b = (df.repartition(max(1, n // 10), *BOX) for df in (a, b))
    keys = ["grid", "cx", "cy"]
    left = _celled(a, "a_", d, own_a, first, [(k, g, True) for k, g in second])
    right = _celled(b, "b_", 0.0, own_b, second, [(k, g, False) for k, g in first])
    for c in on:
        keys.append(f"on_{c}")
        left, right = left.withColumn(f"on_{c}", F.col(f"a_{c}")), right.withColumn(f"on_{c}", F.col(f"b_{c}"))
    meet = (x0 <= two.x1) & (two.x0 <= x1) & (y0 <= two.y1) & (two.y0 <= y1)
    left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    return left.join(right.hint("merge"), keys).filter(meet & predicate(one, two)).drop(*keys)


def self_join(a: DataFrame, predicate: Callable[[Box, Box], Column], unique: bool = True, d: float = 0.0) -> DataFrame:
    pairs = spatial_join(a, a, predicate, d)
    return pairs.filter(F.col("a_id") < F.col("b_id") if unique else F.col("a_id") != F.col("b_id"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    a, b = Box("a_"), Box("b_")
    return pairs.withColumns({"area1": a.area(), "area2": b.area(), "inter_area": boxes.intersection_area(a, b), "union_area": boxes.union_area(a, b), "jaccard": boxes.jaccard(a, b), "dice": boxes.dice(a, b), "min_distance": boxes.distance(a, b)})


def _nearest_within(a: DataFrame, b: DataFrame, k: int, radius: float, exclude_self: bool) -> DataFrame:
    """The k nearest of b for each of a, closer than the radius: the k of each row are found tile by tile, so that only these
    are ranked and not all pairs."""
    from .tiles import distances, in_tiles, near, numbers

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("id", "ascending")], null_placement="at_start"))
        one, two = numbers(left), numbers(right)
        own, other, away = [], [], []
        if exclude_self:
            names = pc.unique(right["id"])
            mine, theirs = (pc.index_in(x["id"], value_set=names).fill_null(-1).to_numpy() for x in (left, right))
        for at, among in near(one, two, radius) if len(left) and len(right) else ():
            d = distances(one[at], two[among])
            d[d >= radius] = np.inf
            if exclude_self:
                d[mine[at][:, None] == theirs[among][None]] = np.inf
            if k <= 16:
                line = np.arange(len(at))
                for _ in range(min(k, len(among))):  # the first of equal ones has the least id
                    best = d.argmin(axis=1)
                    found = np.flatnonzero(d[line, best] < np.inf)
                    own.append(at[found])
                    other.append(among[best[found]])
                    away.append(d[found, best[found]])
                    d[line, best] = np.inf
            else:
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                row, place = np.nonzero(np.take_along_axis(d, best, axis=1) < np.inf)
                own.append(at[row])
                other.append(among[best[row, place]])
                away.append(d[row, best[row, place]])
        whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        return pa.table({"a_id": left["id"].take(pa.array(whole(own, np.int64))), "b_id": right["id"].take(pa.array(whole(other, np.int64))), "distance": whole(away, np.float64)})

    kind = {side: df.schema["id"].dataType.simpleString() for side, df in (("a", a), ("b", b))}
    found = in_tiles(a.select("id", *BOX), b.select("id", *BOX), radius, run, f"a_id {kind['a']}, b_id {kind['b']}, distance double")
    order = Window.partitionBy("a_id").orderBy("distance", "b_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nearest_in_rounds(a: DataFrame, b: DataFrame, k: int, want: int, radius: float, last: float, exclude_self: bool) -> DataFrame:
    """The k nearest closer than `last`. The radius doubles for those of a that haven't as many as wanted inside it, so each
    round has fewer rows; what is found inside the radius is exact. The neighbours found and the rows still open are written
    after each round, so no round is computed twice."""
    todo, found = a, None
    while True:
        radius = min(radius, last)
        near = _nearest_within(todo, b, k, radius, exclude_self)
        full = near if radius >= last else near.withColumn("n", F.count("*").over(Window.partitionBy("a_id"))).filter(F.col("n") >= want).drop("n")
        full = durable(full)
        found = full if found is None else found.unionByName(full)
        if radius >= last:
            return found
        done = full.select(F.col("a_id").alias("done")).distinct()
        todo = durable(todo.join(done, F.col("id").eqNullSafe(F.col("done")), "left_anti"))
        if todo.isEmpty():
            return found
        radius *= 2


def _reach(space: Row, k: int) -> float:
    """The side of a square that holds k objects on average."""
    span = max(float(space[2] - space[0]), float(space[3] - space[1]))
    return span * (k / space[4]) ** 0.5


def nearest(a: DataFrame, b: DataFrame, k: int, bound: float) -> DataFrame:
    """The k nearest of b for each of a, closer than `bound`; ties by b's id. Columns a_id, b_id, distance, rank."""
    if k < 1 or bound <= 0:
        raise ValueError("k and the bound must be positive")
    a, b = a.select("id", *BOX).dropna(subset=list(BOX)), b.select("id", *BOX).dropna(subset=list(BOX))
    space = b.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*")).first()
    if not space[4]:
        return _nearest_within(a, b, k, bound, False)
    return _nearest_in_rounds(a, b, k, k, _reach(space, k) or bound, bound, False)


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs whose boxes don't meet, whatever their distance; columns as a_... and b_.... There are about as many as rows of
    a times rows of b, so this is a nested loop by nature; `disjoint_counts` needs none."""
    named = lambda df, prefix: df.dropna(subset=list(BOX)).select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])
    return named(a, "a_").crossJoin(named(b, "b_")).filter(~boxes.intersects(Box("a_"), Box("b_")))


def disjoint_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, disjoint: for each box of a, how many of b it doesn't meet. All of b but those that the tiled join finds."""
    a, b = a.dropna(subset=list(BOX)), b.dropna(subset=list(BOX))
    met = spatial_join(a.select("id", *BOX).distinct(), b, boxes.intersects).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("met"))
    whole = b.agg(F.count("*").alias("n"))
    return a.select("id").join(met, "id", "left").crossJoin(F.broadcast(whole)).select("id", (F.col("n") - F.coalesce("met", F.lit(0))).alias("disjoint"))  # one row


def nearest_unbounded(a: DataFrame, b: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The k nearest of b for each of a, however far. The first radius is the side of a square that holds k objects."""
    a, b = a.select("id", *BOX).dropna(subset=list(BOX)), b.select("id", *BOX).dropna(subset=list(BOX))
    if exclude_self:  # an id that is null is neither the same nor another one
        a, b = a.filter("id is not null"), b.filter("id is not null")
    space = b.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*")).first()
    n = space[4]
    other = a.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if not n or other[0] is None:
        return _nearest_within(a, b, k, 1.0, exclude_self)
    span = max(max(float(space[2]), float(other[2])) - min(float(space[0]), float(other[0])), max(float(space[3]), float(other[3])) - min(float(space[1]), float(other[1])), 1.0)
    want = min(k, n - 1 if exclude_self else n)
    return _nearest_in_rounds(a, b, k, want, min(_reach(space, k) or span, span), 1.5 * span, exclude_self)


def earth_within(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs of points (id, lat, lon) within a great-circle distance.

    Bands of latitude are cut into cells of longitude that are wide enough for the distance at the band's pole-ward edge,
    or not at all near the poles; a point of a looks into its own cell and those around it, across the date line too.
    """
    band = max(metres / 111_000.0 * 1.01, 1e-6)
    edge = lambda k: F.least(F.greatest(F.abs(k * F.lit(band)), F.abs((k + 1) * F.lit(band))) + F.lit(band), F.lit(90.0))
    ratio = lambda k: F.lit(math.sin(math.radians(min(band, 90.0)))) / F.greatest(F.cos(F.radians(edge(k))), F.lit(1e-9))
    cells = lambda k: F.when(ratio(k) < 0.9, F.greatest(F.lit(1), F.floor(F.lit(356.0) / F.degrees(F.asin(F.least(ratio(k), F.lit(1.0))))))).otherwise(F.lit(1)).cast("long")
    cell = lambda lon, n: F.floor((lon + 180.0) / 360.0 * n).cast("long")
    one = a.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.explode(F.sequence(F.floor((F.col("lat") - band) / band), F.floor((F.col("lat") + band) / band))).alias("band"))
    n = cells(F.col("band"))
    around = F.array_distinct(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda step: F.pmod(cell(F.col("a_lon"), n) + step, n)))
    one = one.withColumn("cell", F.explode(around))
    two = b.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.floor(F.col("lat") / band).alias("band"))
    two = two.withColumn("cell", F.pmod(cell(F.col("b_lon"), cells(F.col("band"))), cells(F.col("band"))))
    d = boxes.great_circle(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return one.join(two, ["band", "cell"]).withColumn("metres", d).filter(F.col("metres") <= metres).select("a_id", "b_id", "metres")
