"""Two tables of boxes, met tile by tile in numpy: for work on near pairs that a join would have to write out first.

A box of the first table goes to the tile of its lower-left corner, one of the second to all tiles that hold boxes which it may
be near to. Tiles come in levels, so that they are wider than the first table's boxes. Tiles of many boxes are cut into parts,
each part of one side with each of the other, so the memory of a task is bounded whatever the boxes' places.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial_join import BOX, Extent, _level, _width, extents

KEYS = ["level", "tx", "ty"]


def in_tiles(a: DataFrame, b: DataFrame, reach: float, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most: tuple[int, int] = (16_384, 65_536)) -> DataFrame:
    """The rows of `run(part of a, part of b)`, called so that each row of a meets each row of b within reach of it in one call.

    Both have x0, y0, x1, y1 without nulls, and are read several times. About `most` rows of either side are in a call.
    """
    met = _placed(a, b, reach, most, False)
    if met is None:
        return a.sparkSession.createDataFrame([], schema)
    one, two, keys = met
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(run, schema)


def streamed_in_tiles(a: DataFrame, b: DataFrame, reach: float, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, most: tuple[int, int] = (16_384, 32_768)) -> DataFrame:
    """As `in_tiles`, for two tables of the same columns and a `run` that gives batch after batch: a task holds its parts of
    both tables, but not the pairs that it finds, of which a few parts can make a great many."""

    def met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        yield from run(*(both.filter(pc.equal(both["side"], k)) for k in (0, 1)))

    met = _placed(a, b, reach, most, True)
    if met is None:
        return a.sparkSession.createDataFrame([], schema)
    one, two, keys = met
    return one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1))).groupBy(*keys).applyInArrow(met_rows, schema)


def _placed(a: DataFrame, b: DataFrame, reach: float, most: tuple[int, int], busy: bool) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """Both tables in tiles and parts, and the columns that name these; nothing if no tile has rows of both. A call for `busy`
    ones has so much to do that each gets a task, and few rows are cut into enough tiles for all cores."""
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both may be one table
    e = extents(a, b, 0.0)
    spark = a.sparkSession
    if not e.a or not e.b:
        return None
    n, m = (sum(x.n for x in side.values()) for side in (e.a, e.b))
    area = max(e.span[0], 1e-9) * max(e.span[1], 1e-9)
    least = max(max(e.span) / 4096, 4 * reach, 1e-9)
    usual = max(least, min(math.sqrt(area * most[0] / 4 / n), math.sqrt(area * most[1] / 4 / m)))
    cores = max(1, spark.sparkContext.defaultParallelism)
    if busy:
        usual = max(least, min(usual, math.sqrt(area / (4 * cores))))
    least_level = max(e.finest, math.floor(math.log(usual, 4.0)))  # finer ones have tiles of the same size
    sides: dict[int, Extent] = {}
    for own, x in e.a.items():
        sides[max(own, least_level)] = sides.get(max(own, least_level), Extent()) + x
    sizes = {level: max(usual, 4.0**level) for level in sides}
    level = _level(_width(a, 0.0), least_level)
    size = lambda of: F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[of]
    at = lambda v, s: F.floor(v / s).cast("long")
    one = a.withColumn("level", level).withColumns({f"t{c}": at(F.col(f"{c}0").cast("double"), size(F.col("level"))) for c in "xy"})
    # padded, as sums of floating numbers are rounded
    padded = lambda v: v + 1e-9 * (v + e.far)
    spots = [F.struct(F.lit(k).alias("level"), F.lit(v).alias("size"), *[F.lit(padded(reach + w)).alias(f"r{c}") for c, w in zip("xy", sides[k].most, strict=True)]) for k, v in sizes.items()]
    two = b.withColumn("p", F.explode(F.array(*spots))).select(*b.columns, "p.*")
    for c in "xy":
        two = two.withColumn(f"t{c}", F.explode(F.sequence(at(F.col(f"{c}0") - F.col(f"r{c}"), F.col("size")), at(F.col(f"{c}1") + F.lit(padded(reach)), F.col("size")))))
    two = two.drop("size", "rx", "ry")
    have = one.groupBy(KEYS).agg(F.count("*").alias("na"))
    tiles = two.select(KEYS).groupBy(KEYS).agg(F.count("*").alias("nb")).join(F.broadcast(have), KEYS)
    parts = lambda c, limit: F.ceil(F.col(c) / F.lit(float(limit))).cast("long")
    tiles = tiles.select(*KEYS, parts("na", most[0]).alias("pa"), parts("nb", most[1]).alias("pb"))
    found = tiles.agg(F.count("*"), F.sum(F.col("pa") * F.col("pb"))).first()
    if not found[0]:
        return None
    tiles = F.broadcast(tiles)  # one row a tile; there are at most as many as cells of the grid that hold rows of a
    part = lambda df, n: F.pmod(F.xxhash64(*[c for c, t in df.dtypes if c in ("id", *BOX)]), F.col(n))
    one = one.join(tiles, KEYS).withColumn("p", part(a, "pa")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)))
    two = two.join(tiles, KEYS).withColumn("q", part(b, "pb")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1)))
    keys = [*KEYS, "p", "q"]
    shared = max(1, min(8000, int(found[1]), int(found[1]) if busy else max(2 * cores, math.ceil(found[1] / 2))))
    return *(df.drop("pa", "pb").repartition(shared, *keys) for df in (one, two)), keys


def numbers(table: pa.Table) -> np.ndarray:
    """n x 4: the boxes of a table."""
    return np.stack([table[c].to_numpy().astype(np.float64) for c in BOX], axis=1) if len(table) else np.empty((0, 4))


def near(a: np.ndarray, b: np.ndarray, reach: float, size: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of up to `size` boxes of a that lie side by side, and of all of b within reach of the box around these."""
    strips = max(1, round(math.sqrt(len(a) / size)))
    low, high = a[:, 1].min(), a[:, 1].max()
    strip = np.floor((a[:, 1] - low) / max(high - low, 1e-300) * strips)
    order = np.lexsort((a[:, 0], strip))
    slack = reach * (1 + 1e-9) + 1e-9 * max(np.abs(a).max(), np.abs(b).max()) if len(b) else reach
    for k in range(0, len(a), size):
        own = order[k : k + size]
        x0, y0 = a[own, :2].min(axis=0) - slack
        x1, y1 = a[own, 2:].max(axis=0) + slack
        yield own, np.flatnonzero((b[:, 0] <= x1) & (b[:, 2] >= x0) & (b[:, 1] <= y1) & (b[:, 3] >= y0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each box of a to each of b."""
    dx, dy = (np.maximum(np.maximum(a[:, None, k] - b[None, :, k + 2], b[None, :, k] - a[:, None, k + 2]), 0.0) for k in (0, 1))
    return np.sqrt(dx * dx + dy * dy)
