"""Spatial partitioners: each gives a small table of tiles for a table of boxes (id, x0, y0, x1, y1)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import intersects
from ..functions.shapes import hilbert
from .durable import durable
from .spatial_join import spatial_join

SAMPLE = 100_000


def space(df: DataFrame) -> DataFrame:
    return df.agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"), F.count("*").alias("objects"))


def merge_spaces(partials: DataFrame) -> DataFrame:
    return partials.agg(*[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"), (F.sum, "objects"))])


def partition_size(block_bytes: int, ratio: float, total_bytes: int, count: int) -> int:
    return math.floor(block_bytes * ratio / total_bytes * count)


def normalize(df: DataFrame, whole: DataFrame) -> DataFrame:
    s = df.crossJoin(F.broadcast(whole))  # one row
    x, y = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return s.select("id", *[((F.col(c) - F.col(f"min_{c[0]}")) / (x if c[0] == "x" else y)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def denormalize(df: DataFrame, whole: DataFrame) -> DataFrame:
    s = df.crossJoin(F.broadcast(whole))
    x, y = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return s.select("id", *[(F.col(c) * (x if c[0] == "x" else y) + F.col(f"min_{c[0]}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def denormalize_nested(tiles: DataFrame, first: DataFrame) -> DataFrame:
    """Tiles of a second layer (tile_id, box), given in the unit square of the first-layer tile that their id begins with (up
    to the bar), at their place in that tile (first: tile_id, box). Tiles whose first layer is missing are left out."""
    outer = first.select(F.col("tile_id").alias("outer"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    joined = tiles.withColumn("outer", F.split("tile_id", r"\|")[0]).join(outer, "outer")
    return joined.select("tile_id", *[(F.col(c) * (F.col(f"o_{c[0]}1") - F.col(f"o_{c[0]}0")) + F.col(f"o_{c[0]}0")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def sampled(df: DataFrame, rate: float, seed: int, key: str = "id") -> DataFrame:
    """Each row with probability `rate`, by a hash of its key, so reruns agree."""
    if not 0 <= rate <= 1:
        raise ValueError("the rate must be from 0 to 1")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.filter(draw < F.lit(round(rate * (1 << 32))))


def centre_order(df: DataFrame, axis: str = "x") -> DataFrame:
    """id, place: the boxes in the order of their centres along an axis, equal ones by id, from 1.

    Centres are cut into as many equal ranges as there are 10,000 boxes; a range's first place follows from the counts
    of those before it, so no task sorts the whole table unless the centres are the same.
    """
    whole = df.agg(F.min(F.col(f"{axis}0") + F.col(f"{axis}1")), F.max(F.col(f"{axis}0") + F.col(f"{axis}1")), F.count("*")).first()
    cuts = max(1, whole[2] // 10_000)
    width = max(float((whole[1] or 0) - (whole[0] or 0)), 1e-9) / cuts
    centre = F.col(f"{axis}0") + F.col(f"{axis}1")
    own = df.select("id", centre.alias("centre"), F.floor((centre - F.lit(float(whole[0] or 0))) / F.lit(width)).alias("range"))
    counts = own.groupBy("range").count()
    before = counts.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("centre", "id"))
    return own.join(before, "range").select("id", (F.col("start") + rank).cast("long").alias("place"))


def fixed_grid(df: DataFrame, per_tile: int) -> DataFrame:
    """tile_id, x0, y0, x1, y1 in the unit square, by column; cells are about square in the objects' own space."""
    w = space(df).withColumn("r", (F.col("max_x") - F.col("min_x")) / (F.col("max_y") - F.col("min_y")))
    cells = F.col("objects") / F.lit(per_tile)
    w = w.select(F.greatest(F.ceil(F.sqrt(cells * F.col("r"))), F.lit(1)).alias("nx"), F.greatest(F.ceil(F.sqrt(cells / F.col("r"))), F.lit(1)).alias("ny"))
    t = w.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    return t.select(F.concat(F.lit("FG|"), F.col("i") * F.col("ny") + F.col("j") + 1).alias("tile_id"), (F.col("i") / F.col("nx")).alias("x0"), (F.col("j") / F.col("ny")).alias("y0"), ((F.col("i") + 1) / F.col("nx")).alias("x1"), ((F.col("j") + 1) / F.col("ny")).alias("y1"))


def hilbert_tiles(df: DataFrame, per_tile: int, bits: int = 20) -> DataFrame:
    """Boxes around runs of `per_tile` objects along the Hilbert curve of their centres. Tiles may overlap.

    Range partitions along the curve are numbered from the counts before them, so no task sorts the whole table.
    """
    scale = float((1 << bits) - 1)
    w = df.crossJoin(F.broadcast(space(df)))  # one row
    at = lambda c: F.round(((F.col(f"{c}0") - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}")) + (F.col(f"{c}1") - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}"))) / 2 * scale)
    placed = w.select("id", "x0", "y0", "x1", "y1", hilbert(at("x"), at("y"), bits).alias("h")).withColumn("range", F.shiftright("h", max(0, 2 * bits - 10)))
    counts = placed.groupBy("range").count()
    before = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("h", "id")) - 1
    tile = placed.join(F.broadcast(before), "range").withColumn("tile", F.floor(rank / per_tile))  # 1024 rows at most
    tiles = tile.groupBy("tile").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("objects"))
    return durable(tiles.withColumn("tile_id", F.concat(F.lit("HC|"), F.col("tile") + 1)).drop("tile"))  # joins read them more than once


def _sampled(df: DataFrame) -> tuple[list, float, tuple | None]:
    """At most about SAMPLE boxes on the driver, the share that they are of all, and the box around all."""
    *whole, n = space(df).first()
    share = min(1.0, SAMPLE / max(1, n))
    rows = (df if share == 1 else df.sample(share, seed=7)).select("id", "x0", "y0", "x1", "y1").collect()
    return [tuple(float(v) for v in r[1:]) for r in sorted(rows)], share, None if whole[0] is None else tuple(map(float, whole))


def _tiles(df: DataFrame, found: list[tuple], prefix: str) -> DataFrame:
    rows = [(f"{prefix}|{k}", *map(float, t)) for k, t in enumerate(found, 1)]
    return df.sparkSession.createDataFrame(rows, "tile_id string, x0 double, y0 double, x1 double, y1 double")


def binary_tiles(df: DataFrame, per_tile: int) -> DataFrame:
    """Cut the space at the median centre of the axis along which centres vary more, until tiles hold `per_tile`.

    The tiles cover all boxes. Of more than SAMPLE boxes, the cuts come from a sample, so counts are approximate there.
    """
    rows, share, whole = _sampled(df)
    most = max(1, per_tile * share)
    out: list[tuple] = []
    todo = [(whole, np.array(rows, float).reshape(-1, 4))] if whole else []
    while todo:
        box, own = todo.pop()
        centres = (own[:, :2] + own[:, 2:]) / 2
        spread = ((centres - centres.mean(axis=0)) ** 2).sum(axis=0) if len(own) else (0, 0)
        axis = 0 if spread[0] > spread[1] else 1
        cut = float(np.partition(centres[:, axis], len(own) // 2)[len(own) // 2]) if len(own) else 0.0
        low, high = own[own[:, axis] <= cut], own[own[:, axis + 2] >= cut]
        if len(own) <= most or len(low) == len(own) or len(high) == len(own) or not box[axis] < cut < box[axis + 2]:
            out.append(box)
            continue
        a, b = list(box), list(box)
        a[axis + 2] = b[axis] = cut
        todo += [(tuple(b), high), (tuple(a), low)]
    return _tiles(df, out, "BSP")


def strip_tiles(df: DataFrame, per_tile: int) -> DataFrame:
    """Cut off `per_tile` objects again and again, by the vertical or horizontal line that crosses fewer boxes.

    The tiles cover all boxes. Of more than SAMPLE boxes, the cuts come from a sample, so counts are approximate there.
    """
    rows, share, whole = _sampled(df)
    most = max(1, int(per_tile * share))
    out: list[tuple] = []
    box = list(whole or ())
    while len(rows) > most:
        choices = []
        for axis in (1, 0):
            order = sorted(rows, key=lambda r: r[axis] + r[axis + 2])
            line = (order[most - 1][axis] + order[most - 1][axis + 2]) / 2
            choices.append((sum(r[axis] < line < r[axis + 2] for r in rows), axis, line, order))
        _, axis, line, order = min(choices, key=lambda c: c[0])  # x only if strictly cheaper
        if not box[axis] < line < box[axis + 2]:
            break
        tile = list(box)
        tile[axis + 2] = box[axis] = line
        out.append(tuple(tile))
        rows = order[most:]
    return _tiles(df, [*out, tuple(box)] if box else [], "BOS")


def to_tiles(df: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each object with every tile that it meets: the tiled join, so neither a nested loop nor a broadcast of the tiles."""
    pairs = spatial_join(df, tiles.select("tile_id", "x0", "y0", "x1", "y1"), intersects)
    return pairs.select(*[F.col(f"a_{c}").alias(c) for c in df.columns], F.col("b_tile_id").alias("tile_id"))
