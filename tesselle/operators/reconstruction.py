"""Morphological reconstruction by dilation over tiles: each tile on its own, then only outlines that changed travel on."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
#: Rounds after which the tiles that changed are written together with those that didn't.
MERGE = 8


def grow(value: list[int], mask: list[int], width: int, seeds: list[tuple[int, int]]) -> bool:
    """Spreads levels in place over a grid in row order, whose outermost cells have a mask of 0. seeds: (-level, cell),
    the levels that come to cells from around them. Highest levels first, so each cell is settled the first time."""
    steps = [dy * width + dx for dy, dx in AROUND]
    changed = False
    heapq.heapify(seeds)
    while seeds:
        level, at = heapq.heappop(seeds)
        for step in steps:
            near = at + step
            new = min(-level, mask[near])
            if new > value[near]:
                value[near] = new
                changed = True
                heapq.heappush(seeds, (-new, near))
    return changed


def reconstruct(pixels: DataFrame, tile: int, rounds: int = 10_000) -> DataFrame:
    """y, x, value: the marker grown under the mask from (y, x, marker, mask), one row a pixel, with 8 neighbours.

    A pixel's value is the highest level at which a path under the mask leads to it from a marker as high. Missing
    pixels have a mask of 0 and block all paths, nulls count as 0, and a marker above its mask is cut to it. Tiles are
    held as arrays; in each round those that changed send their outlines to the tiles around, and only tiles that get
    one are worked off, from what came in. The number of rounds is at most that of tiles along a path.
    """
    wide = tile + 2

    def settled(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(frame["ty"].iat[0]), int(frame["tx"].iat[0])
        y, x = frame["y"].to_numpy() - ty * tile, frame["x"].to_numpy() - tx * tile
        mask, value, there = np.zeros((wide, wide), np.int64), np.zeros((wide, wide), np.int64), np.zeros((tile, tile), bool)
        mask[y + 1, x + 1], value[y + 1, x + 1], there[y, x] = frame["mask"], frame["value"], True
        levels = value.reshape(-1).tolist()
        grow(levels, mask.reshape(-1).tolist(), wide, [(-v, at) for at, v in enumerate(levels) if v > 0])
        return pd.DataFrame({"ty": [ty], "tx": [tx], "mask": [mask.tobytes()], "there": [there.tobytes()], "value": [np.array(levels, np.int64).tobytes()]})

    def rims(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the tiles around need of each: for each neighbour the cells of its padding, and their levels."""
        for frame in frames:
            out = []
            for ty, tx, raw in zip(frame["ty"], frame["tx"], frame["value"], strict=True):
                value = np.frombuffer(raw, np.int64).reshape(wide, wide)
                for dy, dx in AROUND:
                    rows = {-1: slice(1, 2), 0: slice(1, tile + 1), 1: slice(tile, tile + 1)}[dy]
                    columns = {-1: slice(1, 2), 0: slice(1, tile + 1), 1: slice(tile, tile + 1)}[dx]
                    part = value[rows, columns].reshape(-1)
                    if part.any():
                        out.append((ty + dy, tx + dx, -dy, -dx, part.tobytes()))
            yield pd.DataFrame(out, columns=["ty", "tx", "dy", "dx", "levels"])

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ty, tx, raw_mask, raw, found in zip(frame["ty"], frame["tx"], frame["mask"], frame["value"], frame["found"], strict=True):
                value, seeds = np.frombuffer(raw, np.int64).tolist(), []
                for x in found:
                    rows = {-1: [0], 0: range(1, tile + 1), 1: [tile + 1]}[x["dy"]]
                    columns = {-1: [0], 0: range(1, tile + 1), 1: [tile + 1]}[x["dx"]]
                    cells = [r * wide + c for r in rows for c in columns]
                    seeds += [(-v, at) for v, at in zip(np.frombuffer(x["levels"], np.int64).tolist(), cells, strict=True) if v > 0]
                # seeds lie in the padding, so what they reach is all inside; padding has a mask of 0
                if grow_in(value, raw_mask, seeds):
                    out.append((ty, tx, np.array(value, np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["ty", "tx", "value"])

    def grow_in(value: list[int], raw_mask: bytes, seeds: list[tuple[int, int]]) -> bool:
        """Seeds in the padding have neighbours outside the grid; so the grid is padded once more."""
        outer = wide + 2
        mask = np.pad(np.frombuffer(raw_mask, np.int64).reshape(wide, wide), 1).reshape(-1).tolist()
        grid = np.pad(np.array(value, np.int64).reshape(wide, wide), 1).reshape(-1).tolist()
        moved = [(level, (at // wide + 1) * outer + at % wide + 1) for level, at in seeds]
        changed = grow(grid, mask, outer, moved)
        value[:] = np.array(grid, np.int64).reshape(outer, outer)[1:-1, 1:-1].reshape(-1).tolist()
        return changed

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ty, tx, raw, raw_there in zip(frame["ty"], frame["tx"], frame["value"], frame["there"], strict=True):
                y, x = np.nonzero(np.frombuffer(raw_there, bool).reshape(tile, tile))
                yield pd.DataFrame({"y": y + ty * tile, "x": x + tx * tile, "value": np.frombuffer(raw, np.int64).reshape(wide, wide)[y + 1, x + 1]})

    level = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    own = pixels.filter("y is not null and x is not null").select(F.col("y").cast("int"), F.col("x").cast("int"), F.least(level("marker"), level("mask")).alias("value"), level("mask").alias("mask"))
    own = own.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    tiles = durable(own.groupBy("ty", "tx").applyInPandas(settled, "ty int, tx int, mask binary, there binary, value binary"))
    values = changed = tiles.select("ty", "tx", "value")
    tiles = tiles.drop("value")
    sent = "ty int, tx int, dy int, dx int, levels binary"
    for k in range(1, rounds + 1):
        came = changed.mapInPandas(rims, sent).groupBy("ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "levels")).alias("found"))
        active = tiles.drop("there").join(values, ["ty", "tx"]).join(came, ["ty", "tx"])
        changed = durable(active.mapInPandas(entered, "ty int, tx int, value binary"))
        if changed.isEmpty():
            return tiles.drop("mask").join(values, ["ty", "tx"]).mapInPandas(cells, "y int, x int, value long")
        values = values.join(changed.select("ty", "tx"), ["ty", "tx"], "left_anti").unionByName(changed)
        if k % MERGE == 0:
            values = durable(values)
    raise ValueError("the reconstruction takes more rounds than allowed")
