"""Labelled masks as pixels (tile, y, x, label), label 0 being background, and metrics between two masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import intersects
from ..functions.shapes import clip, convex_hull, envelope, polygon_area
from .durable import durable
from .graph import label_components
from .spatial_join import spatial_join

#: Side of the square blocks in which an image's pixels are worked off.
BLOCK = 512
#: A pixel's name in its image: its row times this, and its column.
STRIDE = 1 << 31


def pixel_compare(mask: DataFrame, other: DataFrame) -> DataFrame:
    """Per tile the number of pixels that differ, and the foreground pixels of the other mask."""
    a, b = mask.select("tile", "y", "x", F.col("label").alias("p")), other.select("tile", "y", "x", F.col("label").alias("q"))
    both = a.join(b, ["tile", "y", "x"], "full").select("tile", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    return both.groupBy("tile").agg(F.count_if(F.col("p") != F.col("q")).alias("diff_pixels"), F.count_if(F.col("q") != 0).alias("foreground"))


def label_boxes(mask: DataFrame) -> DataFrame:
    return mask.filter("label <> 0").groupBy("tile", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("pixels"))


def largest_box(mask: DataFrame) -> DataFrame:
    """Largest height and width of any label's box, with a border of one pixel on each side."""
    return label_boxes(mask).agg(F.max(F.col("y1") - F.col("y0") + 3).alias("rows"), F.max(F.col("x1") - F.col("x0") + 3).alias("cols"))


def object_features(mask: DataFrame, image: DataFrame) -> DataFrame:
    """Per label: pixels, mean, least, most and spread of the intensity, and the mean step to the right neighbour."""
    right = image.select("tile", "y", (F.col("x") - 1).alias("x"), F.col("value").alias("next"))
    px = mask.filter("label <> 0").join(image, ["tile", "y", "x"]).join(right, ["tile", "y", "x"], "left")
    step = F.abs(F.col("next") - F.col("value"))
    return px.groupBy("tile", "label").agg(F.count("*").alias("pixels"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.var_pop("value"), 6).alias("var_value"), F.round(F.coalesce(F.avg(step), F.lit(0.0)), 6).alias("mean_step"))


def row_runs(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true cells, in row order."""
    edge = np.diff(np.pad(grid, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def block_components(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a grid, and for each run the first run of its component. Cells touch by side or corner."""
    row, first, last = row_runs(grid)
    above = list(range(len(row)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    starts = np.searchsorted(row, np.arange(grid.shape[0] + 1)).tolist()
    lo, hi = first.tolist(), last.tolist()
    for y in range(1, grid.shape[0]):
        k, end = starts[y - 1], starts[y]
        for run in range(starts[y], starts[y + 1]):
            while k < end and hi[k] < lo[run] - 1:
                k += 1
            other = k
            while other < end and lo[other] <= hi[run] + 1:
                p, q = sorted((top(run), top(other)))
                above[q] = p
                other += 1
    return row, first, last, np.array([top(k) for k in range(len(row))], np.int64)


def connected(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """tile, y, x, label: components of foreground pixels that touch by side or corner, within each image (tile).

    A label is the component's first pixel in row order: y * 2^31 + x + 1. Images of any size are cut into blocks that are
    labelled alone; labels on either side of a border between blocks are linked, and components of these links, which
    are never gathered in one place, give the final labels. Repeated pixels count once, nulls are no pixels.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tile, top, left = frame["tile"].iat[0], int(frame["by"].iat[0]) * block, int(frame["bx"].iat[0]) * block
        grid = np.zeros((block, block), bool)
        grid[frame["y"].to_numpy() - top, frame["x"].to_numpy() - left] = True
        row, first, last, root = block_components(grid)
        name = (row + top) * STRIDE + first + left + 1
        size = last - first + 1
        x = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return pd.DataFrame({"tile": tile, "y": np.repeat(row, size) + top, "x": x + left, "label": np.repeat(name[root], size)})

    own = pixels.filter("label <> 0 and tile is not null and y is not null and x is not null").select(F.col("tile").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"))
    placed = own.withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)})
    found = durable(placed.groupBy("tile", "by", "bx").applyInPandas(run, "tile int, y int, x int, label long"))
    rim = found.filter(F.pmod("y", F.lit(block)).isin(0, block - 1) | F.pmod("x", F.lit(block)).isin(0, block - 1))
    step = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    near = rim.withColumn("s", F.explode(F.array(*step))).select("tile", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("label").alias("other"))
    links = rim.join(near, ["tile", "y", "x"]).filter("label <> other").select("tile", "label", "other").distinct()
    # names are of one image: those of links of several images are told apart by a number for each (tile, label)
    name = lambda c: F.xxhash64("tile", c)
    nodes = durable(links.select("tile", "label").union(links.select("tile", F.col("other"))).distinct().withColumn("node", name("label")))
    parts = label_components(links.select(name("label").alias("u"), name("other").alias("v")))
    named = nodes.join(parts, "node")
    least = named.groupBy("tile", "component").agg(F.min("label").alias("whole"))
    whole = named.join(least, ["tile", "component"]).select("tile", "label", "whole")
    return found.join(whole, ["tile", "label"], "left").select("tile", "y", "x", F.coalesce("whole", "label").alias("label"))


def hulls(mask: DataFrame) -> DataFrame:
    """Convex hull of each label's pixel centres as ring, and its area; hulls of fewer than 3 points are dropped.

    Only a row's first and last pixel can be on the hull, so each label sends two points a row to its task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tile, label, ends in zip(frame["tile"], frame["label"], frame["ends"], strict=True):
                flat = ends.tolist()
                hull = convex_hull([(float(x), float(y)) for y, x in zip(flat[::2], flat[1::2], strict=True)])
                if len(hull) > 2:
                    out.append((tile, label, [{"x": x, "y": y} for x, y in hull], polygon_area(hull)))
            yield pd.DataFrame(out, columns=["tile", "label", "ring", "area"])

    rows = mask.filter("label <> 0").groupBy("tile", "label", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = rows.groupBy("tile", "label").agg(F.flatten(F.collect_list(F.array("y", "lo", "y", "hi"))).alias("ends"))
    return ends.select(F.col("tile").cast("int"), F.col("label").cast("long"), F.col("ends").cast("array<long>")).mapInPandas(run, "tile int, label long, ring array<struct<x:double,y:double>>, area double")


def hull_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """tile, label_a, label_b, area_a, area_b, inter for hulls of the same tile whose interiors meet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            point = lambda flat: list(zip(flat[::2].tolist(), flat[1::2].tolist(), strict=True))
            area = [polygon_area(clip(point(p), point(q))) for p, q in zip(frame["ring_a"], frame["ring_b"], strict=True)]
            out = frame.drop(columns=["ring_a", "ring_b"]).assign(inter=area)
            yield out[out["inter"] > 0]

    flat = F.flatten(F.transform("ring", lambda v: F.array(v["x"], v["y"]))).alias("ring")  # numbers, not rows, go to Python
    boxed = lambda df: df.select("tile", "label", "area", flat, *envelope(F.col("ring")))
    near = spatial_join(boxed(a), boxed(b), intersects, on=["tile"])
    pairs = near.select(F.col("a_tile").alias("tile"), *[F.col(f"{s}_{c}").alias(f"{c}_{s}") for s in "ab" for c in ("label", "area", "ring")])
    return pairs.mapInPandas(run, "tile int, label_a long, area_a double, label_b long, area_b double, inter double")


def dice_of(inter: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Dice, Jaccard and share of the reference from the sum of `inter` and the sums of the areas."""
    whole = inter.agg(F.greatest(F.coalesce(F.sum("inter"), F.lit(0.0)), F.lit(0.0)).alias("i"))
    both = whole.crossJoin(a.agg(F.sum("area").alias("a1"))).crossJoin(b.agg(F.sum("area").alias("a2")))  # one row each
    i, a1, a2 = F.col("i"), F.col("a1"), F.col("a2")
    return both.select(F.round(2 * i / (a1 + a2), 9).alias("dice"), F.round(i / (a1 + a2 - i), 9).alias("jaccard"), F.round(i / a2, 9).alias("mask_intersection"))


def packed(grid: np.ndarray) -> bytes:
    return np.ascontiguousarray(grid).tobytes()


#: Distances of pixels whose way out isn't known yet.
FAR = 1 << 29


def walked(grid: np.ndarray) -> np.ndarray:
    """The least of each cell's value and any other cell's value plus the city-block distance between them."""
    for axis in (0, 1):
        at = np.arange(grid.shape[axis], dtype=np.int32).reshape((-1, 1) if axis == 0 else (1, -1))
        ahead = np.minimum.accumulate(grid - at, axis=axis) + at
        back = np.flip(np.minimum.accumulate(np.flip(grid + at, axis), axis=axis), axis) - at
        grid = np.minimum(ahead, back)
    return grid


def distance_transform(mask: DataFrame, tile: int, rounds: int = 10_000) -> DataFrame:
    """y, x, distance: city-block distance of foreground pixels (label <> 0) to the next pixel that isn't, over the whole image.

    Each tile is worked off alone as an array. Then only the tiles' outlines are handed to their neighbours, and worked
    off with what comes in, until no outline changes; the tiles themselves are read once more, with the final
    outlines. Pixels outside the image, or missing, are background. More rounds than allowed are an error.
    """
    sides = ((-1, 0), (1, 0), (0, -1), (0, 1))

    def outline(grid: np.ndarray) -> np.ndarray:
        """The rows above, below, and the columns left and right: the first and last of either."""
        return np.stack([grid[0], grid[-1], grid[:, 0], grid[:, -1]])

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(frame["ty"].iat[0]), int(frame["tx"].iat[0])
        grid = np.zeros((tile, tile), np.int32)
        grid[frame["y"].to_numpy() - ty * tile, frame["x"].to_numpy() - tx * tile] = FAR
        grid = walked(grid)
        return pd.DataFrame({"ty": [ty], "tx": [tx], "grid": [packed(grid)], "rim": [packed(outline(grid))]})

    def entered(rim: np.ndarray, halo: np.ndarray) -> np.ndarray:
        """An outline, given the outlines of the tiles around: everything goes along straight lines inside a tile."""
        at = np.arange(tile, dtype=np.int32)
        along = [np.minimum.accumulate(h - at) + at for h in halo + 1]
        along = [np.minimum(a, np.flip(np.minimum.accumulate(np.flip(h + at))) - at) for a, h in zip(along, halo + 1, strict=True)]
        top, bottom, left, right = along
        across = tile - 1
        down, over = at, at  # steps from the first row or column
        return np.minimum(rim, np.stack([
            np.minimum(np.minimum(top, bottom + across), np.minimum(left[0] + over, right[0] + across - over)),
            np.minimum(np.minimum(bottom, top + across), np.minimum(left[-1] + over, right[-1] + across - over)),
            np.minimum(np.minimum(left, right + across), np.minimum(top[0] + down, bottom[0] + across - down)),
            np.minimum(np.minimum(right, left + across), np.minimum(top[-1] + down, bottom[-1] + across - down)),
        ]))

    def around(frame: pd.DataFrame) -> Iterator[tuple]:
        """For each tile its outline, and what the tiles around it show: the side next to it, or background."""
        for rim, found in zip(frame["rim"], frame["found"], strict=True):
            halo = np.zeros((4, tile), np.int32)
            for x in found:
                halo[x["side"]] = np.frombuffer(x["values"], np.int32)
            yield np.frombuffer(rim, np.int32).reshape(4, tile), halo

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            new = [entered(rim, halo) for rim, halo in around(frame)]
            changed = [not np.array_equal(a, np.frombuffer(b, np.int32).reshape(4, tile)) for a, b in zip(new, frame["rim"], strict=True)]
            yield pd.DataFrame({"ty": frame["ty"], "tx": frame["tx"], "rim": [packed(x) for x in new], "changed": changed})

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ty, tx, raw, (_, halo) in zip(frame["ty"], frame["tx"], frame["grid"], around(frame), strict=True):
                grid = np.full((tile + 2, tile + 2), FAR, np.int32)
                grid[1:-1, 1:-1] = np.frombuffer(raw, np.int32).reshape(tile, tile)
                on = grid[1:-1, 1:-1] > 0
                grid[0, 1:-1], grid[-1, 1:-1], grid[1:-1, 0], grid[1:-1, -1] = halo
                y, x = np.nonzero(on)
                yield pd.DataFrame({"y": y + ty * tile, "x": x + tx * tile, "distance": walked(grid)[1:-1, 1:-1][y, x]})

    def with_neighbours(rims: DataFrame, tiles: DataFrame) -> DataFrame:
        # a tile's upper row is what the tile above it sees below
        shown = F.explode(F.array(*[F.struct((F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.lit(k ^ 1).alias("side"), F.substring("rim", k * tile * 4 + 1, tile * 4).alias("values")) for k, (dy, dx) in enumerate(sides)]))
        sent = rims.select(shown.alias("s")).select("s.*").groupBy("ty", "tx").agg(F.collect_list(F.struct("side", "values")).alias("found"))
        return tiles.join(sent, ["ty", "tx"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<side: int, values: binary>>")))

    own = mask.filter("label <> 0 and y is not null and x is not null").select(F.col("y").cast("int"), F.col("x").cast("int"))
    own = own.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    tiles = durable(own.groupBy("ty", "tx").applyInPandas(alone, "ty int, tx int, grid binary, rim binary"))
    rims = tiles.select("ty", "tx", "rim")
    for _ in range(rounds):
        rims = durable(with_neighbours(rims, rims).mapInPandas(step, "ty int, tx int, rim binary, changed boolean"))
        if rims.filter("changed").isEmpty():
            rims = rims.drop("changed")
            return with_neighbours(rims, tiles.drop("rim").join(rims, ["ty", "tx"])).mapInPandas(whole, "y int, x int, distance int")
        rims = rims.drop("changed")
    raise ValueError("the distance transform takes more rounds than allowed")
