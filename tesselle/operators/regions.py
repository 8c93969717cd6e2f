"""Versioned, timestamped regions: boxes with inclusive integer corners, lookup, upsert, deletion, cropping, chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("dr_name", "ts", "version")


def box_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed intervals on each axis; a and b are lower corner, then upper corner, of any dimension."""
    n = len(a) // 2
    out = F.lit(True)
    for k in range(n):
        out = out & (a[k] <= b[n + k]) & (b[k] <= a[n + k])
    return out


def box_intersection(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """May be inverted where the boxes don't meet, as in the engine that this one stands in for."""
    n = len(a) // 2
    return [F.greatest(a[k], b[k]) for k in range(n)] + [F.least(a[k], b[k]) for k in range(n, 2 * n)]


def box_sizes(a: Sequence[Column]) -> list[Column]:
    n = len(a) // 2
    return [a[n + k] - a[k] + 1 for k in range(n)]


def box_include(a: Sequence[Column], b: Sequence[Column]) -> Column:
    n = len(a) // 2
    out = F.lit(True)
    for k in range(n):
        out = out & (a[k] <= b[k]) & (a[n + k] >= b[n + k])
    return out


def box_equals(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(True)
    for one, two in zip(a, b, strict=True):
        out = out & (one == two)
    return out


def box_to_origin(a: Sequence[Column], origin: Sequence[Column]) -> list[Column]:
    """The box seen from a corner of another one."""
    n = len(a) // 2
    return [c - origin[k % n] for k, c in enumerate(a)]


def box_parts(df: DataFrame, low: Sequence[str] = ("x0", "y0"), high: Sequence[str] = ("x1", "y1")) -> DataFrame:
    """Each inclusive box cut in half on all its axes: id, part (the first axis counts most), and the corners as
    p_ and their names. 2, 4 or 8 parts for 1, 2 or 3 axes; empty parts are left out."""
    n = len(low)
    middle = [F.floor((F.col(a) + F.col(b)) / 2) for a, b in zip(low, high, strict=True)]
    made = []
    for part in range(1 << n):
        upper = [part >> (n - 1 - k) & 1 for k in range(n)]
        ends = [(middle[k] + 1 if upper[k] else F.col(low[k])).alias(f"p_{low[k]}") for k in range(n)]
        ends += [(F.col(high[k]) if upper[k] else middle[k]).alias(f"p_{high[k]}") for k in range(n)]
        made.append(F.struct(F.lit(part).cast("long").alias("part"), *ends))
    out = df.select("id", F.explode(F.array(*made)).alias("q")).select("id", "q.*")
    for a, b in zip(low, high, strict=True):
        out = out.filter(F.col(f"p_{a}") <= F.col(f"p_{b}"))
    return out


def box_intervals(df: DataFrame, bits: int = 10) -> DataFrame:
    """id, first, last: the runs of Hilbert places that an inclusive box of cells covers, in a square of 2^bits.

    An aligned square of cells is one run of the curve, so a box is cut into the largest such squares; the work grows
    with a box's outline, not with its area. Cells outside the square have no place.
    """

    def place(x: int, y: int) -> int:
        d, s = 0, 1 << (bits - 1)
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * (3 * rx ^ ry)
            x, y = x & (s - 1), y & (s - 1)
            if not ry:
                x, y = (s - 1 - y, s - 1 - x) if rx else (y, x)
            s >>= 1
        return d

    def runs(x0: int, y0: int, x1: int, y1: int) -> list[list[int]]:
        found, todo = [], [(0, 0, 1 << bits)]
        while todo:
            x, y, s = todo.pop()
            if x > x1 or y > y1 or x + s - 1 < x0 or y + s - 1 < y0:
                continue
            if x0 <= x and y0 <= y and x + s - 1 <= x1 and y + s - 1 <= y1:
                first = place(x, y) // (s * s) * s * s
                found.append([first, first + s * s - 1])
            else:
                s //= 2
                todo += [(x + dx, y + dy, s) for dx in (0, s) for dy in (0, s)]
        joined: list[list[int]] = []
        for first, last in sorted(found):
            if joined and joined[-1][1] + 1 == first:
                joined[-1][1] = last
            else:
                joined.append([first, last])
        return joined

    def run(frames):
        for frame in frames:
            boxes = zip(*[frame[c].tolist() for c in ("id", "x0", "y0", "x1", "y1")], strict=True)
            yield pd.DataFrame([(id_, *x) for id_, *box in boxes for x in runs(*box)], columns=["id", "first", "last"])

    return df.select("id", "x0", "y0", "x1", "y1").dropna().mapInPandas(run, "id long, first long, last long")


def upsert(regions: DataFrame) -> DataFrame:
    """The newest row (by seq) of each name, timestamp and version, whatever its id; rows without a name are refused."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    return regions.filter("dr_name is not null and dr_name <> ''").withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


def lookup(regions: DataFrame, name: str, ts: int, version: int, dr_id: str | None = None) -> DataFrame:
    """The newest match, as one row; any id without `dr_id`."""
    found = regions.filter((F.col("dr_name") == name) & (F.col("ts") == ts) & (F.col("version") == version))
    if dr_id is not None:
        found = found.filter(F.col("dr_id") == dr_id)
    return found.groupBy().agg(F.max_by(F.struct(*regions.columns), "seq").alias("r")).filter("r is not null").select("r.*")


def delete(regions: DataFrame, name: str, ts: int, version: int, dr_id: str | None = None) -> DataFrame:
    """All rows but the one that lookup finds."""
    return regions.join(lookup(regions, name, ts, version, dr_id).select("seq"), "seq", "left_anti")


def index(regions: DataFrame) -> DataFrame:
    """Numbered by name, newest first within a name. Names are numbered from the counts of the names before them."""
    counts = regions.groupBy("dr_name").count()
    start = counts.select("dr_name", (F.coalesce(F.sum("count").over(Window.orderBy("dr_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    own = F.row_number().over(Window.partitionBy("dr_name").orderBy(F.desc("seq"))) - 1
    return regions.join(start, "dr_name").withColumn("idx", (F.col("start") + own).cast("long")).drop("start")


def crop(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels inside the inclusive box, at coordinates relative to its corner."""
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def chunks_of(chunks: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The chunks that meet the box: a plain filter, so it reaches the scan before any bytes are read."""
    return chunks.filter((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))


def assemble(tiles: DataFrame, tile: int) -> DataFrame:
    """Pixels of tiles (tile_x, tile_y) at the coordinates of the whole slide."""
    return tiles.withColumns({"x": F.col("tile_x") * tile + F.col("x"), "y": F.col("tile_y") * tile + F.col("y")}).drop("tile_x", "tile_y")


def slide_grid(slides: DataFrame, tile: int) -> DataFrame:
    """Tiles of each slide (id, w, h): size/tile + 1 along each axis, clipped, those of no size left out."""
    t = slides.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("w") / tile)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("h") / tile))))
    cut = t.select("id", (F.col("i") * tile).alias("x"), (F.col("j") * tile).alias("y"), F.least(F.lit(tile), F.col("w") - F.col("i") * tile).alias("tw"), F.least(F.lit(tile), F.col("h") - F.col("j") * tile).alias("th"))
    return cut.filter("tw > 0 and th > 0")


def largest_level(levels: DataFrame) -> DataFrame:
    """The pyramid level with most pixels per slide; the first of equal ones."""
    return levels.groupBy("id").agg(F.max_by("level", F.struct(F.col("w") * F.col("h"), -F.col("level"))).alias("level"))


def unpremultiply(c: Column, a: Column) -> Column:
    return F.when(a == 0, 0).when(a == 255, c).otherwise(F.floor((c * 255 + F.floor(a / 2)) / a)).cast("long")


def versions(regions: DataFrame, name: str) -> DataFrame:
    """The versions under which a region is stored."""
    return regions.filter(F.col("dr_name") == name).select("version").distinct()


def ragged_equal(a: Column, b: Column) -> Column:
    """Whether two ragged regions (arrays of arrays) have the same sizes and elements; null is equal to null only."""
    return a.eqNullSafe(b)


def reuse(regions: DataFrame, sizes: str, worker: str) -> DataFrame:
    """Per worker, the bytes of the regions that it holds already."""
    return regions.groupBy(F.col(worker).alias("worker")).agg(F.sum(sizes).alias("reused"))


def box_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance of two inclusive boxes of any dimension, 0 if they meet."""
    n = len(a) // 2
    gaps = [F.greatest(a[k] - b[n + k], b[k] - a[n + k], F.lit(0)).cast("double") for k in range(n)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def file_name(name: Column, dr_id: Column, version: Column, ts: Column, extension: str = "") -> Column:
    """The file that a region is stored in: name-id-version-timestamp and the extension."""
    return F.concat(F.concat_ws("-", name, dr_id, version.cast("string"), ts.cast("string")), F.lit(extension))


def put(regions: DataFrame, path: str) -> None:
    """Publishes regions: appended under their name, version and timestamp, whole or not at all. What is there stays."""
    regions.write.mode("append").partitionBy("dr_name", "version", "ts").parquet(path)


def get(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a region in a version, or in its newest one. Only that folder is read."""
    own = spark.read.parquet(path).filter(F.col("dr_name") == name)
    if version is None:
        version = own.agg(F.max("version")).first()[0]
    return own.filter(F.col("version") == F.lit(version))


def magnification(properties: Column) -> Column:
    """The magnification that a slide's properties (a map) name, 0 if they don't or it isn't a number."""
    return F.coalesce(F.try_element_at(properties, F.lit("aperio.AppMag")).try_cast("double"), F.lit(0.0))


def region_of_interest(regions: DataFrame, pixels: DataFrame, name: str, ts: int, version: int, box: tuple[int, int, int, int], dr_id: str | None = None) -> DataFrame:
    """The pixels (seq, y, x, label) of the region that `lookup` finds, cropped to an inclusive box."""
    found = lookup(regions, name, ts, version, dr_id).select("seq")
    return crop(pixels.join(F.broadcast(found), "seq"), *box)  # one row
