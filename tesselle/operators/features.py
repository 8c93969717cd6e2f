"""Per-object features by colour channel: intensity, gradient and edge statistics, all in DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The weights of the Sobel operator for (dy, dx), across and down.
SOBEL = {(dy, dx): (dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)}


def gradients(image: DataFrame, channels: Sequence[str]) -> DataFrame:
    """tile, y, x, and for each channel c its value and c_gradient: the sum of the absolute Sobel responses.

    Each pixel adds its weighted value to the pixels around it. A neighbour that is missing counts as the pixel itself.
    """
    shares = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(-gx).alias("gx"), F.lit(-gy).alias("gy")) for (dy, dx), (gx, gy) in SOBEL.items()])
    # a neighbour at (dy, dx) of a pixel sees that pixel at (-dy, -dx), where the weights have the other sign
    sent = image.select("tile", "y", "x", *channels, F.explode(shares).alias("s"))
    sent = sent.select("tile", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("s.gx").alias("gx"), F.col("s.gy").alias("gy"), *channels)
    sums = sent.groupBy("tile", "y", "x").agg(F.sum("gx").alias("wx"), F.sum("gy").alias("wy"), *[F.sum(F.col(g) * F.col(c)).alias(f"{c}_{g}") for c in channels for g in ("gx", "gy")])
    whole = image.select("tile", "y", "x", *channels).join(sums, ["tile", "y", "x"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    response = lambda c, g: F.abs(zero(f"{c}_g{g}") - F.col(c) * zero(f"w{g}"))
    return whole.select("tile", "y", "x", *[x for c in channels for x in (F.col(c), (response(c, "x") + response(c, "y")).alias(f"{c}_gradient"))])


def object_features(mask: DataFrame, image: DataFrame, channels: Sequence[str] = ("b", "g", "r"), edge: float = 200.0) -> DataFrame:
    """One row for each labelled object (tile, label <> 0): its box, its pixels, and for each channel the mean, least, largest
    and spread (population variance) of the intensity, the mean and largest gradient, and the number of edge pixels,
    whose gradient is `edge` or more. Pixels that the image lacks are left out."""
    px = mask.filter("label <> 0").join(gradients(image, channels), ["tile", "y", "x"])
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("pixels")]
    of = lambda c: [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.round(F.var_pop(c), 6).alias(f"{c}_var"), F.round(F.avg(f"{c}_gradient"), 6).alias(f"{c}_gradient_mean"), F.max(f"{c}_gradient").alias(f"{c}_gradient_max"), F.count_if(F.col(f"{c}_gradient") >= edge).alias(f"{c}_edges")]
    return px.groupBy("tile", "label").agg(*box, *[x for c in channels for x in of(c)])
