"""Connected components of a graph of links, never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Links that one union-find holds at a time. A partition with more is worked off in several forests.
FOREST = 1_000_000


def union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as a forest: each node but the roots with its root, the least of its tree."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        end = node
        while above.setdefault(end, end) != end:
            end = above[end]
        while above[node] != end:
            above[node], node = end, above[node]
        return end

    def emptied() -> pd.DataFrame:
        rows = [(node, end) for node in list(above) if (end := top(node)) != node]
        above.clear()
        return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            low, high = sorted((top(u), top(v)))
            above[high] = low
        if len(above) > FOREST:
            yield emptied()
    yield emptied()


def label_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the links (u, v); a component is named by its least node. No links give no rows.

    Rounds of large and small stars (Kiveris and others, 2014) hang each node on the least one that it knows until
    nothing changes: their number grows with the logarithm of a component's width.
    """
    edges = durable(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null").mapInPandas(union_find, "u long, v long").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.union(edges.select("v", "u"))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u")
        edges = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
    ends = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)
