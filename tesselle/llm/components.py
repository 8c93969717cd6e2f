"""Connected components of a graph of links, never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links that one union-find holds at a time. A partition with more is worked off in several forests.
FOREST = 1_000_000


def forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of a partition: each node but the roots with its root, the least of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def drain() -> pd.DataFrame:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:
            yield drain()
    yield drain()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of the links (u, v); the component is its least node. rows: a bound on the links, if known.

    Each partition first shrinks its links to a forest by union-find. Then large-star and small-star rounds (Kiveris
    and others, 2014) hang every node on the least node that it knows, until nothing changes. No links give no rows.
    """
    edges = checkpoint(links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInPandas(forests, "u long, v long").distinct(), rows)
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # large star
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = checkpoint(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), 2 * mark[0])
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
