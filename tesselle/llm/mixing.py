"""Mixing sources to target weights, in DataFrame functions only.

Each document draws a hash-random key; within its source the keys are cut into ranges, and runs of ranges make blocks.
Sizes are summed by range and by block on the executors. A place is the running sum of the blocks before, of the ranges
before in the block, and of the documents before in the range, so no running sum passes over more than about
RANGE_ROWS documents, BLOCK_RANGES ranges, or one row for a million documents of a source. A source passes over its
documents as often as its budget holds all of them, and once more up to the rest; the document at the cut gives part of
its words, so the budget is met exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Documents of a range, and ranges of a block, on average.
RANGE_ROWS, BLOCK_RANGES = 4_000, 256


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size), one row each.

    Sources by code point, null last, take the weights in turn. A target is weight times a level common to all, but at
    most `most` times the source's size; the level is the one at which targets add up to `share` of all words. That is
    where sharing the excess again and again ends. With the sources sorted by the level at which they are full, the
    level follows from running sums. There is one row per source, so the windows are small.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("filled")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct(F.col("full_at"), F.col("level")))).over(every)["level"]
    return s.select("source", "source_size", F.round(F.least("cap", F.coalesce(F.col("w") * level, F.col("cap"))), 6).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the `extra` columns of `docs`, whatever their names.

    Null and empty texts have size 0 and are never taken. Null sources are one source. Rows with equal ids, null ids
    included, follow each other by size; equal rows may change places, which leaves the result the same. Reruns agree.
    Without documents there are no rows. An id that a third of all rows have falls in one range.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *[F.col(c).alias(f"_x{k}") for k, c in enumerate(extra)])
    own = own.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    own = checkpoint(own)  # a narrow table: the texts are read once
    # the key's first 32 bits, cut into as many equal ranges as the source needs
    cut = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes.select("source", "source_size"), weights, share, most)
    facts = sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") / RANGE_ROWS).alias("ranges")).join(goal.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    placed = own.join(facts, own["source"].eqNullSafe(facts["s"])).drop("s").withColumn("range", cut)
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    blocks = sums.groupBy("source", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), running("words", before("source").orderBy("block")).alias("base"))
    starts = sums.select("source", "block", F.col("range").alias("r"), running("words", before("source", "block").orderBy("range")).alias("inside"))
    starts = starts.join(blocks, starts["source"].eqNullSafe(blocks["s"]) & (starts["block"] == blocks["b"])).select("s", "r", (F.col("base") + F.col("inside")).alias("start"))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["range"] == starts["r"])).drop("s", "r")
    place = F.col("start") + running("size", before("source", "range").orderBy("key", "doc_id", "size"))
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - place))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_x{k}").alias(c) for k, c in enumerate(extra)])


ORACLE = r"""
WITH own AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, cap / w AS full_at,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
chosen AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, level LIMIT 1),
goal AS (SELECT source, source_size, round(least(cap, coalesce(w * (SELECT level FROM chosen), cap)), 6) AS target FROM levels),
placed AS (
  SELECT o.doc_id, o.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
    coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.key, o.doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM own o JOIN goal g ON o.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - place)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
