"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again as it grows. Each turn gets the rolling hash of all turns up to it: two
running exclusive ors of turn hashes salted by position, 128 bits together. A conversation whose last hash is an inner hash of another
one is a snapshot of it and goes by an anti-join; of equal conversations the one with the least id stays. The longest
are rendered. The hashes of a prefix are distinct rows, so a first turn that many conversations share is one row of
the anti-join's small side, aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rolling(seed: int) -> Column:
    """The term of a turn."""
    return F.xxhash64(F.lit(seed), "pos", F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0")))


def maximal(conversations: DataFrame) -> DataFrame:
    """The turns (conv_id, part, pos, role, text, copies) of conversations that are no prefix of another.

    Turns are ordered by turn, role and text; null turns come first; ties and repeated rows are turns of their own; null
    roles and texts equal each other only. A turn without a conv_id belongs to no other one: it is a conversation by
    itself, told from the rest by `part`, so however many there are they spread evenly. Of equal conversations that with
    the least id stays, one without an id only if there is no other, and `copies` counts all. Other columns are ignored.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.filter("conv_id is not null").withColumn("pos", F.row_number().over(order))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = numbered.select("conv_id", "pos", _rolling(1).alias("t1"), _rolling(2).alias("t2"), F.lead(F.lit(1)).over(order).isNull().alias("is_last"))
    rolled = hashed.select("conv_id", "pos", "is_last", F.bit_xor("t1").over(so_far).alias("h1"), F.bit_xor("t2").over(so_far).alias("h2"))
    alone = turns.filter("conv_id is null").withColumn("pos", F.lit(1))
    alone = alone.select("conv_id", "pos", _rolling(1).alias("h1"), _rolling(2).alias("h2"), F.struct("role", "text").alias("said"))
    last = rolled.filter("is_last").select("conv_id", "pos", "h1", "h2", F.lit(None).cast("struct<role: string, text: string>").alias("said"))
    ends = last.union(alone).groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min("said").alias("said"), F.count("*").alias("copies"))
    inner = rolled.filter("not is_last").select("pos", "h1", "h2").distinct()
    kept = ends.join(inner, ["pos", "h1", "h2"], "left_anti")
    named = numbered.join(kept.filter("conv_id is not null").select("conv_id", "copies"), "conv_id")
    named = named.select("conv_id", F.lit(0).cast("long").alias("part"), "pos", "role", "text", "copies")
    return named.union(kept.filter("conv_id is null").select("conv_id", F.col("h1").alias("part"), "pos", "said.role", "said.text", "copies"))


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, copies, rendered: each turn as `start`role newline text `end`, joined by newlines.

    A null role is told as unknown, a null text as an empty one. No turns give no rows. A conversation is one row."""
    said = F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end))
    told = turns.select("conv_id", "part", "copies", F.struct("pos", said.alias("said")).alias("turn"))
    grouped = told.groupBy("conv_id", "part").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join(F.col("turns")["said"], "\n").alias("rendered"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered; the cases are those of `maximal` and `render`."""
    return render(maximal(conversations))


ORACLE = """
WITH keyed AS (SELECT *, coalesce(conv_id::VARCHAR, 'none ' || row_number() OVER ()) AS k FROM conversations),
numbered AS (
  SELECT k, conv_id, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM keyed),
whole AS (
  SELECT k, conv_id, pos, role, text, count(*) OVER (PARTITION BY k) AS n,
    string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3)) OVER (PARTITION BY k ORDER BY pos) AS prefix
  FROM numbered),
ends AS (SELECT prefix, min(conv_id) AS conv_id, min(k) AS any_k, count(*) AS copies, max(n) AS n FROM whole WHERE pos = n GROUP BY prefix),
kept AS (SELECT *, coalesce(conv_id::VARCHAR, any_k) AS k FROM ends WHERE prefix NOT IN (SELECT prefix FROM whole WHERE pos < n))
SELECT kept.conv_id, kept.n AS n_turns, kept.copies,
  string_agg('<|im_start|>' || coalesce(w.role, 'unknown') || chr(10) || coalesce(w.text, '') || '<|im_end|>', chr(10) ORDER BY w.pos) AS rendered
FROM kept JOIN numbered w ON w.k = kept.k GROUP BY kept.k, kept.conv_id, kept.n, kept.copies
"""
