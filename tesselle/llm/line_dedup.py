"""Line dedup by pairwise alignment.

Overlapping documents are found through hashes of shared rare lines. A line that is short or frequent is no guide by itself, so
a seed is the shortest run of adjacent shared lines that reaches `least_chars` characters: a long line is its own seed,
short ones make a rarer one together, and each line of a block that can be deleted is in some seed. Each seed leads to
the earliest document that has the same run; so a run shared by n documents makes n - 1 pairs, not n squared, and a
common line needs no limit. Where the alignments leave a line of a seed (it is moved, or repeated), a rare seed, of up
to ROUND holders, leads to all of them, a frequent one to so many at a time until all its lines are deleted or all
earlier holders are aligned. Holders whose shared lines are the same in the same order count once. So the lines that go
are those that alignments with all earlier documents would delete.
Both documents of a pair, reduced to the lines they share, are aligned by patience diff: lines that are unique on both
sides are kept in their longest increasing order, and the parts between these are aligned in the same way. Aligned
lines that follow each other on both sides make a block; blocks of `least_chars` characters or more are deleted from
the later document. Only hashes and line numbers are shuffled for all of this; texts move once, to their deletions.
Counts and earliest holders are aggregated before they are shuffled, and the holders of the hottest lines and runs are
shared out to several tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_HOT, checkpoint, hottest, join_salted, small_batches

#: The second round goes to this many holders of a seed, and each further one to GROWTH times as many.
ROUND, GROWTH = 32, 16
#: One in so many documents tells which lines are hot.
PART = 16
#: Rows that a Python task hands on at a time.
HANDED_ON = 10_000


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for k, x in enumerate(values):
        pile = bisect_left(tops, x)
        if pile == len(tops):
            tops.append(x)
            at.append(k)
        else:
            tops[pile], at[pile] = x, k
        back[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        in_a, in_b = Counter(a[lo:hi]), Counter(b[low:high])
        where = {b[k]: k for k in range(low, high) if in_b[b[k]] == 1}
        unique = [(k, where[a[k]]) for k in range(lo, hi) if in_a[a[k]] == 1 and a[k] in where]
        anchors = [unique[k] for k in longest_increasing([y for _, y in unique])]
        if anchors:
            out += anchors
            for (x, y), (u, v) in zip([(lo - 1, low - 1), *anchors], [*anchors, (hi, high)], strict=True):
                todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def blocks(shared: list[tuple[list[int], list[int], int]], least_chars: int) -> tuple[set[int], int]:
    """Lines to delete and the number of blocks. shared: for each common line its numbers in the later document, those
    in the earlier one, and its characters."""
    later = sorted((p, k) for k, (own, _, _) in enumerate(shared) for p in own)
    earlier = sorted((p, k) for k, (_, other, _) in enumerate(shared) for p in other)
    aligned = [(earlier[i][0], later[j][0], shared[later[j][1]][2]) for i, j in patience([k for _, k in earlier], [k for _, k in later])]
    gone: set[int] = set()
    count, k = 0, 0
    while k < len(aligned):
        end = k + 1
        while end < len(aligned) and aligned[end][0] == aligned[end - 1][0] + 1 and aligned[end][1] == aligned[end - 1][1] + 1:
            end += 1
        if sum(x[2] for x in aligned[k:end]) >= least_chars:
            gone.update(x[1] for x in aligned[k:end])
            count += 1
        k = end
    return gone, count


def runs(lines: list[tuple[int, list[int], int]], least_chars: int) -> tuple[bytes, dict[int, set[int]]]:
    """A name of the order of the lines, and by its hash each shortest run of adjacent lines that reaches `least_chars`
    from its first line on or from its last line back, with the numbers of the lines in it. Each line of a block is in
    such a run of the block. lines: for each shared line its hash, its numbers and its characters."""
    order = sorted((p, key, chars) for key, at, chars in lines for p in at)
    by_place = {p: (key, chars) for p, key, chars in order}
    steps = [key for k, (p, key, _) in enumerate(order) for key in (key, int(k > 0 and p == order[k - 1][0] + 1))]
    found: dict[int, set[int]] = {}
    for first in by_place:
        for step in (1, -1):
            p, held = first, 0
            while p in by_place and held < least_chars:
                held, p = held + by_place[p][1], p + step
            if held >= least_chars:
                own = range(first, p) if step > 0 else range(p + 1, first + 1)
                key = xxhash.xxh3_64_intdigest(np.array([by_place[k][0] for k in own], np.int64).tobytes())
                found.setdefault(key - (1 << 63), set()).update(own)
    return xxhash.xxh3_128_digest(np.array(steps, np.int64).tobytes()), found


def overlaps(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """doc_id, gone (numbers of lines to delete, among the non-blank ones): documents that lose lines only."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.col("text").cast("string"), "\n").alias("lines")).filter("doc_id is not null")
    plain = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "")
    lines = lines.select("doc_id", F.posexplode(plain).alias("pos", "line")).select("doc_id", "pos", F.xxhash64("line").alias("hash"), F.length("line").alias("chars"))
    # hot lines are known from a part of the documents: that decides how the join is dealt out, not what it gives
    hot = max(1_000, docs.count() // MOST_HOT)
    part = lines.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0).groupBy("hash").agg(F.count("*").alias("n"))
    common = hottest(part, "hash", hot // PART)
    often = lines.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("hash")
    found = join_salted(lines, often, "hash", common)
    shared = checkpoint(found.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.max("chars").alias("chars")))
    rows = 2 * shared.count()

    def seek(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = ["doc_id", "shape", "run", "at"], []
        for frame in frames:
            for doc, flat in zip(frame["doc_id"], frame["lines"], strict=True):
                shape, found = runs([(key, at, chars) for key, chars, at in unflattened(flat, 2, 1)], least_chars)
                out += [(doc, shape, run, sorted(at)) for run, at in found.items()]
                if len(out) > HANDED_ON:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    flat = F.concat(F.array("hash", F.col("chars").cast("long"), F.size("at").cast("long")), F.col("at").cast("array<long>"))
    whole = shared.groupBy("doc_id").agg(F.flatten(F.collect_list(flat)).alias("lines"))
    seeds = checkpoint(whole.mapInPandas(seek, "doc_id long, shape binary, run long, at array<int>"), rows)
    first = seeds.groupBy("run").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("last > owner")
    common = hottest(first, "run", hot)
    open_ = join_salted(seeds, first.drop("last", "n"), "run", common).filter("doc_id > owner").select("doc_id", "owner", "run", "at")
    open_ = checkpoint(open_, rows)
    gone = checkpoint(aligned(open_, shared, least_chars), rows)
    open_ = checkpoint(left_over(open_, gone), rows)
    once = seeds.join(seeds.groupBy("shape").agg(F.min("doc_id").alias("doc_id")), ["shape", "doc_id"], "left_semi")
    holders = checkpoint(once.select("run", F.col("doc_id").alias("owner")).join(open_.select("run"), "run", "left_semi"), rows)
    low, high = 2, ROUND
    while not open_.isEmpty():
        # of a hot run, each task sends on `high` holders at most before they are ranked together
        rank = F.row_number().over(Window.partitionBy("run").orderBy("owner"))
        found = checkpoint(holders.withColumn("rank", rank).filter(F.col("rank") <= high).filter(F.col("rank") >= low).drop("rank"), rows)
        if found.isEmpty():
            break
        todo = join_salted(open_, found, "run", common).filter("doc_id > owner")
        gone = checkpoint(gone.union(aligned(todo, shared, least_chars)).distinct(), rows)
        open_ = checkpoint(left_over(todo, gone), rows)
        low, high = high + 1, high * GROWTH
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def unflattened(flat: np.ndarray, facts: int, lists: int) -> Iterator[tuple]:
    """The lines that were put one after the other: each `facts` numbers, the lengths of `lists` lists, and these lists."""
    flat, at = flat.tolist(), 0
    while at < len(flat):
        own = flat[at : at + facts]
        sizes = flat[at + facts : at + facts + lists]
        at += facts + lists
        for n in sizes:
            own.append(flat[at : at + n])
            at += n
        yield tuple(own)


def left_over(seeds: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, run, at of the seeds that still have lines."""
    away = gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    left = F.size(F.array_except("at", F.coalesce("gone", F.array().cast("array<int>")))) > 0
    return seeds.select("doc_id", "run", "at").distinct().join(away, "doc_id", "left").filter(left).drop("gone")


def aligned(todo: DataFrame, shared: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, pos: the lines in blocks that doc_id has in common with an owner. todo: pairs (doc_id, owner), repeated or not."""
    pairs = todo.select("doc_id", "owner").distinct()
    later = pairs.join(shared, "doc_id")
    earlier = shared.select(F.col("doc_id").alias("owner"), "hash", F.col("at").alias("other")).join(pairs.select("owner").distinct(), "owner", "left_semi")
    common = later.join(earlier, ["owner", "hash"])
    flat = F.concat(F.array("chars", F.size("at"), F.size("other")), "at", "other")
    each = common.groupBy("doc_id", "owner").agg(F.flatten(F.collect_list(flat)).alias("shared"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, lines = [], []
        for frame in frames:
            for doc, flat in zip(frame["doc_id"].tolist(), frame["shared"], strict=True):
                gone, _ = blocks([(own, other, chars) for chars, own, other in unflattened(flat, 1, 2)], least_chars)
                docs += [doc] * len(gone)
                lines += gone
                if len(docs) > HANDED_ON:
                    yield pd.DataFrame({"doc_id": docs, "pos": lines})
                    docs, lines = [], []
        yield pd.DataFrame({"doc_id": docs, "pos": lines}, dtype="int64")

    return each.mapInPandas(run, "doc_id long, pos int").distinct()


def dedup_lines(docs: DataFrame, least_chars: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (the text that is left), n_lines, n_deleted, n_blocks and the `carry` columns for each row.

    Lines are compared without blanks at their ends; blank lines never match and stay. Null and empty texts have no
    lines; kept is null or empty as they are. Rows with equal ids count as one document: equal rows give equal
    results. Rows without an id stay as they are. n_blocks counts the runs of adjacent lines that are deleted. Columns of
    `docs` that are not named are dropped.
    """
    gone = overlaps(docs, least_chars).withColumnRenamed("doc_id", "_id")
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)])
    joined = own.join(gone, own["doc_id"] == gone["_id"], "left").drop("_id")
    kinds = dict(docs.dtypes)
    shape = "doc_id long, kept string, n_lines long, n_deleted long, n_blocks int" + "".join(f", _c{k} {kinds[c]}" for k, c in enumerate(carry))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, total, deleted, parts = [], [], [], []
            for text, away in zip(frame["_text"], frame["gone"], strict=True):
                away = set(away.tolist()) if away is not None else set()
                number, left = 0, []
                for line in text.split("\n") if text else ():
                    if line.strip(" "):
                        if number not in away:
                            left.append(line)
                        number += 1
                    else:
                        left.append(line)
                kept.append("\n".join(left) if text else text)
                total.append(number)
                deleted.append(len(away))
                parts.append(sum(p - 1 not in away for p in away))
            yield frame.drop(columns=["_text", "gone"]).assign(kept=kept, n_lines=total, n_deleted=deleted, n_blocks=np.array(parts, np.int32))

    return joined.mapInPandas(run, shape).withColumnsRenamed({f"_c{k}": c for k, c in enumerate(carry)})
