"""Near-duplicate grouping by SuperMinHash (Ertl 2017, "SuperMinHash").

Each shingle draws one random permutation of the slots step by step; at step j it offers j plus a random fraction to
the slot that the permutation names. A text stops as soon as all its slots hold less than the next step could offer,
which for most texts is after one or two steps. Slots of one text are correlated so that their mean varies less than
that of independent hashes.

Candidates come from bands of slots. Texts with equal shingle sets form one class and take part once. Each member of a
bucket is compared with the bucket's hub on full sets, so that a large group of near copies costs one pair each. Members
that aren't linked to the hub are then compared with all others that have the same hub, by what either set lost and
gained against the hub. Up to FAMILY members do so inside a task. More are split by shared differences: two sets, one of
them not linked to the hub, are only similar if enough of their differences to the hub agree, so some agree among the
rarest ones of either, of which there is a bound (prefix filter). Members that have such a difference in common get a hub
of their own, and so on. All of this is exact for sets that have a hub in common, needs no pair of members as a row, and has no bound on a
bucket. Union-find and star rounds make the groups. With 16 bands of 4 slots a pair at similarity 0.85 is missed with probability 8e-6,
and pairs with fewer than `least_equal` equal slots of 64 (6 standard deviations below 0.85) are not verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, hottest, join_salted, mix, pack, shingles, small_batches, unpack
from .components import components

#: Members of a bucket that choose a hub together; larger buckets are split by a hash of the id, and the hubs of the parts meet.
PART = 256
#: Members of a hub that are compared in one task, and how often larger families are split by shared differences; what is
#: larger even then is compared in blocks.
FAMILY, SPLITS = 2048, 2
BATCH = 200_000
MARK = np.uint64(1 << 63)
NEVER = np.uint64((1 << 64) - 1)


def signatures(sets: list[np.ndarray], slots: int = 64) -> np.ndarray:
    """One row of `slots` values per set of shingle hashes; an empty set has no finite value."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.full((len(sets), slots), NEVER, np.uint64)
    flat = out.reshape(-1)
    elements = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(elements), slots))
    for j in range(slots):
        drawn = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int64)
        row = np.arange(len(elements))
        slot = order[row, k]
        np.minimum.at(flat, owner * slots + slot, np.uint64(j << 32) | drawn >> np.uint64(32))
        open_ = out.max(axis=1) >= np.uint64((j + 1) << 32)
        active = open_[owner]
        if not active.any():
            break
        row, slot_at = row[active], k[active]
        elements, owner, order = elements[active], owner[active], order[active]  # a copy, even at first
        order[np.arange(len(row)), slot_at] = order[:, j]
    return out


def word_sets(texts: list, size: int, words: WordHashes) -> list[np.ndarray]:
    return [np.unique(shingles(words.of((x or "").encode("utf-8", "surrogatepass").lower().split()), size)) for x in texts]


def sketch(docs: DataFrame, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set1 and set2 (a 128-bit name of the set), slots (two bytes each), keys (one per band)."""
    slots = bands * rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for frame in frames:
            lo = 0
            while lo < len(frame):
                hi, held, sets = lo, 0, []
                while hi < len(frame) and held < BATCH:
                    sets += word_sets([frame["text"].iat[hi]], size, words)
                    held += len(sets[-1])
                    hi += 1
                values = mix(signatures(sets, slots))
                keys = np.zeros((len(sets), bands), np.uint64)
                for k in range(rows):
                    keys = mix(keys * np.uint64(31) + values[:, k::rows])
                names = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
                signed = np.array([(x >> 64, x & 0xFFFFFFFFFFFFFFFF) for x in names], np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[lo:hi].astype("Int64").to_numpy(object), "n_shingles": [len(x) for x in sets], "set1": signed[:, 0], "set2": signed[:, 1], "slots": [x.tobytes() for x in (values >> np.uint64(48)).astype(np.uint16)], "keys": list(keys.view(np.int64))})
                lo = hi

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows_.mapInPandas(run, "doc_id long, n_shingles long, set1 long, set2 long, slots binary, keys array<long>")


def nearest(frame: pd.DataFrame) -> pd.DataFrame:
    """The member nearest to the most frequent value of each slot."""
    slots = np.stack([np.frombuffer(x, np.uint16) for x in frame["slots"]])
    agreed = np.zeros(len(frame), np.int64)
    for column in slots.T:
        values, counts = np.unique(column, return_counts=True)
        agreed += column == values[counts.argmax()]
    best = int(np.lexsort([frame["rep"].to_numpy(), -agreed])[0])
    return frame.iloc[[best]]


def nearest_of(columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return nearest(frame)[columns]

    return run


def first_pairs(classes: DataFrame, count: int, small: int = 8) -> DataFrame:
    """Pairs (a, b) of each member and the hub of its bucket: the least id in small buckets, else the nearest to all."""
    bucket = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    size = checkpoint(bucket.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1"), count)
    member = bucket.join(size, ["band", "key"])
    many = member.filter(f"n > {small}").drop("hub").join(classes.select("rep", "slots"), "rep")
    part = lambda size: F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / size)).cast("int")
    hub = many.withColumns({"part": part(PART), "whole": part(PART * PART)})
    for keys in (["part", "whole"], ["whole"], []):  # the hubs of parts meet in wholes, those of wholes in the bucket
        kept = [*keys[1:], "n", "rep", "slots"]
        shape = "band int, key long, " + "".join(f"{c} {dict(hub.dtypes)[c]}, " for c in kept).removesuffix(", ")
        hub = hub.groupBy("band", "key", *keys).applyInPandas(nearest_of(["band", "key", *kept]), shape)
    hub = hub.select("band", "key", F.col("rep").alias("nearest"))
    pairs = member.join(hub, ["band", "key"], "left").select(F.col("rep").alias("a"), F.coalesce("nearest", "hub").alias("b"))
    return pairs.filter("a <> b").distinct()


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked (100 * intersection >= percent * union), and how a's set differs from the hub's: n (the hub's size),
    n_lost, n_new and diff: the places of lost shingles in the hub's order, then the new shingles, marked in bit 63."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, last, there = [], None, np.empty(0, np.uint64)
            for a, b, own, other in zip(frame["a"], frame["b"], frame["own"], frame["other"], strict=True):
                if b != last:
                    last, there = b, unpack(other, True)
                here = unpack(own, True)
                at = np.minimum(np.searchsorted(there, here), len(there) - 1)
                same = there[at] == here
                common = int(same.sum())
                lost = np.ones(len(there), bool)
                lost[at[same]] = False
                diff = np.concatenate([np.flatnonzero(lost).astype(np.uint64), here[~same] | MARK])
                out.append((a, b, 100 * common >= percent * (len(here) + len(there) - common), len(there), len(there) - common, len(here) - common, pack(diff, True)))
            yield pd.DataFrame(out, columns=["a", "b", "linked", "n", "n_lost", "n_new", "diff"])

    own = sets.select(F.col("rep").alias("a"), F.col("set").alias("own"))
    other = sets.select(F.col("rep").alias("b"), F.col("set").alias("other"))
    return pairs.join(own, "a").join(other, "b").mapInPandas(run, "a long, b long, linked boolean, n int, n_lost int, n_new int, diff binary")


def family(frame: pd.DataFrame, percent: int, least_equal: int) -> pd.DataFrame:
    """Links (u, v) of members that aren't linked to their hub with any others, from their differences to the hub.

    With n shingles in the hub, two members share n less what either lost, plus what both lost and both gained. Members
    that are connected already are not compared again.
    """
    left, right = frame[frame["asks"]], frame[~frame["asks"]]
    reps = right["a"].to_numpy(np.int64)
    slots = np.stack([np.frombuffer(x, np.uint16) for x in right["slots"]])
    lost, new, n = right["n_lost"].to_numpy(np.int64), right["n_new"].to_numpy(np.int64), int(right["n"].iat[0])
    diffs = [unpack(x, True) for x in right["diff"]]
    flat = np.concatenate(diffs)
    holder = np.repeat(np.arange(len(diffs)), [len(x) for x in diffs])
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    parent = {int(frame["b"].iat[0]): int(frame["b"].iat[0])}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    hub = int(frame["b"].iat[0])
    for x in reps[right["linked"].to_numpy(bool)].tolist():
        parent[x] = hub
    links = []
    for rep, own, own_lost, own_new, blob in zip(left["a"].tolist(), left["slots"], left["n_lost"].tolist(), left["n_new"].tolist(), left["diff"], strict=True):
        near = np.flatnonzero((slots == np.frombuffer(own, np.uint16)).sum(axis=1) >= least_equal)
        if (reps[near] == rep).all():  # only a block of equal parts holds the asking member itself
            continue
        diff = unpack(blob, True)
        if len(near) <= 32:
            both = np.array([np.isin(diffs[k], diff, assume_unique=True).sum() for k in near.tolist()], np.int64)
        else:
            lo, hi = np.searchsorted(flat, diff), np.searchsorted(flat, diff, side="right")
            total = np.zeros(len(reps), np.int64)
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                total[holder[x:y]] += 1
            both = total[near]
        common = n - own_lost - lost[near] + both
        union = 2 * n - own_lost - lost[near] + own_new + new[near] - common
        for other in reps[near[100 * common >= percent * union]].tolist():
            p, q = root(rep), root(other)
            if p != q:
                parent[p] = q
                links.append((rep, other))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def families(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, least_equal: int, splits: int | None = None) -> DataFrame:
    """The links (u, v) within each hub's members that the links to the hub leave out. pairs: what `compared` gives."""
    splits = SPLITS if splits is None else splits
    shape = "u long, v long"
    open_ = pairs.groupBy("b").agg(F.count("*").alias("n"), F.min("linked").alias("all")).filter("n > 1 and not all").drop("all")
    wide = hottest(open_, "b", FAMILY)
    rows = join_salted(pairs, open_.withColumnRenamed("n", "members"), "b", wide, "a")
    small = rows.filter(F.col("members") <= FAMILY).join(classes.select(F.col("rep").alias("a"), "slots"), "a")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if "x" not in frame:
            frame = pd.concat([frame[~frame["linked"]].assign(asks=True), frame.assign(asks=False)])
        if frame["asks"].all() or not frame["asks"].any():
            return pd.DataFrame(columns=["u", "v"], dtype="int64")
        return family(frame, percent, least_equal)

    links = small.groupBy("b").applyInPandas(run, shape)
    large = rows.filter(F.col("members") > FAMILY)
    if not wide:
        return links
    if splits:
        apart = regrouped(large, percent)
        closer = checkpoint(compared(apart, sets, percent), apart.count())
        direct = closer.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return links.union(direct).union(families(closer, classes, sets, percent, least_equal, splits - 1))
    large = large.join(classes.select(F.col("rep").alias("a"), "slots"), "a").withColumn("parts", F.ceil(F.col("members") / FAMILY).cast("int"))
    large = large.withColumn("part", F.pmod(F.xxhash64("a", F.lit(5)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    asks = large.filter("not linked").select("*", other).select(F.col("part").alias("x"), F.col("other").alias("y"), *large.columns, F.lit(True).alias("asks"))
    told = large.select("*", other).select(F.col("other").alias("x"), F.col("part").alias("y"), *large.columns, F.lit(False).alias("asks"))
    return links.union(asks.union(told).groupBy("b", "x", "y").applyInPandas(run, shape))


def regrouped(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a hub and new hubs, such that two members that are linked, one of which isn't to the
    old hub, have a new one in common or one is the other's.

    d being how many differences a set has to the hub, and k = (100 - percent) / (100 + percent), two linked sets share at
    least (d + d' - k * (size + size')) / 2 differences. As d > k * (size + hub's size) for a set not linked to the hub,
    that is more than half of what `least` takes here for either. In an order of the differences that all members of a hub share,
    rare ones first, the first d - least + 1 of both then have one in common.
    """
    k = (100 - percent) / (100 + percent)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = (frame["n_lost"] + frame["n_new"]).to_numpy(np.int64)
            n = frame["n"].to_numpy(np.int64)
            size = n - frame["n_lost"].to_numpy(np.int64) + frame["n_new"].to_numpy(np.int64)
            bound = np.where(frame["linked"].to_numpy(bool), d - k * np.maximum(0, size - n), d - k * (size + n)) / 2
            most = d - np.maximum(1, np.ceil(bound - 1e-9).astype(np.int64)) + 1
            for lo in range(0, len(frame), 64):
                part = frame.iloc[lo : lo + 64]
                diffs = [unpack(x, True).view(np.int64) for x in part["diff"]]
                at = np.repeat(np.arange(lo, lo + len(part)), [len(x) for x in diffs])
                yield pd.DataFrame({"a": frame["a"].to_numpy()[at], "b": frame["b"].to_numpy()[at], "asks": ~frame["linked"].to_numpy(bool)[at], "d": d[at], "most": most[at], "diff": np.concatenate(diffs)})

    each = checkpoint(rows.select("a", "b", "linked", "n", "n_lost", "n_new", "diff").mapInPandas(spread, "a long, b long, asks boolean, d long, most long, diff long"))
    count = each.count()
    often = checkpoint(each.groupBy("b", "diff").agg(F.count("*").alias("held"), F.max("asks").alias("asked")).filter("held > 1 and asked").drop("asked"), count)
    shared = each.join(often, ["b", "diff"])
    by_member = Window.partitionBy("b", "a")
    # differences that no other member has, or only linked ones have, come first and lead nowhere
    place = F.row_number().over(by_member.orderBy("held", "diff")) + F.col("d") - F.count("*").over(by_member)
    kept = checkpoint(shared.withColumn("place", place).filter("place <= most").select("b", "diff", "a", "asks"), count)
    hub = checkpoint(kept.groupBy("b", "diff").agg(F.min(F.when(F.col("asks"), F.col("a"))).alias("hub"), F.count("*").alias("held")).filter("hub is not null and held > 1").drop("held"), count)
    return checkpoint(kept.join(hub, ["b", "diff"]).filter("a <> hub").select("a", F.col("hub").alias("b")).distinct(), count)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 16, rows: int = 4, least_equal: int = 36, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for each row of `docs`.

    Texts are lower-cased (A-Z) and split at ASCII white space. class_id is the least id with the same shingle set,
    component_id the least id that links lead to. Texts without words are linked with nothing: both are their own id.
    Repeated rows give repeated results. Rows without an id get no class, and link nothing.
    """
    sketched = checkpoint(sketch(small_batches(docs), size, bands, rows, id_col, text_col))
    named = sketched.filter("n_shingles > 0 and doc_id is not null")
    count = named.count()
    classes = checkpoint(named.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.min_by("slots", "doc_id").alias("slots"), F.min_by("keys", "doc_id").alias("keys")), count)
    pairs = checkpoint(first_pairs(classes, bands * count), bands * count)
    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for frame in frames:
            sets = word_sets(list(frame["text"]), size, words)
            names = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            same = [n == ((a & 0xFFFFFFFFFFFFFFFF) << 64 | b & 0xFFFFFFFFFFFFFFFF) for n, a, b in zip(names, frame["set1"].tolist(), frame["set2"].tolist(), strict=True)]
            short = [pack(np.unique(x >> np.uint64(16)), True) if s else None for x, s in zip(sets, same, strict=True)]
            yield pd.DataFrame({"rep": frame["rep"], "set": short}).dropna()

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    wanted = classes.select("rep", "set1", "set2").join(needed, "rep")
    sets = checkpoint(texts.join(wanted, "rep").mapInPandas(gather, "rep long, set binary").dropDuplicates(["rep"]), 20 * count)  # large rows
    against = checkpoint(compared(pairs, sets, percent), bands * count)
    links = against.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")).union(families(against, classes, sets, percent, least_equal))
    label = components(links, bands * count).withColumnRenamed("node", "rep")
    label = classes.select("set1", "set2", "rep").join(label, "rep", "left")
    found = sketched.join(label, ["set1", "set2"], "left")
    live = F.col("n_shingles") > 0
    out = found.select("doc_id", "n_shingles", F.when(live & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(live & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
