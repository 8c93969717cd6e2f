"""Suffix-array dedup: bytes of repeated passages are removed from all documents but the first.

A byte goes if it lies in a window of `width` bytes that also starts in a document with a smaller id. Windows are
judged on the input. How it scales:

* Every window has one anchor: its `gram`-byte substring with the least hash (winnowing). Equal windows have equal
  anchors, so the windows of one anchor, a *span* of text, are judged together and independently of all others.
* Documents live in buckets of about `bucket_bytes` by a hash of their id; without it, of 8 MB, and of up to 64 MB where
  that makes more than 50,000 buckets. Per bucket, each anchor hash goes out once,
  with the least document id, however many copies the bucket holds. That is the pre-aggregation for hot passages.
* Spans of anchors that occur in one document only can't repeat and never leave their bucket. Of the others each
  distinct span goes out once per bucket.
* Per anchor, spans are trimmed to what agrees with any other span; the distinct strings that are left go through the
  linear grouping suffix array, whose neighbours give the classes of equal windows and so the first document of each.

Defined results: null text counts as empty; a text shorter than `width` loses nothing; rows with equal ids count as
the same document; a null id comes after all others; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, mix, pack, unpack
from .suffix_array import window_classes

#: Documents are hashed in batches of about so many bytes, which bounds the temporary arrays.
BATCH = 1 << 20
#: Candidate strings of about so many bytes share one suffix array.
SORTED_AT_ONCE = 1 << 16


class Runs:
    """The spans of one batch of texts: consecutive windows that have the same anchor."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.buffer = b"".join(texts)
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        n = len(self.buffer)
        none = np.empty(0, np.int64)
        self.first = self.last = self.anchor = self.text = none
        self.hash = np.empty(0, np.uint64)
        if n < width:
            return
        raw = np.frombuffer(self.buffer + bytes(8), np.uint8)
        grams = np.zeros(n - gram + 1, np.uint64)
        for k in [*range(0, gram - 8, 8), gram - 8]:
            word = np.ndarray((len(grams),), "<u8", raw, k, (1,))
            grams = mix((grams + word) * np.uint64(0x9E3779B97F4A7C15))
        low = np.uint64((1 << max(1, n.bit_length())) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        reach, span = 1, width - gram + 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: -(span - reach)], least[span - reach :])
        anchor = (least & low).astype(np.int64)
        inside = np.repeat(self.ends, self.lengths)[: len(anchor)] >= np.arange(len(anchor)) + width
        anchor[~inside] = -1
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([edge[1:], [len(anchor)]]) - 1
        kept = anchor[edge] >= 0
        self.first, self.last = edge[kept], last[kept]
        self.anchor = anchor[self.first]
        self.hash = mix(~grams[self.anchor])  # least hashes are small; these spread evenly
        self.text = np.searchsorted(self.ends, self.first, side="right")


def batches(ids: np.ndarray, texts: list) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    lo = held = 0
    coded: list[bytes] = []
    for k, text in enumerate(texts):
        coded.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(coded[-1])
        if held >= BATCH:
            yield ids[lo : k + 1], coded
            lo, held, coded = k + 1, 0, []
    if coded:
        yield ids[lo:], coded


def member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, and the least and largest value of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if not len(at):
        return keys, values, values
    return keys[at], np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)


def common_lengths(heads: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each byte row, the longest prefix that it shares with any other row of the same head."""
    joined = np.concatenate([heads.astype(">u8").view(np.uint8).reshape(-1, 8), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(joined).view(f"V{joined.shape[1]}").reshape(-1).view(f"S{joined.shape[1]}"), kind="stable")
    near = joined[order]
    differs = near[1:] != near[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), joined.shape[1]) - 8
    shared = np.maximum(shared, 0)
    best = np.zeros(len(rows), np.int64)
    best[order[1:]] = shared
    best[order[:-1]] = np.maximum(best[order[:-1]], shared)
    return best


def judge(hashes: np.ndarray, spans: list[bytes], left: np.ndarray, first_doc: np.ndarray, width: int, gram: int) -> dict[int, list[tuple[int, int, int]]]:
    """For spans with windows that also start in a document before the span's own first one: runs of windows as (offset
    of the first, number, document).

    The windows of an anchor are told apart by more of their bytes before they are sorted: those that start well before
    the anchor by the bytes ahead of it, the others by the bytes that follow it. Spans with a common anchor thus part
    into small groups, unless they really have windows in common.
    """
    longest = width - gram
    half = longest // 2
    owner: list[int] = []
    base: list[int] = []
    early: list[bool] = []
    parts: list[bytes] = []
    for k, (head, span, at) in enumerate(zip(hashes.tolist(), spans, left.tolist(), strict=True)):
        cut = max(0, at - half + 1)
        if at >= half:
            owner.append(k)
            base.append(0)
            early.append(True)
            parts.append(b"<" + head.to_bytes(8) + span[at - half : at])
        if len(span) - cut >= width:
            owner.append(k)
            base.append(cut)
            early.append(False)
            parts.append(b">" + head.to_bytes(8) + span[at + gram : at + width - half + 1])
    heads = np.array([xxhash.xxh3_64_intdigest(x) for x in parts], np.uint64)
    _, group, counts = np.unique(heads, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(counts[group] > 1)
    if not len(pick):
        return {}
    hashes, owner_, base_ = heads[pick], np.array(owner)[pick], np.array(base)[pick]
    left = left[owner_] - base_
    spans = [spans[k][: at - half + width] if early[j] else spans[k][lo:] for j, k, lo, at in zip(pick.tolist(), owner_.tolist(), base_.tolist(), left.tolist(), strict=True)]
    lengths = np.array([len(x) for x in spans], np.int64)
    flat = np.frombuffer(bytes(width) + b"".join(spans) + bytes(width), np.uint8)
    anchor = np.concatenate([[0], np.cumsum(lengths)])[:-1] + width + left
    right = np.minimum(lengths - left, width)
    ahead = flat[anchor[:, None] + np.arange(width)]
    ahead[np.arange(width) >= right[:, None]] = 0
    behind = flat[anchor[:, None] - 1 - np.arange(longest)] if longest else np.empty((len(spans), 0), np.uint8)
    behind[np.arange(longest) >= left[:, None]] = 0
    after = np.minimum(common_lengths(hashes, ahead), right)
    before = np.minimum(common_lengths(hashes, behind), left)
    strings: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k in np.flatnonzero(after + before >= width).tolist():
        lo = int(left[k] - before[k])
        strings.setdefault((int(hashes[k]), spans[k][lo : int(left[k] + after[k])]), []).append((k, lo))
    first_of = first_doc[owner_]
    found: dict[int, list[tuple[int, int, int]]] = {}
    texts: list[bytes] = []
    owners: list[list[tuple[int, int]]] = []

    def flush() -> None:
        number, offset, kind = window_classes(texts, width)
        if len(kind):
            docs = np.array([min(first_of[k] for k, _ in x) for x in owners], np.int64)
            best = np.full(int(kind.max()) + 1, NO_ID, np.int64)
            np.minimum.at(best, kind, docs[number])
            order = np.lexsort([offset, number])
            number, offset, doc = number[order], offset[order], best[kind[order]]
            edge = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])]))
            count = np.diff(np.concatenate([edge, [len(doc)]]))
            for t, o, n, d in zip(number[edge].tolist(), offset[edge].tolist(), count.tolist(), doc[edge].tolist(), strict=True):
                for k, lo in owners[t]:
                    if d < first_of[k]:
                        found.setdefault(int(owner_[k]), []).append((int(base_[k]) + lo + o, n, d))
        texts.clear()
        owners.clear()

    held = 0
    for (_, text), who in sorted(strings.items()):  # the strings of an anchor stand together
        if held >= SORTED_AT_ONCE and _ != at:
            flush()
            held = 0
        at = _
        texts.append(text)
        owners.append(who)
        held += len(text) + 1
    if texts:
        flush()
    return found


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 20, bucket_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 for each row of `docs`."""
    if not 8 <= gram <= width:
        raise ValueError("8 <= gram <= width is needed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (bucket_bytes or min(64 << 20, max(8 << 20, total // 50_000)))))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    shift = np.uint64(32)

    def place(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> shift) * np.uint64(n) >> shift).astype(np.int64)

    def key(ids: pd.Series) -> np.ndarray:
        return ids.astype("Int64").fillna(NO_ID).to_numpy(np.int64)

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(r.hash, ids[r.text]) for ids, texts in batches(key(pdf["doc_id"]), list(pdf["text"])) for r in [Runs(texts, width, gram)]]
        hashes, least, most = least_by(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        cut = np.searchsorted(place(hashes), np.arange(n + 1))
        b = int(pdf["b"].iloc[0])
        return pd.DataFrame([(h, b, pack(hashes[lo:hi], True), pack(least[lo:hi]), pack(least[lo:hi] != most[lo:hi])) for h, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if hi > lo], columns=["h", "b", "hashes", "docs", "several"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack(x, True) for x in pdf["hashes"]]
        docs_ = [unpack(x).astype(np.int64) for x in pdf["docs"]]
        several = [unpack(x).astype(bool) for x in pdf["several"]]
        keys, least, most = least_by(np.concatenate(hashes), np.concatenate(docs_))
        repeated = np.union1d(keys[least != most], np.concatenate([x[y] for x, y in zip(hashes, several, strict=True)]))
        out = [(b, x[member(x, repeated)]) for b, x in zip(pdf["b"], hashes, strict=True)]
        return pd.DataFrame([(b, pack(x, True)) for b, x in out if len(x)], columns=["b", "hashes"])

    def spans(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, list[int]] = {}
        repeated = np.sort(np.concatenate([unpack(x, True) for x in answer["hashes"]])) if len(answer) else np.empty(0, np.uint64)
        for ids, texts in batches(key(pdf["doc_id"]), list(pdf["text"])) if len(repeated) else ():
            r = Runs(texts, width, gram)
            k = np.flatnonzero(member(r.hash, repeated))
            for h, lo, hi, a, doc in zip(r.hash[k].tolist(), r.first[k].tolist(), (r.last[k] + width).tolist(), r.anchor[k].tolist(), ids[r.text[k]].tolist(), strict=True):
                text = r.buffer[lo:hi]
                known = found.get(text)
                if known is None:
                    found[text] = [h, a - lo, doc]
                elif doc < known[2]:
                    known[2] = doc
        if not found:
            return pd.DataFrame(columns=["h", "b", "hashes", "left", "docs", "lengths", "spans"])
        texts = list(found)
        facts = np.array([(x[0], x[1], x[2] & 0xFFFF_FFFF_FFFF_FFFF) for x in found.values()], np.uint64)  # ids may be negative
        order = np.argsort(facts[:, 0], kind="stable")
        facts = facts[order]
        cut = np.searchsorted(place(facts[:, 0]), np.arange(n + 1))
        b = int(pdf["b"].iloc[0])
        rows_ = []
        for h, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
            if hi > lo:
                own = [texts[k] for k in order[lo:hi]]
                rows_.append((h, b, pack(facts[lo:hi, 0], True), pack(facts[lo:hi, 1]), pack(facts[lo:hi, 2]), pack(np.array([len(x) for x in own])), zstandard.ZstdCompressor(level=1).compress(b"".join(own))))
        return pd.DataFrame(rows_, columns=["h", "b", "hashes", "left", "docs", "lengths", "spans"])

    def verdicts(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([unpack(x, True) for x in pdf["hashes"]])
        left = np.concatenate([unpack(x).astype(np.int64) for x in pdf["left"]])
        docs_ = np.concatenate([unpack(x).astype(np.int64) for x in pdf["docs"]])
        sizes = [unpack(x).astype(np.int64) for x in pdf["lengths"]]
        number: dict[bytes, int] = {}
        which = np.empty(len(hashes), np.int64)
        k = 0
        for blob, lengths in zip(pdf["spans"], sizes, strict=True):
            at, blob = 0, zstandard.ZstdDecompressor().decompress(blob)
            for size in lengths.tolist():
                which[k] = number.setdefault(blob[at : at + size], len(number))
                at += size
                k += 1
        texts = list(number)
        first_doc = np.full(len(texts), NO_ID, np.int64)
        np.minimum.at(first_doc, which, docs_)
        one = np.empty(len(texts), np.int64)
        one[which] = np.arange(len(which))
        heads, lefts = hashes[one], left[one]
        keys, counts = np.unique(heads, return_counts=True)
        many = np.flatnonzero(counts[np.searchsorted(keys, heads)] > 1)  # an anchor's only span has nothing to be sorted with
        earlier: dict[int, list[tuple[int, int, int]]] = {}
        if len(many):
            judged = judge(heads[many], [texts[j] for j in many], lefts[many], first_doc[many], width, gram)
            earlier = {int(many[s]): runs for s, runs in judged.items()}
        names = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64)
        out, at = [], 0
        for b, lengths in zip(pdf["b"], sizes, strict=True):
            own, head = which[at : at + len(lengths)], hashes[at : at + len(lengths)]
            at += len(lengths)
            order = np.argsort(names[own])
            more = np.array([(j, *run) for j, s in enumerate(own[order].tolist()) for run in earlier.get(s, ())], np.int64).reshape(-1, 4)
            out.append((b, pack(head, True), pack(names[own[order]], True), pack(first_doc[own[order]]), *(pack(more[:, c]) for c in range(4))))
        return pd.DataFrame(out, columns=["b", "hashes", "names", "docs", "more_span", "more_at", "more_n", "more_doc"])

    def removed(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        every = [[unpack(x, c in ("hashes", "names")) for x in answer[c]] for c in answer.columns if c != "b"]
        base = np.cumsum([0, *(len(x) for x in every[1])])
        empty = np.empty(0, np.uint64)
        hashes = np.sort(np.concatenate([empty, *every[0]]))
        names = np.concatenate([empty, *every[1]])
        first = np.concatenate([empty, *every[2]]).astype(np.int64)
        more: dict[int, list[tuple[int, int, int]]] = {}
        for add, *runs in zip(base, *every[3:], strict=False):
            for s, *run in zip(*(x.astype(np.int64).tolist() for x in runs), strict=True):
                more.setdefault(int(add) + s, []).append(tuple(run))
        order = np.argsort(names, kind="stable")
        names = names[order]
        out: list[tuple] = []
        for ids, texts in batches(key(pdf["doc_id"]), list(pdf["text"])):
            gone = np.zeros(int(sum(map(len, texts))) + 1, np.int32)
            if len(hashes):
                r = Runs(texts, width, gram)
                k = np.flatnonzero(member(r.hash, hashes))
                own = np.fromiter((xxhash.xxh3_64_intdigest(r.buffer[lo:hi]) for lo, hi in zip(r.first[k].tolist(), (r.last[k] + width).tolist(), strict=True)), np.uint64, len(k))
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                ok = names[at] == own
                k, at = k[ok], order[at[ok]]
                doc = ids[r.text[k]]
                whole = first[at] < doc
                np.add.at(gone, r.first[k[whole]], 1)
                np.add.at(gone, r.last[k[whole]] + width, -1)
                for j in np.flatnonzero(~whole).tolist():
                    for offset, count, earlier in more.get(int(at[j]), ()):
                        if earlier < doc[j]:
                            gone[r.first[k[j]] + offset] += 1
                            gone[r.first[k[j]] + offset + count - 1 + width] -= 1
            covered = np.cumsum(gone[:-1]) > 0
            lo = 0
            for text in texts:
                cut = covered[lo : lo + len(text)]
                lo += len(text)
                n_gone = int(cut.sum())
                kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if n_gone else text
                out.append((len(text), n_gone, int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest()))
        result = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        result.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(object))
        return result

    by_bucket = rows.groupBy("b")
    hits = by_bucket.applyInPandas(anchors, "h int, b int, hashes binary, docs binary, several binary")
    hits = hits.groupBy("h").applyInPandas(shared, "b int, hashes binary")
    parts = by_bucket.cogroup(hits.groupBy("b")).applyInPandas(spans, "h int, b int, hashes binary, left binary, docs binary, lengths binary, spans binary")
    answers = parts.groupBy("h").applyInPandas(verdicts, "b int, hashes binary, names binary, docs binary, more_span binary, more_at binary, more_n binary, more_doc binary")
    return by_bucket.cogroup(answers.groupBy("b")).applyInPandas(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
