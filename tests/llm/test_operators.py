"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import string
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tesselle.llm import chat, langid, media, minhash, mixing, toxicity, urls
from tesselle.llm.components import components
from tesselle.llm import decontaminate
from tesselle.llm.decontaminate import find_contamination
from tesselle.llm.exact_substring import remove_repeats
from tesselle.llm.line_dedup import blocks, dedup_lines, patience
from tesselle.llm.minhash import near_duplicates, signatures
from tesselle.llm.queries import URL_RULES
from tesselle.llm.suffix_array import suffix_array

WORDS = [f"w{k}" for k in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def texts(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared, base = say(30), [r.choice(WORDS) for _ in range(80)]
    rows = [None, "", "  \n ", "one", "one two", "one two", say(4000), "aaaa" * 60, "aaaa" * 70]
    rows += [say(20) + " " + shared + " " + say(15) for _ in range(8)]
    for _ in range(12):
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(80)] = r.choice(WORDS)
        rows.append(" ".join(copy))
    rows += [rows[-1]] * 3
    return [(k, t, "en" if k % 2 else None, f"s{k % 4}" if k % 4 else None, len(t or ""), "x") for k, t in enumerate(rows)]


def test_suffix_array():
    r = random.Random(3)
    for _ in range(800):
        a = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_array(a) == sorted(range(len(a)), key=lambda i: a[i:])


@pytest.mark.parametrize("bucket", [400, 1 << 20])
def test_remove_repeats(spark, bucket):
    rows = texts()
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, DOCS), bucket_bytes=bucket).collect()}
    seen: set[bytes] = set()
    for k, text, *_ in rows:
        raw = (text or "").encode()
        own = [raw[p : p + 50] for p in range(len(raw) - 49)]
        gone = {p + j for p, w in enumerate(own) if w in seen for j in range(50)}
        seen.update(own)
        kept = bytes(c for p, c in enumerate(raw) if p not in gone)
        runs = sum(p - 1 not in gone for p in gone)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept), got[k].kept_sha256) == (len(raw), len(gone), runs, kept, hashlib.sha256(kept).hexdigest())


def brute_components(rows, size, percent):
    sets = {}
    for k, text, *_ in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets[k] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


@pytest.mark.parametrize("part", [3, 256])
def test_near_duplicates(spark, part, monkeypatch):
    monkeypatch.setattr(minhash, "PART", part)
    rows, r = texts(), random.Random(21)
    base = [r.choice(WORDS) for _ in range(120)]
    for k in range(40):  # a bucket of many near copies, whose hub comes from parts
        copy = list(base)
        copy[r.randrange(120)] = r.choice(WORDS)
        rows.append((100 + k, " ".join(copy), None, None, 0, "x"))
    sets, label = brute_components(rows, 3, 85)
    got = near_duplicates(spark.createDataFrame([*rows, rows[3], (None, "one two", None, None, 0, "x")], DOCS), 3, 85).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], r.doc_id == label[r.doc_id])


@pytest.mark.parametrize(("size", "splits"), [(1024, 4), (4, 4), (4, 0)])
def test_families(spark, size, splits):
    """Members that are unlike their hub, in groups of their own, in one task, split by differences, and in blocks."""
    rng = np.random.default_rng(9)
    value = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    own = {0: {*range(100)}}
    for k in range(1, 9):
        own[2 * k] = {*range(50), *range(100 * k + 100, 100 * k + 150)}
        own[2 * k + 1] = own[2 * k] - {0} | {100 * k + 190}
    for k in range(100, 140):  # near copies of the hub and of a set that isn't linked to it, with some changes each
        base = own[0] if k % 2 else own[2]
        away = set(rng.choice(sorted(base), int(rng.integers(1, 14)), replace=False).tolist())
        own[k] = base - away | set(rng.integers(2000, 2300, int(rng.integers(0, 8))).tolist())
    sets = {k: np.sort(value[sorted(x)]) for k, x in own.items()}
    slots = [(x >> np.uint64(48)).astype(np.uint16).tobytes() for x in minhash.mix(signatures(list(sets.values()), 64))]
    classes = spark.createDataFrame(list(zip(sets, slots, strict=True)), "rep long, slots binary")
    short = spark.createDataFrame([(k, minhash.pack(np.unique(x >> np.uint64(16)), True)) for k, x in sets.items()], "rep long, set binary")
    pairs = spark.createDataFrame([(k, 0) for k in own if k], "a long, b long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash, "FAMILY", size)
        patch.setattr(minhash, "SPLITS", splits)
        against = minhash.compared(pairs, short, 85)
        got = minhash.families(against, classes, short, 85, 0).collect() + [(x.a, x.b) for x in against.filter("linked").collect()]
    true = {frozenset((a, b)) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    assert {frozenset(x) for x in got} <= true and len(true) > 150

    def groups(links):
        label = {k: k for k in own}
        for _ in own:
            for x in links:
                u, v = x
                label[u] = label[v] = min(label[u], label[v])
        return label

    assert groups([tuple(x) for x in got]) == groups([tuple(x) for x in true])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    s = signatures([a, a[100:], a[:1], a[:0]], 256)
    assert abs((s[0] == s[1]).mean() - 0.9) < 0.07
    assert (s[2] < np.uint64(256 << 32)).all() and (s[3] == np.uint64((1 << 64) - 1)).all()


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (20, 9), (20, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8, 30: 8}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_chat(rows):
    """(conv_id, turns, copies, text) of the conversations that are no prefix of another one."""
    low = lambda v: (v is not None, v or 0 if not isinstance(v, str) else v)
    own, alone = {}, []
    for c, *turn in sorted(rows, key=lambda x: tuple(map(low, x[1:2])) + tuple((v is not None, v or "") for v in x[2:4])):
        if c is None:
            alone.append((None, [tuple(turn[1:3])]))
        else:
            own.setdefault(c, []).append(tuple(turn[1:3]))
    every = [*own.items(), *alone]
    whole = {}
    for c, turns in every:
        whole.setdefault(tuple(turns), []).append(c)
    out = []
    for turns, ids in whole.items():
        if not any(len(x) > len(turns) and x[: len(turns)] == turns for x in whole):
            text = "\n".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>" for r, t in turns)
            out.append((min((c for c in ids if c is not None), default=None), len(turns), len(ids), text))
    return out


def test_chat(spark):
    talk = [("a", "x"), ("b", "y"), ("a", "z")]
    rows = [(c, t, *m) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t, m in enumerate(talk[:n])] + [(5, 0, "b", "x"), (6, 0, None, None), (None, 0, "a", "q"), (None, 0, "a", "q"), (None, 1, "a", "x")]
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 5, 6, None} and got[3][:2] == (3, 2) and got[None][:2] == (1, 2)
    assert got[6][2] == "<|im_start|>unknown\n<|im_end|>"


def test_chat_is_the_brute_force_collapse(spark):
    """Ties, repeated rows, null turns, roles and texts, rows without an id, a long text, and columns that clash."""
    r = random.Random(13)
    rows = []
    for c in range(60):
        start = r.randrange(3)
        for t in range(r.randrange(1, 6)):
            rows.append((c, r.choice([t, t, None]) if c % 9 == 0 else t, r.choice(["user", "user", None]), f"{start} {t}" if r.random() < 0.9 else None))
    rows += r.choices(rows, k=4) + [(None, r.randrange(2), "user", f"{r.randrange(3)} 0") for _ in range(9)] + [(99, 0, "user", "long " * 50_000)]
    columns = "conv_id long, turn long, role string, text string, pos int, part long, copies long"
    got = chat.format_conversations(spark.createDataFrame([(*x, 1, 2, 3) for x in rows], columns))
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, brute_chat(rows)))
    assert chat.format_conversations(spark.createDataFrame([], columns)).count() == 0


def test_urls(spark):
    rows = ["HTTP://Example.COM/en/1", "http://www.example.com/en/1?q", "http://a.net/fr/#x", "http://a.net", "nothing", None, "http://x.org/en/"]
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.rule, r.verdict) for r in got] == [("example.com", "example.com/en/", "block"), ("www.example.com", "www.example.com/en/", "allow"), ("a.net", "net/fr/", "block"), ("a.net", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("x.org", None, "allow")]


@pytest.mark.parametrize("block", [7, 1000])
def test_urls_are_judged_as_by_brute_force(spark, block):
    """Random rules in one trie and in several, against all rules one by one; clashing columns, repeated rows, a long URL."""
    r = random.Random(14)
    labels, segments = ["a", "b", "com", "net"], ["", "x", "xy", "y"]
    host = lambda: ".".join(r.choices(labels, k=r.randrange(1, 4)))
    path = lambda: "".join("/" + r.choice(segments) for _ in range(r.randrange(4)))
    rules = [(r.choice(["allow", "block"]), r.choice(["", host(), host()]), path()) for _ in range(40)]
    pages = [(k, f"http://{host()}{path()}{r.choice(['', '?q', '#x'])}") for k in range(300)] + [(None, "x://com/x"), (7, "x://com"), (7, "x://com"), (8, "x://a.com/" + "xy/" * 50_000), (9, ""), (10, None)]

    def judged(url):
        if not url or "://" not in url:
            h = p = ""
        else:
            rest = url.split("://", 1)[1]
            h = rest.split("/")[0].split("?")[0].split("#")[0]
            p = rest[len(h) :].split("?")[0].split("#")[0]
        fits = [(len(rh), len(rp), v == "block", rh + rp) for v, rh, rp in rules if (not rh or h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fits, default=None)
        return (h, p, None, "allow") if best is None else (h, p, best[3], "block" if best[2] else "allow")

    got = urls.filter_urls(spark.createDataFrame([(*x, "h", "p", "r", 1) for x in pages], "page_id long, url string, host string, path string, rule string, of_host int"), rules, block_rules=block)
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(str((k, *judged(url))) for k, url in pages)
    assert urls.filter_urls(got.sparkSession.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert {(x.rule, x.verdict) for x in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), [], "block").collect()} == {(None, "block")}


def test_media(spark):
    rows = texts()
    odd = [(99, "é" * 40000), (None, "a text"), (98, "twice"), (98, "twice")]
    df = spark.createDataFrame([(k, x, "m", 1) for k, x, *_ in rows] + [(*x, "m", 1) for x in odd], "doc_id long, text string, media string, n_bytes int")
    got = media.digest(media.read_media(media.write_media(df))).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        raw = ({k: t for k, t, *_ in rows} | dict(odd))[r.doc_id] or ""
        raw = raw.encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.rgb_bytes == 3 * r.height * r.width and r.error is None
    assert media.digest(media.read_media(media.write_media(df.limit(0)))).count() == 0


def test_media_that_cannot_be_read(spark):
    """Null, broken, cut and baseline files have an error and null results; the others go on."""
    whole = media.write_jpeg(b"some text".ljust(128, b"\0"))
    files = [None, b"", b"\xff\xd8", whole[:200], whole[:-2], whole.replace(b"\xff\xc2", b"\xff\xc0"), whole.replace(b"\x08\x00\x10", b"\x08\xff\xff"), whole.replace(b"\xff\xdb", b"\xff\xee"), whole]
    df = spark.createDataFrame([(k if k else None, 9, x, "e") for k, x in enumerate(files)], "doc_id long, n_bytes long, media binary, error string")
    got = sorted(media.digest(media.read_media(df)).collect(), key=lambda x: x.doc_id or 0)
    assert [x.error is None for x in got] == [False] * 8 + [True]
    assert all(x.payload_sha256 is None and x.feature is None for x in got[:-1]) and got[-1].payload_bytes == 128
    assert got[0].media_bytes is None and got[5].media_bytes == len(whole)


class Encoder:
    """Progressive scans of any coefficients, code by code: the symbols used get codes of 9 bits each."""

    def __init__(self):
        self.parts = []

    def symbol(self, x):
        self.parts.append((x, None))

    def bits(self, value, n):
        self.parts.append((value, n))

    def signed(self, v):
        n = abs(v).bit_length()
        self.bits(v if v > 0 else v + (1 << n) - 1, n)

    def flush(self, run, pending=()):
        if run:
            n = run.bit_length() - 1
            self.symbol(n << 4)
            self.bits(run - (1 << n), n)
            for bit in pending:
                self.bits(bit, 1)

    def first(self, blocks, first, last, low, longest):
        run = 0
        for block in blocks:
            zeros = 0
            for c in block[first : last + 1]:
                v = (abs(c) >> low) * (1 if c > 0 else -1)
                if not v:
                    zeros += 1
                    continue
                self.flush(run)
                run = 0
                while zeros > 15:
                    self.symbol(0xF0)
                    zeros -= 16
                self.symbol(zeros << 4 | abs(v).bit_length())
                self.signed(v)
                zeros = 0
            run += bool(zeros)
            if run == longest:
                self.flush(run)
                run = 0
        self.flush(run)

    def refine(self, blocks, first, last, low, longest):
        run, held = 0, []
        for block in blocks:
            size = [abs(c) >> low for c in block]
            final = max((k for k in range(first, last + 1) if size[k] == 1), default=-1)
            zeros, own = 0, []
            for k in range(first, last + 1):
                if not size[k]:
                    zeros += 1
                    continue
                while zeros > 15 and k <= final:
                    self.flush(run, held)
                    run, held = 0, []
                    self.symbol(0xF0)
                    for bit in own:
                        self.bits(bit, 1)
                    zeros, own = zeros - 16, []
                if size[k] > 1:
                    own.append(size[k] & 1)
                    continue
                self.flush(run, held)
                run, held = 0, []
                self.symbol(zeros << 4 | 1)
                self.bits(int(block[k] > 0), 1)
                for bit in own:
                    self.bits(bit, 1)
                zeros, own = 0, []
            if zeros or own:
                run, held = run + 1, held + own
                if run == longest:
                    self.flush(run, held)
                    run, held = 0, []
        self.flush(run, held)


def written(kind, streams, components, first, last, high, low):
    """A table and a scan of some streams, which are restart intervals."""
    used = sorted({x for s in streams for x, n in s.parts if n is None})
    out = []
    for s in streams:
        text = "".join(f"{used.index(x):09b}" if n is None else f"{x:0{n}b}" if n else "" for x, n in s.parts)
        text += "1" * (-len(text) % 8)
        out.append(int(text or "1", 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\0"))
    body = out[0] + b"".join(b"\xff" + bytes([0xD0 + k % 8]) + x for k, x in enumerate(out[1:]))
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return (media.huffman(kind, used, 9) if used else b"") + media.segment(0xDA, head) + body


@pytest.mark.parametrize(("height", "width", "interval"), [(37, 29, 0), (16, 48, 0), (37, 29, 2), (70, 41, 3), (8, 8, 1)])
def test_reader_reads_any_progressive_file(height, width, interval):
    """Random coefficients through an encoder of the general kind: scans of both sorts, several codes, runs, restarts."""
    rng = np.random.default_rng(height)
    layout = [(1, 2, 2), (2, 1, 1), (3, 1, 1)]
    columns, rows = -(-width // 16), -(-height // 16)
    want, own = [], []
    for _, h, v in layout:
        a = np.where(rng.random((columns * h * rows * v, 64)) < 0.15, rng.integers(-90, 91, (columns * h * rows * v, 64)), 0)
        a[:, 40:] = np.where(rng.random(a[:, 40:].shape) < 0.2, a[:, 40:], 0)
        a[rng.random(len(a)) < 0.3, 1:] = 0
        a[:, 0] = rng.integers(-200, 200, len(a))
        w, d = -(-width * h // 16), -(-height * v // 16)
        seen = [y * columns * h + x for y in range(d) for x in range(w)]
        outside = np.ones(len(a), bool)
        outside[seen] = False
        a[outside, 1:] = 0
        want.append(a)
        own.append(seen)
    units = [[[(r * v + y) * columns * h + c * h + x for y in range(v) for x in range(h)] for r in range(rows) for c in range(columns)] for _, h, v in layout]
    cut = lambda n: [(lo, min(n, lo + interval)) for lo in range(0, n, interval)] if interval else [(0, n)]
    data = [b"\xff\xd8", media.segment(0xDB, b"\0" + bytes(range(1, 65)))]
    data.append(media.segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in layout)))
    if interval:
        data.append(media.segment(0xDD, struct.pack(">H", interval)))
    for high, low in ((0, 1), (1, 0)):
        streams = []
        for lo, hi in cut(columns * rows):
            streams.append(Encoder())
            before = [0, 0, 0]
            for u in range(lo, hi):
                for c in range(3):
                    for block in units[c][u]:
                        value = int(want[c][block, 0]) >> low
                        if high:
                            streams[-1].bits(value & 1, 1)
                        else:
                            step, before[c] = value - before[c], value
                            streams[-1].symbol(abs(step).bit_length())
                            if step:
                                streams[-1].signed(step)
        data.append(written(0, streams, [1, 2, 3], 0, 0, high, low))
    for c in range(3):
        for first, last, high, low in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)):
            streams = []
            for lo, hi in cut(len(own[c])):
                streams.append(Encoder())
                (streams[-1].refine if high else streams[-1].first)([want[c][b].tolist() for b in own[c][lo:hi]], first, last, low, 5)
            data.append(written(1, streams, [c + 1], first, last, high, low))
    whole = b"".join([*data, b"\xff\xd9"])
    got = media.read_coefficients(whole)
    assert all((p["array"] == a).all() for p, a in zip(got[2], want, strict=True))
    rgb = media.to_rgb(*got[:3])
    zigzag = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    at = [(int(y), int(x)) for y, x in zip(rng.integers(0, height, 12), rng.integers(0, width, 12), strict=True)]
    for y, x in at:
        planes = []
        for (_, h, v), a in zip(layout, want, strict=True):
            py, px = y * v // 2, x * h // 2
            block = a[py // 8 * columns * h + px // 8]
            total = 128.0
            for k, place in enumerate(zigzag):
                f, g = divmod(place, 8)
                scale = (np.sqrt(0.125) if f == 0 else 0.5) * (np.sqrt(0.125) if g == 0 else 0.5)
                total += scale * block[k] * (k + 1) * np.cos((2 * (py % 8) + 1) * f * np.pi / 16) * np.cos((2 * (px % 8) + 1) * g * np.pi / 16)
            planes.append(min(255, max(0, round(total))))
        l, b, r = planes[0], planes[1] - 128, planes[2] - 128
        exact = [l + 1.402 * r, l - 0.344136 * b - 0.714136 * r, l + 1.772 * b]
        assert all(abs(min(255, max(0, e)) - g) <= 3 for e, g in zip(exact, rgb[y, x].tolist(), strict=True))


def test_reader_code_by_code():
    """A file with zeros, runs and several codes takes the general path: two blocks of one component."""
    bits = lambda text: np.array([int(c) for c in text.replace(" ", "")], np.uint8)
    head = b"\xff\xd8" + media.segment(0xDB, b"\0" + b"\1" * 64) + media.segment(0xC2, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00")
    dc = media.huffman(0, [2, 3], 2) + media.scan([1], 0, 0, 0, 0, bits("00 11  00 00"))  # 3, then 3 - 3
    ac = media.huffman(1, [0x12, 0x00, 0x01], 2) + media.scan([1], 1, 63, 0, 1, bits("00 10 10 1 01  10 0 01"))  # a zero, 2, then 1, end; -1, end
    fine = media.huffman(1, [0x01, 0x00], 2) + media.scan([1], 1, 63, 1, 0, bits("00 1 01 1 0  01 1"))  # new 1 at 1, end with 2 corrections; end
    _, _, parts, _ = media.read_coefficients(head + dc + ac + fine + b"\xff\xd9")
    a = parts[0]["array"]
    assert a[0, :5].tolist() == [3, 1, 5, 2, 0] and a[1, :3].tolist() == [0, -3, 0]


def test_mixing(spark):
    rows = texts()
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    size = {k: len((t or "").split()) for k, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    names = [*sorted({s for s in source.values() if s}), None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    whole = {s: sum(size[k] for k in size if source[k] == s) for s in names}
    left, open_, want = 1.5 * sum(whole.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * whole[s]}
        for s in full or open_:
            want[s] = 2 * whole[s] if full else weight[s] * level
            left -= want[s] if full else 0
        open_ = open_ - full if full else set()
    for r in got:
        assert r.size == size[r.doc_id] and abs(r.target - want[source[r.doc_id]]) < 1e-3 and 0 <= r.taken <= 2 * r.size
    for s in names:
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - want[s]) <= 1
    assert sorted(got) == sorted(mixing.mix_sources(spark.createDataFrame(rows[::-1], DOCS)).collect())
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_decontamination(spark):
    r = random.Random(4)
    item = [r.choice(WORDS) for _ in range(30)]
    near = [*item[:28], "other", "end"]
    far = [w if k % 4 else "no" for k, w in enumerate(item)]
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    rows = [(0, " ".join(say(50) + item + say(50))), (1, " ".join(near)), (2, " ".join(say(9) + far)), (3, None), (4, ""), (5, " ".join(say(3000))), (6, "; ".join(item[:29]).upper()), (7, "q w e"), (8, " ".join(item + say(3) + item))]
    bench = [(7, " ".join(item)), (8, "q w e"), (9, None), (None, "x"), (10, "")]
    got = {x.doc_id: x for x in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {k for k, x in got.items() if x.contaminated} == {0, 1, 6, 7, 8}
    assert (got[0].item_id, got[0].similarity, got[7].item_id, got[8].n_windows >= 2) == (7, 1.0, 8, True)


def brute_contamination(docs, bench, size=5, least=0.8):
    """id: the similarities of all windows that reach the limit, by comparing every window with every item."""
    split = lambda x: x.lower().translate(str.maketrans({c: " " for c in string.punctuation})).split()
    bag = lambda w, n: Counter(tuple(w[p : p + n]) for p in range(len(w) - n + 1))
    found = {}
    for k, text in docs:
        own, hits = split(text or ""), []
        for item, other in ((i, split(x)) for i, x in bench if i is not None and x and split(x)):
            n = min(len(other), len(own))
            shingle = min(size, n)
            want = bag(other, min(size, len(other)))
            for p in range(len(own) - n + 1) if n else ():
                have = bag(own[p : p + n], shingle)
                s = sum((have & want).values()) / sum((have | want).values())
                if s >= least - 1e-9:
                    hits.append((s, item, (len(other), p)))
        found[k] = hits
    return found


def test_decontamination_is_the_brute_force_search(spark):
    """Items of 3 to 60 words, whole, edited, cut, repeated and upper case; recall of windows is measured. Then the edges."""
    r = random.Random(15)
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    bench = [(k, " ".join(say(n))) for k, n in enumerate([3, 5, 6, 8, 10, 14, 14, 14, 20, 20, 25, 30, 30, 40, 60])]
    bench += [(90, bench[5][1]), (91, None), (92, " .. "), (None, bench[0][1])]
    docs = []
    for k in range(220):
        w = r.choice(bench[:15])[1].split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            at = r.choice([0, len(w) - 1, r.randrange(len(w))])
            w[at : at + r.randrange(2)] = r.choice([[], say(1)])
            w = w or say(1)
        if k % 9 == 0:
            w = (w * 3)[: r.randrange(1, 3 * len(w))]
        docs.append((k, "; ".join(say(r.randrange(30)) + w + say(r.randrange(30))).upper() if k % 2 else " ".join(w)))
    docs += [(500, None), (500, None), (501, ""), (502, "?!"), (None, bench[5][1]), (503, " ".join(say(60_000)))]
    want = brute_contamination([x for x in docs if x[0] is not None and x[0] < 503], bench)
    columns = "doc_id long, text string, contaminated int, n_windows string, similarity int, item_id string"
    given = spark.createDataFrame([(*x, 1, "n", 2, "i") for x in docs], columns)
    items = spark.createDataFrame([(*x, 3) for x in bench], "item_id long, text string, size int")
    got = {x.doc_id: x for x in find_contamination(given, items, carry=("similarity",)).withColumnRenamed("similarity", "s").collect()}
    assert len(got) == len(docs) - 1 and got[None].contaminated and not got[503].contaminated
    windows = {k: len({at for _, _, at in hits}) for k, hits in want.items()}
    every = sum(windows.values())
    assert sum(got[k].n_windows for k in want) >= 0.99 * every and every > 150
    for k, hits in want.items():
        assert got[k].n_windows <= windows[k] and got[k].contaminated == bool(got[k].n_windows)
        if hits and got[k].n_windows == windows[k]:
            assert got[k].item_id == min(i for s, i, _ in hits if s == max(hits)[0])
    assert find_contamination(given.limit(0), items).count() == 0
    assert not any(x.contaminated for x in find_contamination(given, items.limit(0)).collect())


def test_benchmark_of_several_passes(spark, monkeypatch):
    r = random.Random(16)
    bench = [(k, " ".join(r.choice(WORDS) for _ in range(12))) for k in range(9)]
    docs = spark.createDataFrame([(k, f"{x} and {x}") for k, x in bench] + [(99, "no such words")], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    whole = sorted(find_contamination(docs, items).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert sorted(find_contamination(docs, items).collect(), key=str) == whole
    assert [(x.item_id, x.n_windows >= 2) for x in sorted(whole)[:9]] == [(k, True) for k, _ in bench]


def test_lookup_finds_all_within_the_radius():
    rng = np.random.default_rng(17)
    index = decontaminate.Index(list(range(300)), [" ".join(f"w{x}" for x in rng.integers(0, 50, 9)) for _ in range(300)], 5)
    (group,) = index.groups.values()
    group["prints"][:] = rng.integers(0, 256, group["prints"].shape)
    index_of = {length: g for length, g in index.groups.items()}
    assert len(index_of) == 1
    values = np.arange(256, dtype=np.uint8)
    group["lists"] = []
    for block, most in enumerate(decontaminate.NEAR):
        value, who = np.nonzero(np.bitwise_count(values[:, None] ^ group["prints"][None, :, block]) <= most)
        group["lists"].append((np.searchsorted(value, np.arange(257)), who.astype(np.int32)))
    asked = np.concatenate([rng.integers(0, 256, (200, 8)), group["prints"][:100] ^ (1 << rng.integers(0, 12, (100, 8))).astype(np.uint8)]).astype(np.uint8)
    got = {(w, k) for window, item in index.lookup(group, asked) for w, k in zip(window.tolist(), item.tolist(), strict=True)}
    apart = np.bitwise_count(asked[:, None] ^ group["prints"][None]).sum(axis=2)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= decontaminate.RADIUS)), strict=True)) and len(got) > 100


def test_language(spark):
    r = random.Random(5)
    alphabet = {"aa": "abcd", "bb": "cdef", "cc": "wxyz", "dd": "uvwx"}
    word = lambda s: "".join(r.choice(s) for _ in range(5))
    rows = [(k, " ".join(word(alphabet[lang]) for _ in range(40)), lang) for k, lang in enumerate(list(alphabet) * 40)] + [(900, None, "aa"), (901, " 12 ", "aa"), (902, "", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {k: lang for k, _, lang in rows}
    assert all(x.lang_pred == want[x.doc_id] and 0 <= x.score <= 1 for x in got if x.doc_id < 900)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id >= 900)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2, raising=False)
    docs = spark.createDataFrame([(k, "some words", f"l{k % 3}") for k in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(docs)


def test_language_stage_rejects_junk_with_letters(spark):
    r = random.Random(7)
    alphabet = {"aa": "abcd", "bb": "cdef", "cc": "wxyz", "dd": "uvwx"}
    say = lambda s, n: " ".join("".join(r.choice(s) for _ in range(5)) for _ in range(n))
    rows = [(k, say(alphabet[lang], r.choice([5, 40, 300])), lang) for k, lang in enumerate(list(alphabet) * 40)]
    junk = [say("abcdefghijklmnopqrstuvwxyz", 40), say("0123456789ghij", 40), "το γρήγορο καφέ αλεπού", "mnop" * 50, None, " 12 "]
    rows += [(900 + k, x, "aa" if k % 2 else None) for k, x in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()} == set(range(160))


def test_toxicity(spark):
    r = random.Random(6)
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = say(60)
        for p in (5, 20, 40) if bad else ():
            w[p] = r.choice(["zonk", "blarg"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert all(x.predicted == (x.doc_id < 400 and x.doc_id % 4 == 0) for x in got)
    nobody = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {x.score for x in toxicity.score(docs, nobody).collect()} == {0.0}


def brute_parse(clauses):
    """Scores and accepted words by looking around each strong word."""
    T = toxicity
    flat = [(c, p, kind, s) for c, own in enumerate(clauses) for p, (kind, s) in enumerate(own) if kind in T.STRONG]
    scores, accepted = {}, 0
    for n, (c, p, kind, s) in enumerate(flat):
        kinds = [k for k, _ in clauses[c]]
        before = lambda wanted, reach: wanted in kinds[max(0, p - reach) : p]  # noqa: E731, B023
        insult = kind == T.INSULT
        factor = (1.3 if before(T.TARGET, 4) else 1) * (0.3 if before(T.NEGATION, 3) else 1) * (0.5 if before(T.REPORT, p) else 1)
        piled = lambda k: any(flat[j][2] == T.INSULT and flat[j][0] >= flat[k][0] - 2 for j in range(k))
        factor *= 1.2 if insult and piled(n) else 1
        at = None
        if before(T.TARGET, 4) or insult and (before(T.LINK, 3) or p == 0 or piled(n)) or not insult and before(T.INTENT, 3):
            at = c
        else:
            follows = next((q for q in range(p + 1, len(kinds)) if kinds[q] in T.STRONG), len(kinds))
            if T.TARGET in kinds[p + 1 : min(p + 4, follows)]:
                at, factor = c, factor * 1.2
            elif insult and p == len(kinds) - 1:
                at = c
            elif insult and n + 1 < len(flat) and flat[n + 1][2] == T.INSULT and piled(n + 1):
                at = flat[n + 1][0]
        if at is not None:
            scores[at] = scores.get(at, 0) + s * factor
            accepted += 1
    return [scores[c] for c in sorted(scores)], accepted


def test_grammar_is_the_brute_force_search():
    r, machine = random.Random(12), toxicity.grammar()
    for _ in range(3000):
        kinds = r.choices(toxicity.KINDS[:-1], [3, 2, 1, 1, 1, 1, 1, 6], k=40)
        symbols = [(k, r.choice([1.0, 2.5, 4.0]) if k in toxicity.STRONG else 0.0) for k in kinds]
        cuts = sorted(r.sample(range(41), r.randrange(12)))
        clauses = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
        got, want = toxicity.parse(clauses, machine), brute_parse(clauses)
        assert got[1] == want[1] and np.allclose(got[0], want[0])


def test_grammar_decides():
    """Words that no pattern accepts, and the words of an inert grammar, have no score."""
    T = toxicity
    strong, other = (T.INSULT, 4.0), (T.OTHER, 0.0)
    parse = lambda *clause: T.parse([list(clause)], T.grammar())
    assert parse(other, strong, other) == ([], 0)
    assert parse(other, (T.LINK, 0.0), strong, other) == ([4.0], 1)
    assert parse((T.TARGET, 0.0), other, strong, other) == ([4.0 * 1.3], 1)
    assert parse((T.TARGET, 0.0), (T.NEGATION, 0.0), strong, other)[0] == pytest.approx([4.0 * 1.3 * 0.3])
    assert parse((T.REPORT, 0.0), (T.LINK, 0.0), strong, other)[0] == pytest.approx([2.0])
    assert parse(other, (T.THREAT, 3.0), other) == ([], 0) and parse(other, (T.INTENT, 0.0), (T.THREAT, 3.0), other) == ([3.0], 1)
    assert T.parse([[(T.LINK, 0.0), strong, (T.TARGET, 0.0), strong, strong]], T.Composed()) == ([], 0)


def test_toxicity_edges(spark):
    """No documents, null ids, repeated rows, texts of one kind of word, a very long text, and columns that clash."""
    bad = [(k, "you are a zonkish blarg, you know") for k in range(40)]
    rows = [*bad, *((k, f"the w{k} is a nice w{k % 7} of many") for k in range(40, 200))]
    columns = "doc_id long, text string, toxic int, score double, head string"
    odd = [(None, "you zonkish blarg"), (500, "zonk " * 200_000), (500, "zonk " * 200_000), (501, "..."), (502, None)]
    docs = spark.createDataFrame([(*x, 1, 0.5, "h") for x in [*rows, *odd]], columns)
    labels = spark.createDataFrame([(k, int(k < 40), 1) for k in range(200)] + [(None, 1, 1), (3, None, 1), (3, 1, 1)], "doc_id long, toxic int, doc int")
    scorer = toxicity.fit(docs, labels, evidence=1.0)
    got = toxicity.score(docs, scorer).collect()
    assert len(got) == 205 and toxicity.score(docs.limit(0), scorer).count() == 0
    found = {}
    for x in got:
        found.setdefault(x.doc_id, []).append((x.score, x.predicted))
    assert all(found[k][0][1] == (k < 40) for k in range(200)) and found[500][0] == found[500][1]
    assert found[501] == found[502] and found[502][0][1] == 0 and found[None][0][0] > found[502][0][0]
    assert toxicity.fit(docs.limit(0), labels).coefficients is None


def test_lines(spark):
    long = [f"this is a line of some length number {k}" for k in range(9)]
    rows = [(0, "\n".join(long[:4])), (1, "\n".join(["mine alone", *long[1:3], "", "short", long[3]])), (2, "\n".join(long[:4])), (3, None), (4, ""), (5, "short\nshort"), (2, "\n".join(long[:4])), (None, long[0])]
    got = {}
    for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append((x.kept, x.n_deleted))
    assert got[0] == [("\n".join(long[:4]), 0)] and got[2] == [("", 4)] * 2 and got[3] == [(None, 0)] and got[4] == [("", 0)]
    assert got[5] == [("short\nshort", 0)] and got[None] == [(long[0], 0)]
    assert got[1] == [("mine alone\n\nshort\n" + long[3], 2)]  # the last line is a block of 38 characters
    assert patience([1, 2, 3, 4], [9, 2, 3, 1, 4]) == [(1, 1), (2, 2), (3, 4)]


def gone_lines(spark, texts):
    got = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [x.n_deleted for x in sorted(got, key=lambda x: x.doc_id)]


def test_lines_that_are_short_or_repeated(spark):
    poem = "\n".join(f"short line {k}" for k in range(6))
    twice = "x" * 200 + "\nX\n" + "x" * 200
    assert gone_lines(spark, [poem, twice, "own\n" + poem, twice]) == [0, 0, 6, 3]


def test_lines_of_all_earlier_documents(spark):
    one, two, r = "p" * 60, "q" * 60, random.Random(8)
    assert gone_lines(spark, [f"{one}\n{two}", f"{two}\nmine\n{one}", f"{two}\nother\n{one}"]) == [0, 1, 2]
    three = [f"thirty characters of line no {k}" for k in range(3)]
    assert gone_lines(spark, [*three, "\n".join(three), "\n".join(three)]) == [0, 0, 0, 0, 3]
    rows = [[r.choice(["a" * 50, "b" * 45, "c" * 25, "d" * 25, "e" * 10, f"{k} " * 9, f"{k} {p}"]) for p in range(r.randrange(9))] for k in range(60)]
    want = []
    for k, own in enumerate(rows):
        at = lambda x, x_of: [p for p, y in enumerate(x_of) if y == x]
        ways = [blocks([(at(x, own), at(x, other), len(x.strip())) for x in sorted(set(own) & set(other), key=lambda x: hash(x))], 40)[0] for other in rows[:k]]
        want.append(len(set().union(*ways)))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tesselle.llm.line_dedup.ROUND", 3)
        assert gone_lines(spark, ["\n".join(x) for x in rows]) == want


def pipeline_rows():
    """Documents in two learned languages with shared lines, near copies, benchmark passages, junk, nulls and repeats."""
    r = random.Random(31)
    alphabet = {"aa": "abcdefg", "cc": "stuvwxyz"}
    word = lambda s: "".join(r.choice(s) for _ in range(r.randrange(3, 7)))
    line = lambda lang, n=9: " ".join(word(alphabet[lang]) for _ in range(n))
    common = {lang: [line(lang) for _ in range(4)] for lang in alphabet}
    bench = {lang: [line(lang, 20) for _ in range(2)] for lang in alphabet}
    rows = []
    for k in range(120):
        lang = r.choice(list(alphabet))
        own = [line(lang) for _ in range(r.randrange(2, 8))]
        if k % 5 == 0:
            own[1:1] = common[lang][: r.randrange(1, 5)]
        if k % 11 == 0:
            own.insert(1, r.choice(bench[lang]))
        if k % 7 == 0 and (same := [x[1] for x in rows if x[1][0] in alphabet[lang]]):
            copy = r.choice(same).split(" ")
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = word(alphabet[lang])
            own = [" ".join(copy)]
        rows.append((k, "\n".join(own), lang if k % 4 else None, f"s{k % 3}" if k % 13 else None))
    rows += [(200, None, "aa", "s0"), (201, "", "aa", None), (202, " 12 ", None, "s1"), (203, "κακό κακό", None, "s1"), (None, rows[0][1], "aa", "s2"), (5, rows[5][1], "aa", "s2")]
    return [(k, t, lang, source, len(t or "")) for k, t, lang, source in rows], [(k, x) for k, x in enumerate(x for own in bench.values() for x in own)]


def brute_lines(docs):
    """The texts without the lines that alignments with any earlier document delete; no text that loses all."""
    first = {}
    for k, text in docs:
        if k is not None:
            first.setdefault(k, text)
    split = lambda text: [x.strip(" ") for x in text.split("\n") if x.strip(" ")]
    out = []
    for k, text in docs:
        gone = set()
        if k is not None:
            own = split(text)
            for j, other in first.items():
                if j < k:
                    theirs = split(other)
                    places = lambda x, x_of: [p for p, y in enumerate(x_of) if y == x]
                    gone |= blocks([(places(x, own), places(x, theirs), len(x)) for x in sorted(set(own) & set(theirs))], 40)[0]
        number, left = 0, []
        for x in text.split("\n"):
            keep = not x.strip(" ") or number not in gone
            number += bool(x.strip(" "))
            left += [x] if keep else []
        if not gone or "\n".join(left).strip(" "):
            out.append((k, "\n".join(left)))
    return out


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept, and run() against all of them."""
    rows, bench = pipeline_rows()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)

    def step(name, given):
        got = stage[name](spark, given, str(tmp_path))
        got.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name)) if name != "mixing" else got

    pairs = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    named = step("language_id", docs)
    model = langid.fit(docs)
    told = [(k, t) for k, t, *_ in rows if (p := model.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    assert pairs(named) == sorted(told, key=str) and {k for k, _ in told} == {*range(120), None}
    lined = step("line_dedup", named)
    left = brute_lines([(x.doc_id, x.text) for x in named.orderBy("doc_id").collect()])
    assert pairs(lined) == sorted(left, key=str) and all(x.n_chars == len(x.text) for x in lined.collect())
    single = step("near_dedup", lined)
    _, label = brute_components([x for x in left if x[0] is not None], 5, 80)
    want = {x for x in left if x[0] is None or label[x[0]] == x[0]}
    assert pairs(single) == sorted(want, key=str) and len(want) < len(left)
    cleaned = step("decontamination", single)
    hits = brute_contamination(want, bench)
    want = {x for x in want if not hits[x[0]]}
    assert pairs(cleaned) == sorted(want, key=str) and len(want) < len(hits)
    mixed = step("mixing", cleaned)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/decontamination/*.parquet'")
    oracle = duck.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()
    assert sorted(map(str, map(tuple, mixed.collect()))) == sorted(map(str, oracle))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, whole.collect()))) == sorted(map(str, oracle))


def test_pipeline_stages_keep_any_columns(spark, tmp_path):
    """Extra columns with names that operators use, and no documents at all."""
    rows, bench = pipeline_rows()
    extra = "same string, kept string, score string, _same string, key string, lines string"
    docs = spark.createDataFrame([(*x, *"abcdef") for x in rows[:40]], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns and {tuple(x)[5:] for x in out.collect()} == {tuple("abcdef")}, name
        assert run(spark, docs.limit(0), str(tmp_path)).count() == 0, name
