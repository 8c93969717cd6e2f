"""Null ids, repeated rows, empty tables, very long texts and clashing columns, where the operators' own tests lack them."""

from __future__ import annotations

import hashlib
import random
import zlib
from types import SimpleNamespace

import duckdb
import pytest

from tesselle.llm import common, langid, mixing
from tesselle.llm.exact_substring import remove_repeats
from tesselle.llm.line_dedup import dedup_lines
from tesselle.llm.minhash import near_duplicates

DOCS = "doc_id long, text string"


def test_exact_substrings_of_null_and_equal_ids(spark):
    """A null id comes after all others; rows with equal ids are one document, which loses nothing by itself."""
    r = random.Random(1)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, other = say(120), say(90)
    rows = [(3, "x" + shared), (3, shared + "y"), (None, shared + other), (7, other), (1, None), (1, "")]
    df = spark.createDataFrame([(*x, "k", 1, b"h") for x in rows], DOCS + ", kept string, b int, hashes binary")
    got = sorted((x.doc_id is None, x.doc_id, x.n_bytes, x.n_removed, bytes(x.kept)) for x in remove_repeats(df).collect())
    assert got == sorted([(False, 3, 121, 0, b"x" + shared.encode()), (False, 3, 121, 0, shared.encode() + b"y"), (True, None, 210, 210, b""), (False, 7, 90, 0, other.encode()), (False, 1, 0, 0, b""), (False, 1, 0, 0, b"")])
    assert remove_repeats(df.limit(0)).count() == 0


def test_exact_substrings_of_a_very_long_text(spark):
    r = random.Random(2)
    base = "".join(r.choice("abcdefghij ") for _ in range(300_000))
    rows = [(1, base), (2, "0" + base[1000:2000] + "1" + base[-400:])]
    got = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(rows, DOCS), bucket_bytes=50_000).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, bytes(got[2].kept)) == (0, 1400, 2, b"01")


def test_near_duplicates_of_nothing_and_of_long_texts(spark):
    df = spark.createDataFrame([], DOCS + ", rep long, slots string")
    assert near_duplicates(df).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (2, " \n"), (None, None)], DOCS)
    assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_duplicates(nothing).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)}
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(9, " ".join(words)), (4, " ".join(words[:-50])), (4, " ".join(words[:-50])), (5, "other words entirely here now")]
    got = near_duplicates(spark.createDataFrame([(*x, "s", 1) for x in rows], DOCS + ", set1 string, band int")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(4, 4), (4, 4), (5, 5), (9, 4)]


def test_mixing_of_null_and_equal_ids_and_clashing_columns(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "d", None), (4, "e f", "s"), (4, "e f g h", "s"), (5, None, None), (6, " ", "t")]
    df = spark.createDataFrame([(*x, "k", 7, "r", 1.5) for x in rows], DOCS + ", source string, key string, size int, range string, target double")
    got = mixing.mix_sources(df, extra=("key", "source", "range"))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "key", "source", "range"]
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = duck.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(str, (tuple(x)[:5] for x in got.collect()))) == sorted(map(str, want))


def test_mixing_sums_ranges_and_blocks(spark, monkeypatch):
    """Small ranges and blocks give the places that the SQL's single running sum gives."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "BLOCK_RANGES", 4)
    r = random.Random(4)
    rows = [(k, " ".join("w" * r.randrange(9)), f"s{min(2, r.randrange(9))}" if k % 10 else None) for k in range(400)]
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = duck.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS + ", source string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_languages_of_odd_rows(spark):
    """Numbers that aren't letters, a very long text, repeated rows, a language of one row, and clashing columns."""
    r = random.Random(5)
    say = lambda s, n=30: " ".join("".join(r.choice(s) for _ in range(5)) for _ in range(n))
    single = next(k for k in range(300, 399) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(k, say("abcde"), "aa") for k in range(60)] + [(100 + k, say("vwxyz"), "zz") for k in range(60)] + [(single, say("klmno"), "mm")]
    odd = [(400, "½ ² Ⅷ 42", "aa"), (401, say("abcde", 60_000), None), (402, rows[0][1], None), (402, rows[0][1], None), (None, say("vwxyz"), "aa"), (403, rows[-1][1], None)]
    df = spark.createDataFrame([(*x, 1, "t", 2.0) for x in [*rows, *odd]], DOCS + ", lang string, width int, _text string, score double")
    got: dict = {}
    for x in langid.identify(df).collect():
        got.setdefault(x.doc_id, []).append((x.lang_pred, x.score))
    assert got[400] == [("und", 0.0)] and got[401][0][0] == "aa" and got[402][0] == got[402][1] and got[None][0][0] == "zz" and got[403][0][0] == "mm"
    assert not langid.has_letter("½²Ⅷ") and langid.has_letter("1é")


def test_learning_reads_a_bounded_number_of_rows(spark):
    rows = [(k, f"text {k} of some words", f"l{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    assert langid.fit(df).names == ["l0", "l1", "l2", "l3"]
    assert len(langid.fit(df, most_rows=40).support) == 4


def test_lines_of_long_texts_and_clashing_columns(spark):
    r = random.Random(6)
    say = lambda: "".join(r.choice("abcdefghij ") for _ in range(60)).strip()
    long = [say() for _ in range(4000)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["mine", *long[500:3500], "my own end"])), (3, "z" * 400_000), (4, "z" * 400_000)]
    df = spark.createDataFrame([(*x, "k", "g", 1) for x in rows], DOCS + ", kept string, gone string, _id int")
    got = {x.doc_id: x for x in dedup_lines(df, carry=("_id",)).collect()}
    assert (got[1].n_deleted, got[2].n_deleted, got[2].kept, got[4].n_deleted, got[4].kept) == (0, 3000, "mine\nmy own end", 1, "")
    assert got[2]._id == 1 and dedup_lines(df.limit(0)).count() == 0


def test_salted_joins_are_joins(spark):
    rows = spark.createDataFrame([(k, k % 5 if k % 3 else 0) for k in range(300)] + [(None, 0), (7, None)], "doc_id long, key long")
    facts = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c"), (0, "d")], "key long, fact string")
    plain = sorted(map(str, rows.join(facts, "key").select("doc_id", "key", "fact").collect()))
    assert sorted(map(str, common.join_salted(rows, facts, "key", [0, 3]).select("doc_id", "key", "fact").collect())) == plain
    counts = rows.filter("key is not null").groupBy("key").count().withColumnRenamed("count", "n")
    assert common.hottest(counts, "key", 50) == [0]


def test_clusters_need_a_shared_folder():
    """Where no folder is set, a cluster gets an error, not a folder of one machine."""
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: context.folder, setCheckpointDir=lambda x: setattr(context, "folder", x), folder=None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: folder))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
    assert common.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(session("local[2]"))


def test_digests_are_of_what_is_kept(spark):
    (x,) = remove_repeats(spark.createDataFrame([(1, "abc")], DOCS)).collect()
    assert x.kept_sha256 == hashlib.sha256(b"abc").hexdigest()
