"""Shared helpers: reading tables, durable checkpoints, word hashing and compact arrays."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case; other letters are left alone, as the contracts say A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A row without an id sorts after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that of the context. Where neither is set, a local master (as in tests) gets
    a folder of its own, and a cluster an error: its executors don't see each other's disks."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


#: Rows that a checkpoint file should hold where a bound on the number of rows is known.
FILE_ROWS = 20_000


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint in the shared folder. With a bound on its rows, a table that is small for the session's number
    of shuffle partitions is dealt out to fewer files: each file costs several calls of the file system, and on a local one
    a process for each call, however little it holds."""
    spark = df.sparkSession
    folder, sc = shared_folder(spark), spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        if 2 * files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    return df.checkpoint()


#: The most keys that are called hot, and so the most rows that are broadcast for them; and the tasks that share a hot key.
MOST_HOT, SALTS = 10_000, 32


def hottest(counts: DataFrame, key: str, least: int) -> list:
    """The keys with more than `least` rows, the largest MOST_HOT at most, of a table with one row a key and its size n."""
    return [x[0] for x in counts.filter(F.col("n") > least).orderBy(F.desc("n"), key).select(key).limit(MOST_HOT).collect()]


def join_salted(rows: DataFrame, facts: DataFrame, key: str, hot: list, by: str = "doc_id") -> DataFrame:
    """`rows.join(facts, key)`, the rows of each hot key being shared out to SALTS tasks by the column `by`, and the facts of
    hot keys copied to these. Which keys are called hot changes no result."""
    if not hot:
        return rows.join(facts, key)
    names = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in hot], f"{key} {dict(rows.dtypes)[key]}").withColumn("_hot", F.lit(True)))
    one = F.lit(0).cast("int")
    left = rows.join(names, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(one))
    right = facts.join(names, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(one, F.lit(SALTS - 1))).otherwise(F.array(one))))
    return left.drop("_hot").join(right.drop("_hot"), [key, "_salt"]).drop("_salt")


#: Rows and bytes that go to a Python worker at a time. Texts may be long, and a worker holds a batch as Arrow and as objects.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the batches of Python stages in rows and in bytes (a single row may be larger), unless they are smaller
    already. The bounds are settings of the session, as Spark reads them when the plan runs, so they stay set; they
    change no result."""
    conf = df.sparkSession.conf
    for key, most, default in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, str((1 << 31) - 1))):
        value = str(conf.get(f"spark.sql.execution.arrow.{key}", default)).lower().removesuffix("b")
        if not (value.isdigit() and 0 < int(value) <= most):
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def held_out(doc_id: str = "doc_id"):
    """The rows that no model may learn from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once. The table is emptied when it is large, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` words in text order; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit values as compressed byte planes; ascending ones as differences."""
    values = values.astype(np.uint64)
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = values.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if ascending else values
