"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Language ID rejects texts without a letter and those whose features the predicted language mostly lacks. Line dedup deletes
lines that earlier documents have, and documents that lose all their text. Near dedup keeps the first document of each
group (shingles of five words, similarity 0.8). Decontamination drops documents that hold a benchmark item. Mixing gives the
words that the mix takes of each document; documents that it takes nothing of are left out.

Null and empty texts go in the first stage, as they have no letter. Documents without an id lose no lines and are in no group
of near copies, so they stay. Rows with equal ids are one document: equal texts of it stay once. Columns of `documents`
may have any name, clashing ones included; nulls in the others change nothing. No documents give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.llm import langid, mixing
from tesselle.llm.common import shared_folder, table
from tesselle.llm.decontaminate import find_contamination
from tesselle.llm.line_dedup import dedup_lines
from tesselle.llm.minhash import near_duplicates

#: A prediction with a lower score is none; texts whose features the language mostly lacks score 0.
LEAST_SCORE = 0.02


def _masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with all columns but doc_id under names that clash with no operator's, and the way back."""
    names = {f"in_{k}": c for k, c in enumerate(docs.columns) if c != "doc_id"}
    return docs.select("doc_id", F.col("text"), *[F.col(c).alias(k) for k, c in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    return rows.select("doc_id", *[F.col(k).alias(c) for k, c in names.items()]).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _masked(docs)
    found = langid.predict(rows, langid.fit(docs), carry=tuple(names))
    return _back(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), names, docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _masked(docs)
    own = {k: c for k, c in names.items() if c not in ("text", "n_chars")}
    found = dedup_lines(rows, carry=tuple(own)).filter("n_deleted = 0 or trim(kept) <> ''")
    found = found.select("doc_id", *own, F.col("kept").alias("in_text"), F.length("kept").cast("long").alias("in_chars"))
    own |= {"in_text": "text"} | ({"in_chars": "n_chars"} if "n_chars" in docs.columns else {})
    return _back(found, own, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _masked(docs)
    kept = near_duplicates(rows, size=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    once = rows.withColumn("same", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "same"])
    return _back(once.drop("same").union(rows.filter("doc_id is null")), names, docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _masked(docs)
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), carry=tuple(names))
    return _back(found.filter("not contaminated"), names, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("decontamination", clean), ("mixing", mix)]
#: SQL can't express the learned model, patience diff, or SimHash; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes as soon as the next one is written; the last table stays, as the result
    reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
