"""Corpus pipeline: documents -> language -> toxicity -> near copies -> benchmark passages -> piece ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the last return the columns of
their input, rows unchanged. Nulls: a null text has no language and goes with the first stage (a stage called alone keeps
it: it is not toxic, one of the empty texts, clean, and has null pieces). Repeated rows are near copies of each other:
one stays. Empty tables pass through. Columns beside ``doc_id`` and ``text`` may have any names and are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import copies, decontaminate, langid, pieces, toxicity
from tideline.llm.common import id_remainder, prepare, scratch, table

#: Least score of a language: 0 is a text that shares no n-gram with any learned profile.
LANGUAGE_SCORE = 0.1
TOXIC_SCORE = 0.5
#: Near copies: similarity 0.8 or more (``copies.LEAST``) of the sets of five-word shingles.
SHINGLE = 5


def unused(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that are like no learned language."""
    prepare(spark)
    profiles = langid.learn(docs.where(id_remainder(F.col("doc_id"), 5) != 0), F.col("text"), F.col("lang"))
    p = unused("found", docs)
    found = docs.withColumn(p, langid.predict(docs, F.col("text"), profiles))
    return found.where((F.col(f"{p}.lang") != langid.UND) & (F.col(f"{p}.score") >= LANGUAGE_SCORE)).drop(p)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that a model learned from the labels scores as toxic."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=id_remainder(F.col("doc_id"), 5) != 0)
    return docs.where(toxicity.score(docs, F.col("text"), model) < TOXIC_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id (nulls last)."""
    prepare(spark)
    row = unused("row_number", docs)
    tagged = scratch(docs.withColumn(row, F.monotonically_increasing_id()))
    named = copies.verified(tagged, id_col=row, text_col="text", size=SHINGLE)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("id"))).alias("first")
    rows = tagged.select(F.col(row).alias("id"), "doc_id").join(named, "id")
    kept = rows.groupBy("component").agg(first).select(F.col("first.id").alias(row))
    return tagged.join(kept, row, "left_semi").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    prepare(spark)
    key = unused("row_hash", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    hits = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    bad = scratch(hits.where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, n_fallback, round_trip."""
    prepare(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language), ("toxicity", toxic), ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages), ("sentencepiece", encoded),
]

#: Rank profiles, a learned classifier, fingerprints and piece ids are not for SQL: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
