"""Shared helpers of this subpackage: tables, words, batches of bounded size, shared scratch tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import checkpoint_dir
from tideline.session import prepare as prepare_session

#: Words of the scan and decontamination contracts, on UTF-8 bytes after lower-casing A-Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of text that travel to a Python worker at once; one longer text travels alone.
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and nothing else changed; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def word_bytes(text: str | None) -> list[bytes]:
    return WORD.findall(ascii_lower(text))


def space_words(text: str | None) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return."""
    return ascii_lower(text).split()


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def scratch(df: DataFrame, **options: str) -> DataFrame:
    """Write a table in the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, n: int, total: int, *cols: str) -> DataFrame:
    """The n rows with the smallest hash of ``cols`` (column ``h`` is added), of about ``total``. Rows that can't be among
    them (but with a chance below 1e-8) are left out by their hash before anything is sorted, so what the tasks send for the sort
    grows with n and not with their number."""
    share = min(1.0, (n + 6 * n**0.5 + 40) / max(1, total))
    hashed = df.withColumn("h", F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1)))
    return hashed.where(F.col("h") <= F.lit(int(share * ((1 << 62) - 1)))).orderBy("h", *cols).limit(n)


def by_bytes(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a sequence of sizes to runs [a, b) of at most ``limit`` in all; a larger item is a run of its own."""
    a = total = b = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > limit:
            yield a, b
            a, total = b, 0
        total += n
    if sizes:
        yield a, b + 1


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and element index of every element of slices [start, start + count)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return owner, np.arange(int(counts.sum())) - np.repeat(first, counts) + np.repeat(starts, counts)
