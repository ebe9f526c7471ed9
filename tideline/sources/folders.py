"""Folder loads: a manifest of known files, a watermark for each key and a keyed overwrite, as one job that may be repeated.

The table lies in ``target/data``, partitioned by its key; ``target/manifest`` lists each file that was loaded (path, length, time of change).
A load lists the folder without opening files, reads only files that the manifest does not hold in this state, drops rows
that are not newer than the key's newest stored row (a full load keeps them), and merges the rest into the partitions of the keys it
touches; others are neither read nor written. The manifest is written last: a load that is cut off is repeated and gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.incremental import upsert, write_partitions
from tideline.sources.vendor import rows_after_watermark

Reader = Callable[[list[str]], DataFrame]
FILE = "path string, length bigint, modificationTime timestamp"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table, or None (an empty one, if its schema is given) where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None if schema is None else spark.createDataFrame([], schema)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, length, modificationTime of all files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "modificationTime")


def load_folder(spark: SparkSession, folder: str, target: str, read: Reader, key: str, ts: str, values: Sequence[str], pattern: str = "*.csv", full: bool = False) -> DataFrame:
    """Load what is new; returns one row per new file: path, rows, rows_loaded, resolved.

    ``read`` gives ``key``, ``ts``, ``values`` and ``source_file`` (the path) of the listed files; rows without a key are of a file that can't be
    resolved: it is reported, loads nothing and is asked for again next time. Of rows with the same key and time the one
    of the file changed last (then of the larger path) stays. Only the names of new files pass through the driver.
    """
    known = stored(spark, f"{target}/manifest", FILE)
    new = list_files(spark, folder, pattern).join(known.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")
    run = f"{target}/loads/{uuid.uuid4().hex}"
    new.write.parquet(f"{run}/files")
    new = spark.read.parquet(f"{run}/files")
    paths = [r.path for r in new.select("path").orderBy("path").collect()]
    if not paths:
        return new.select("path", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("rows_loaded"), F.lit(True).alias("resolved"))
    read(paths).join(new.select(F.col("path").alias("source_file"), "modificationTime"), "source_file").write.parquet(f"{run}/rows")
    rows = spark.read.parquet(f"{run}/rows")
    table = stored(spark, f"{target}/data")
    fresh = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    if table is not None:
        fresh = rows_after_watermark(fresh, table.select(key, ts), [key], ts, full)
    loaded = fresh.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_loaded"))
    counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("_keyed")).join(loaded, "source_file", "left")
    report = new.join(counts, new.path == counts.source_file, "left").select(
        "path", "length", "modificationTime", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("rows_loaded", F.lit(0)).alias("rows_loaded"),
        (F.coalesce("rows", F.lit(0)) == F.coalesce("_keyed", F.lit(0))).alias("resolved"))
    report.write.parquet(f"{run}/report")
    payload = F.struct(*values, "source_file")
    one = fresh.groupBy(key, ts).agg(F.max_by(payload, F.struct("modificationTime", "source_file")).alias("_r")).select(key, ts, "_r.*")
    if table is not None:
        mine = table.join(one.select(key).distinct(), key, "left_semi")
        one = upsert(mine.select(*one.columns), one, [key, ts])
    one.write.parquet(f"{run}/merged")
    merged = spark.read.parquet(f"{run}/merged")
    if not merged.isEmpty():
        write_partitions(merged.repartition(key), f"{target}/data", [key])
    report = spark.read.parquet(f"{run}/report")
    report.filter("resolved").select("path", "length", "modificationTime").write.mode("append").parquet(f"{target}/manifest")
    return report.select("path", "rows", "rows_loaded", "resolved")
