"""Profile of a folder that is brought up to date by reading only its new files.

Below the path of a profile lie the parts that ``streaming.sketches`` keeps per batch and ``manifest``, partitioned by version: one row per file with its
length, time of change and batch. A refresh writes the parts of its batch first and then the next version of the manifest, so a refresh that fails
half-way leaves the profile as it was, and its parts belong to no version. Parts that
no version names any more stay on disk.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.streaming.sketches import keep_batch, reconcile

_MANIFEST = "path string, length long, modified long, batch long"


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """``path, length, modified, batch`` of the files that the profile below ``store`` covers; empty before the first refresh."""
    try:
        versions = spark.read.schema(_MANIFEST + ", version long").parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")


def refresh_profile(
    spark: SparkSession, folder: str, store: str, read: Callable[[list[str]], DataFrame], pattern: str = "*.parquet",
) -> list[str]:
    """Take new files below ``folder`` into the profile below ``store``; returns the paths read.

    ``read`` makes one frame of the files it is given; it should set a schema for formats without one, as types must agree between refreshes.
    A file is known by path, length and time of change. When a file has changed or gone, the other files of its batch are read again, as parts of
    a batch cannot be taken apart. The driver holds one row per file, as every
    scan does. One refresh at a time.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
        .select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    )
    known = read_manifest(spark, store)
    same = ["path", "length", "modified"]
    now = spark.createDataFrame(listed.collect(), "path string, length long, modified long")  # one listing: files that come later wait
    stale = known.join(now, same, "left_anti").select("batch").distinct()
    valid = known.join(stale, "batch", "left_anti")
    new = now.join(valid, same, "left_anti").orderBy("path").collect()
    if not new and stale.isEmpty():
        return []
    batch = time.time_ns() // 1000  # never used before, so that parts of a failed refresh are no part of this one
    if new:
        frame = read([r["path"] for r in new])
        keep_batch(frame, frame.columns, store, batch)
    added = spark.createDataFrame([(*r, batch) for r in new], _MANIFEST)
    manifest = valid.select(*same, "batch").unionByName(added)
    manifest.withColumn("version", F.lit(batch)).write.mode("append").partitionBy("version").parquet(f"{store}/manifest")
    return [r["path"] for r in new]


def folder_profile(spark: SparkSession, store: str, top: int = 3) -> DataFrame:
    """The merged profile (``sketches.reconcile``) of the files in the last manifest; an error when it covers none."""
    batches = [r[0] for r in read_manifest(spark, store).select("batch").distinct().collect()]  # one number per refresh
    if not batches:
        raise ValueError("the profile covers no file")
    return reconcile(spark, store, top, batches)
