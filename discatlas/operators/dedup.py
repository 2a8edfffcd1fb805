"""Duplicate content, storage totals and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def references(artefacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every artefact with its blob: artefact_id, blob_id, file_size, sha256 (lower case)."""
    held = artefacts.where("upload_blob_id IS NOT NULL").select(F.col("id").alias("artefact_id"), F.col("upload_blob_id").alias("blob_id"))
    return held.join(blobs.select(F.col("id").alias("blob_id"), "file_size", F.lower("sha256").alias("sha256")), "blob_id")


def canonical(blobs: DataFrame) -> DataFrame:
    """Each blob and the one that stands for its content, the smallest id of equal size and sha256: blob_id, canonical_id.

    Content without a size or hash stands for itself. The smallest id comes from
    an aggregate with partial states and is joined back, so content uploaded
    over and over is no single task.
    """
    keyed = blobs.select(F.col("id").alias("blob_id"), "file_size", F.lower("sha256").alias("sha256"))
    known = keyed.where("file_size IS NOT NULL AND sha256 IS NOT NULL")
    first = known.groupBy("file_size", "sha256").agg(F.min("blob_id").alias("canonical_id"))
    joined = known.join(first, ["file_size", "sha256"]).select("blob_id", "canonical_id")
    return joined.unionByName(keyed.where("file_size IS NULL OR sha256 IS NULL").select("blob_id", F.col("blob_id").alias("canonical_id")))


def duplicate_groups(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Keys that at least `least` rows hold, with their count; null keys are no group."""
    present = rows.dropna(subset=keys)
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def storage_report(refs: DataFrame) -> DataFrame:
    """One row: physical_bytes, logical_bytes, saved_bytes, shared_contents and ratio of referenced content with a size above 0."""
    groups = refs.where("file_size > 0 AND sha256 IS NOT NULL").groupBy("file_size", "sha256").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("physical_bytes"),
        F.coalesce(F.sum(F.col("file_size") * F.col("n")), F.lit(0)).alias("logical_bytes"),
        F.count_if(F.col("n") > 1).alias("shared_contents"),
    )
    return sums.select("physical_bytes", "logical_bytes", (F.col("logical_bytes") - F.col("physical_bytes")).alias("saved_bytes"), "shared_contents", F.when(F.col("physical_bytes") > 0, F.col("logical_bytes") / F.col("physical_bytes")).alias("ratio"))


def pivot_counts(rows: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Rows per key and in each of the values of a column, in one pass: keys, total, n_<value>."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values))


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return nth_newest(rows, keys, order, 1)


def nth_newest(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key; Spark limits each map task's rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") <= most).drop("__nth")


def unreferenced(stored: DataFrame, blobs: DataFrame) -> DataFrame:
    """Stored objects whose path no blob names."""
    return stored.join(blobs.select("storage_path").where("storage_path IS NOT NULL").distinct(), "storage_path", "left_anti")
