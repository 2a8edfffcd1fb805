"""Writing results: insert-or-ignore, reconciliation, scoped replacement, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.functions.text import csv_guard


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows to append: one per key, none whose key the target has. Null keys are kept out."""
    fresh = rows.dropna(subset=key).dropDuplicates(key)
    return fresh.join(target.select(*key).distinct(), key, "left_anti")


def reconcile(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What turns old into new: key columns, op (insert, update, delete, keep) and new's other columns."""
    values = [c for c in new.columns if c not in key]
    left = old.select(*key, *(F.col(c).alias(f"__old_{c}") for c in values), F.lit(True).alias("__in_old"))
    right = new.select(*key, *values, F.lit(True).alias("__in_new"))
    joined = left.join(right, key, "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"__old_{c}").eqNullSafe(F.col(c)) for c in values), F.lit(True))
    op = F.when(F.col("__in_old").isNull(), "insert").when(F.col("__in_new").isNull(), "delete").when(same, "keep").otherwise("update")
    return joined.select(*key, op.alias("op"), *values)


def delete_cascade(rows: DataFrame, doomed: DataFrame, key: str, reference: str) -> DataFrame:
    """rows without those that refer to a doomed key."""
    return rows.join(doomed.select(F.col(key).alias(reference)), reference, "left_anti")


def replace_scope(rows: DataFrame, path: str, scope: list[str]) -> None:
    """Replace only the partitions of a Parquet table that rows touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header whose text can't start a formula."""
    guarded = [csv_guard(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*guarded).write.mode("overwrite").option("header", True).csv(path)


def nested_json(known: DataFrame) -> DataFrame:
    """Products with their files as one JSON text each: product, json. Files are in order of their id."""
    rest = [c for c in known.columns if c != "product"]
    files = F.sort_array(F.collect_list(F.struct("id", *(c for c in rest if c != "id"))))
    return known.groupBy("product").agg(files.alias("files")).select("product", F.to_json(F.struct(F.lit(1).alias("schema_version"), "product", "files")).alias("json"))


def reassign(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with a reference replaced where the mapping (old, new) has another: the column and whether it changed."""
    joined = rows.join(mapping.where("old != new").select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
    return joined.withColumn("changed", F.col("__new").isNotNull()).withColumn(column, F.coalesce("__new", column)).drop("__new")


def nested_paths(files: DataFrame) -> DataFrame:
    """Members of archives with the archive's path in front: id, parent_file_id, full_path. A member whose path already begins with it keeps it."""
    archives = files.select(F.col("id").alias("parent_file_id"), F.col("path").alias("__outer"))
    joined = files.where("parent_file_id IS NOT NULL").join(archives, "parent_file_id")
    full = F.when(F.col("path").startswith(F.concat("__outer", F.lit("/"))), F.col("path")).otherwise(F.concat_ws("/", "__outer", "path"))
    return joined.select("id", "parent_file_id", full.alias("full_path"))


def children_json(parents: DataFrame, children: DataFrame, key: str, reference: str, name: str) -> DataFrame:
    """Each parent row as JSON text with its children in an array, in order of their id: key, json."""
    rest = [c for c in children.columns if c not in (reference, "id")]
    grouped = children.groupBy(F.col(reference).alias(key)).agg(F.sort_array(F.collect_list(F.struct("id", *rest))).alias(name))
    joined = parents.join(grouped, key, "left")
    return joined.select(key, F.to_json(F.struct(*parents.columns, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)).alias(name))).alias("json"))
