"""Reading catalogue tables and choosing the valid delivery of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a data folder: one Parquet file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_delivery(df: DataFrame, key: str = "id", arrival: str = "loaded_at") -> DataFrame:
    """The delivery with the smallest arrival of every key.

    Rows without a key are kept as they are delivered; a null arrival comes
    last. Deliveries of one key with equal arrival hold equal content, so either
    may be chosen. Prune columns first: all that remain are shuffled once.
    """
    order = Window.partitionBy(key, F.when(F.col(key).isNull(), F.monotonically_increasing_id())).orderBy(F.col(arrival).asc_nulls_last())
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def distinct_delivery(df: DataFrame, *key: str) -> DataFrame:
    """One row per key, for columns that every delivery of the key repeats unchanged."""
    return df.dropDuplicates(list(key))
