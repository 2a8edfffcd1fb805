"""Logs of jobs and signs of life: last seen, gaps, staleness, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_seen(beats: DataFrame, key: str, at: str) -> DataFrame:
    """Newest time of each key: key, last_seen, n."""
    return beats.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def alive(seen: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Keys seen less than so many seconds before now."""
    return seen.where(F.col("last_seen") > now - F.make_dt_interval(secs=F.lit(seconds)))


def spaced(beats: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Beats that come at least so many seconds after the one before of the same key; the first always counts."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return beats.withColumn("__gap", F.col(at) - before).where(F.col("__gap").isNull() | (F.col("__gap") >= F.make_dt_interval(secs=F.lit(seconds)))).drop("__gap")


def stale(jobs: DataFrame, started: str, now: Column, seconds: int) -> DataFrame:
    """Running jobs that began longer ago than so many seconds."""
    return jobs.where((F.col("status") == "RUNNING") & (F.col(started) < now - F.make_dt_interval(secs=F.lit(seconds))))


def open_once(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One open (pending or running) job per key, the one with the smallest id."""
    return jobs.where(F.col("status").isin("PENDING", "RUNNING")).groupBy(*keys).agg(F.min("id").alias("id"))
