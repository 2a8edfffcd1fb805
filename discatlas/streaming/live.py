"""Structured Streaming: signs of life, and derived tables kept up to date as changes arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from discatlas.operators import similarity, sinks


def activity(events: DataFrame, at: str, key: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events and last time per key and window, events later than `late` left out: window_start, key, n, last_seen."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(key).alias("key"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_seen")).select(F.col("w.start").alias("window_start"), "key", "n", "last_seen")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap: started, ended, key, n."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key).alias("key"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "key", "n")


def presence(events: DataFrame, at: str, key: str, silent: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Changes of presence: key, state (appeared, gone), at. A key is gone when event time passes its last event by `silent`.

    The state of a key is one timestamp, dropped when it goes; events that the
    watermark leaves behind count for nothing.
    """
    seconds = pd.Timedelta(silent)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((name[0], "gone", pd.Timestamp(last, unit="us") + seconds))
            state.remove()
        else:
            times = pd.concat([b["at"] for b in batches])
            newest = int(times.max().value // 1000)
            if not state.exists:
                out.append((name[0], "appeared", times.min()))
            last = max(newest, state.get[0]) if state.exists else newest
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + int(seconds.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "state", "at"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(at).alias("at")).where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, state string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def first_deliveries(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """A stream without deliveries repeated within `late` of the first; the state is bounded by the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def refresh_similarity(changes: DataFrame, read_sets: Callable[[SparkSession], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table of similar pairs up to date as owners change (a stream of owner).

    Each batch computes only pairs with a changed end and writes a new version
    of the table beside the old one, path/v=<batch>; a batch that runs again
    writes the same version again, so a lost driver does no harm. The newest
    version is the table, see latest.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        dirty = rows.select("owner").distinct()
        stored = latest(spark, path, number)
        sets = read_sets(spark)
        pairs = similarity.weighted_jaccard(sets) if stored is None else similarity.refresh(stored, sets, dirty)
        pairs.write.mode("overwrite").parquet(f"{path}/v={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a versioned table (older than `before`), None if there is none."""
    if not _exists(spark, path):
        return None
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and _exists(spark, f"{path}/{n}/_SUCCESS")]
    versions = sorted(v for v in done if before is None or v < before)
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def append_new(rows: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows of a stream whose key a Parquet table doesn't have yet."""

    def batch(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        held = spark.read.schema(part.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], part.schema)
        sinks.insert_ignore(held, part, key).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
