"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

Input splits, which are chunks of the fixed size spark.sql.files.maxPartitionBytes,
are combined locally to one state per key. States carry the number of their
lane, at first that of the split; each round divides it by the fan-in and merges
what then bears one number, so no reducer gets more than fan_in states of one
key, be the key unique or a third of the table, and after a logarithmic number
of rounds one state per key is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = "__lane"


def rounds(lanes: int, fan_in: int, until: int = 1) -> int:
    """How many rounds bring the states of one key from `lanes` lanes to at most `until`; at least one."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    done = 0
    while lanes > until or not done:
        lanes, done = math.ceil(lanes / fan_in), done + 1
    return done


def tree_levels(state: DataFrame, keys: list[str], names: list[str], lanes: int, fan_in: int, until: int = 1) -> list[DataFrame]:
    """The states after each round: keys, the lane and the summed columns `names`; state has them for `lanes` lanes from 0."""
    out = []
    for _ in range(rounds(lanes, fan_in, until)):
        state = state.withColumn(LANE, F.floor(F.col(LANE) / fan_in).cast("int")).groupBy(*keys, LANE).agg(*(F.sum(n).alias(n) for n in names))
        out.append(state)
    return out


def tree_merge(df: DataFrame, keys: list[str], first: dict[str, Column], fan_in: int = 32) -> DataFrame:
    """Sum the columns `first` per key by a tree of merges over the splits of df.

    keys may hold nulls, which form a key of their own. A sum over nulls only is
    null; an empty table gives no rows.
    """
    state = df.select(*keys, *(c.alias(n) for n, c in first.items()), F.spark_partition_id().alias(LANE))
    return tree_levels(state, keys, list(first), df.rdd.getNumPartitions(), fan_in)[-1].drop(LANE)


def member_lanes(df: DataFrame, key: str, size: str, member: str, fan_in: int) -> DataFrame:
    """States key_value, lane, n_rows, n_bytes, n_members; the members of a key are spread over fan_in**2 lanes.

    The first tree merges (key, member) over the splits to at most fan_in states
    each. These move to the lane of their member, where the last of them meet and
    are counted without a further shuffle.
    """
    state = df.select(F.col(key).alias("key_value"), F.col(member).alias("__member"), F.lit(1).cast("long").alias("n_rows"), F.col(size).alias("n_bytes"), F.spark_partition_id().alias(LANE))
    sums = ["n_rows", "n_bytes"]
    pairs = tree_levels(state, ["key_value", "__member"], sums, df.rdd.getNumPartitions(), fan_in, until=fan_in)[-1]
    moved = pairs.withColumn(LANE, F.pmod(F.xxhash64("__member"), F.lit(fan_in**2)).cast("int")).repartition("key_value", LANE)
    members = moved.groupBy("key_value", LANE, "__member").agg(*(F.sum(n).alias(n) for n in sums))
    return members.groupBy("key_value", LANE).agg(*(F.sum(n).alias(n) for n in sums), F.count("__member").alias("n_members"))


def key_profile(df: DataFrame, key: str, size: str, member: str, fan_in: int = 32) -> DataFrame:
    """For every key: n_rows, n_bytes and n_members, the exact number of distinct non-null members.

    A hot key is spread over its members' lanes and a hot pair of key and member
    over the splits; the second tree merges the lanes of a key in two rounds. Rows
    whose key is null form one key; null sizes add nothing, so n_bytes is null
    only where every size is.
    """
    state = member_lanes(df, key, size, member, fan_in)
    return tree_levels(state, ["key_value"], ["n_rows", "n_bytes", "n_members"], fan_in**2, fan_in)[-1].drop(LANE)


def heavy_keys(profile: DataFrame, total: int, share: float = 0.01) -> DataFrame:
    """The non-null keys that hold at least `share` of `total` rows."""
    return profile.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share * total)))
