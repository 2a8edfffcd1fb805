"""References whose target is missing, deleted or late, by compressed bitmaps.

Keys of both sides get integer codes: a range, by hash, and a dense position in
it. Per range and period the references form a bitmap, the targets one per
range; reference AND-NOT target leaves the orphans, whose bits are decoded to
keys and joined back to the referring rows, where lateness is checked exactly.

Bitmaps are stored as sorted 16-bit positions, as runs or as plain bits,
whichever is shortest. One has at most RANGE_BITS bits, so the work of a task
doesn't depend on how often a key is referred to. While they are built they are
plain bits of a fixed size; where keys are sparse the positions are brought
together by range first, so that no bits but those set are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discatlas.runtime import stored

RANGE_BITS = 32_768
#: Rows of one orphan key and period that are joined back in one place; of more, as many parts are made.
HOT_ROWS = 65_536
#: So many hot keys are sent to every task at most; beyond, adaptive execution has to split them.
MOST_HOT = 100_000
#: Bytes of a plain bitmap and of one position as they are shuffled.
BITMAP_BYTES, POSITION_BYTES = RANGE_BITS // 8, 32


def pack(bits: np.ndarray) -> bytes:
    """The shortest of three containers for sorted positions below 65536."""
    bits = np.asarray(bits, dtype="<u2")
    if not len(bits):
        return b"A"
    breaks = np.flatnonzero(np.diff(bits.astype(np.int32)) != 1)
    starts = bits[np.concatenate(([0], breaks + 1))]
    ends = bits[np.concatenate((breaks, [len(bits) - 1]))]
    plain = RANGE_BITS // 8 if bits[-1] < RANGE_BITS else 8192
    if 4 * len(starts) <= min(2 * len(bits), plain):
        return b"R" + np.column_stack((starts, ends)).astype("<u2").tobytes()
    if 2 * len(bits) <= plain:
        return b"A" + bits.tobytes()
    flags = np.zeros(plain * 8, dtype=np.uint8)
    flags[bits] = 1
    return b"B" + np.packbits(flags, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The positions of a container, as flags over RANGE_BITS positions."""
    flags = np.zeros(RANGE_BITS, dtype=bool)
    if packed is None:
        return flags
    body = packed[1:]
    if packed[:1] == b"B":
        flags[:] = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")[:RANGE_BITS]
    elif packed[:1] == b"A":
        flags[np.frombuffer(body, "<u2")] = True
    else:
        for start, end in np.frombuffer(body, "<u2").reshape(-1, 2):
            flags[start : int(end) + 1] = True
    return flags


def _compress(plain: pd.Series) -> pd.Series:
    return plain.map(lambda b: None if b is None else pack(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little"))))


def sparse(rows: int, groups: int, tasks: int, bitmaps: int) -> bool:
    """Whether the partial bitmaps of all tasks would take more room in a shuffle than the positions they hold."""
    return min(rows, groups * max(1, tasks)) * bitmaps * BITMAP_BYTES > rows * POSITION_BYTES


def _bitmap(coded: DataFrame, keys: list[str], columns: dict[str, str], by_range: bool) -> DataFrame:
    """Compressed bitmaps of the positions per keys; columns: name -> condition. by_range brings the positions of a range together first."""
    coded = coded.repartition("range") if by_range else coded
    made = coded.groupBy(*keys).agg(*(F.bitmap_construct_agg(F.when(F.expr(c), F.col("position").cast("long"))).alias(n) for n, c in columns.items()))
    compress = F.pandas_udf(_compress, "binary")
    return made.select(*keys, *(compress(n).alias(n) for n in columns))


def ranges_for(n_keys: int) -> int:
    """A power of two of ranges, in each of which about n_keys / ranges keys leave some room."""
    return 1 << max(0, math.ceil(math.log2(max(n_keys, 1) / (RANGE_BITS * 0.75))))


def encode(keys: DataFrame, n_keys: int) -> DataFrame:
    """Dictionary of distinct keys: key, range, position. n_keys, about their number, sets the ranges."""
    ranges = ranges_for(n_keys)
    hashed = keys.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    order = Window.partitionBy("range").orderBy("key")
    numbered = hashed.withColumn("__nth", F.row_number().over(order) - 1)
    # A range that chance fills beyond a bitmap goes on in a further one.
    return numbered.withColumn("range", F.col("range").cast("long") + F.lit(ranges).cast("long") * F.floor(F.col("__nth") / RANGE_BITS)).withColumn("position", (F.col("__nth") % RANGE_BITS).cast("int")).drop("__nth")


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[pd.DataFrame] = []
        for row in batch.itertuples(index=False):
            referred, on_time, present, live = (unpack(getattr(row, n)) for n in ("referred", "on_time", "present", "live"))
            for state, bits in (("missing", referred & ~present), ("deleted", referred & present & ~live), ("late", referred & live & ~on_time)):
                found = np.flatnonzero(bits)
                if len(found):
                    out.append(pd.DataFrame({"range": row.range, "period": row.period, "position": found.astype(np.int32), "state": state}))
        yield pd.concat(out) if out else pd.DataFrame({"range": pd.Series(dtype="int64"), "period": pd.Series(dtype="object"), "position": pd.Series(dtype="int32"), "state": pd.Series(dtype="object")})


def orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of refs whose target is missing, deleted or late: row_id, period, state.

    refs: row_id, key, period, arrived; targets: key, deleted (boolean), arrived.
    One row of refs per row_id. Null keys refer to nothing and are never orphans;
    null keys of targets are no targets. A target counts as late if the first of
    those not deleted arrived after the referring row; unknown arrivals are not
    late. Several targets under one key count together. Either table may be
    empty.
    """
    refs = refs.select("row_id", "key", "period", "arrived").where("key IS NOT NULL")
    by_key = targets.where("key IS NOT NULL").groupBy("key").agg(F.max(F.when(~F.coalesce("deleted", F.lit(False)), F.lit(True))).alias("live"), F.min(F.when(~F.coalesce("deleted", F.lit(False)), F.col("arrived"))).alias("since"), F.lit(True).alias("present"))
    by_period = stored(refs.groupBy("key", "period").agg(F.min("arrived").alias("arrived"), F.count(F.lit(1)).alias("n_rows")))
    nothing = [F.lit(None).cast(by_key.schema[c].dataType).alias(c) for c in ("present", "live", "since")]
    keys = by_period.select("key", *nothing).unionByName(by_key.select("key", "present", "live", "since"))
    merged = stored(keys.groupBy("key").agg(F.max("present").alias("present"), F.max("live").alias("live"), F.min("since").alias("since")))
    n_keys, tasks = merged.count(), int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary = stored(encode(merged, n_keys))
    n_refs, periods = by_period.agg(F.count(F.lit(1)), F.approx_count_distinct("period")).first()
    groups = ranges_for(n_keys) * (periods + 1)
    coded = by_period.join(dictionary, "key").select("range", "period", "position", F.expr("since IS NULL OR arrived IS NULL OR since <= arrived").alias("on_time"))
    referred = _bitmap(coded, ["range", "period"], {"referred": "true", "on_time": "on_time"}, sparse(n_refs, groups, tasks, 2))
    held = _bitmap(dictionary.where("present"), ["range"], {"present": "present", "live": "live"}, sparse(n_keys, ranges_for(n_keys), tasks, 2))
    left = referred.join(held, "range", "left").select("range", "period", "referred", "on_time", "present", "live")
    bits = left.mapInPandas(_survivors, "range long, period string, position int, state string")
    decoded = bits.join(dictionary.select("range", "position", "key", "since"), ["range", "position"]).select("key", _never_null("period").alias("__period"), "state", "since")
    rows = refs.withColumn("__period", _never_null("period"))
    back = _join_back(rows, decoded, by_period.where(F.col("n_rows") > HOT_ROWS))
    return back.where("state != 'late' OR since > arrived").select("row_id", "period", "state")


def _never_null(period: str) -> Column:
    """A period as a join key, in which none equals none and nothing else."""
    return F.when(F.col(period).isNull(), "").otherwise(F.concat(F.lit("="), period))


def _join_back(rows: DataFrame, decoded: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of decoded keys and periods; rows of a hot key are salted into as many parts as its number asks for."""
    on = ["key", "__period"]
    hot = hot.select("key", _never_null("period").alias("__period"), F.ceil(F.col("n_rows") / HOT_ROWS).cast("int").alias("__parts"))
    if not 0 < hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
        return rows.join(decoded, on)
    parts = F.coalesce("__parts", F.lit(1))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64("row_id"), parts).cast("int")).drop("__parts")
    spread = decoded.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return salted.join(spread, [*on, "__salt"])
