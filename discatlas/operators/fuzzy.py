"""Distances between locality-sensitive digests, and the neighbours of a query set.

Digests are hexadecimal: a checksum byte, a length byte, a byte of two quartile
ratios, then two bits for each of 128 buckets, as the published scheme for
locality-sensitive hashing of files lays them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER, BODY = 3, 32


def unpack(digests: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are digests, bytes of those): a leading version mark 'T1' is left out."""
    good, rows = [], []
    for i, text in enumerate(digests):
        text = (text or "").removeprefix("T1")
        if len(text) == 2 * (HEADER + BODY):
            try:
                rows.append(np.frombuffer(bytes.fromhex(text), np.uint8))
                good.append(i)
            except ValueError:
                continue
    return np.array(good, dtype=np.int64), np.array(rows, dtype=np.uint8).reshape(-1, HEADER + BODY)


def _circular(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    apart = np.abs(a.astype(np.int32) - b.astype(np.int32))
    return np.minimum(apart, size - apart)


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Distance of one digest to many: 0 for equal, larger for less similar."""
    swap = ((many[:, :2] & 0x0F) << 4) | (many[:, :2] >> 4)
    mine = ((one[:2] & 0x0F) << 4) | (one[:2] >> 4)
    length = _circular(swap[:, 1], mine[1], 256)
    total = (swap[:, 0] != mine[0]).astype(np.int32) + np.where(length <= 1, length, length * 12)
    for shift in (0, 4):
        apart = _circular((many[:, 2] >> shift) & 15, (one[2] >> shift) & 15, 16)
        total += np.where(apart <= 1, apart, (apart - 1) * 12)
    for shift in (0, 2, 4, 6):
        apart = np.abs(((many[:, HEADER:] >> shift) & 3).astype(np.int32) - ((one[HEADER:] >> shift) & 3).astype(np.int32))
        total += np.where(apart == 3, 6, apart).sum(axis=1)
    return total


def neighbours(queries: DataFrame, rows: DataFrame, most: int = 80, block: int = 20_000) -> DataFrame:
    """Rows within a distance of the query rows: query_id, id, distance; both tables have (id, digest).

    Queries go to the workers in blocks of a fixed number, each compared with
    all rows: exact, and what is sent is bounded. Text that is no digest has no
    neighbours; a row is no neighbour of itself.
    """
    spark = rows.sparkSession
    known = queries.where("digest IS NOT NULL").select("id", "digest")
    kinds = queries.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    blocks = max(1, -(-known.count() // block))
    out = None
    for number in range(blocks):
        part = known.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        shared = spark.sparkContext.broadcast(([r["id"] for r in part], unpack([r["digest"] for r in part])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, (good, mine) = shared.value
            for batch in batches:
                at, theirs = unpack(batch["digest"].tolist())
                found = []
                for i, one in zip(good, mine, strict=True):
                    if len(at):
                        apart = distances(one, theirs)
                        for k in np.flatnonzero(apart <= most):
                            if batch["id"].iat[at[k]] != ids[i]:
                                found.append((ids[i], batch["id"].iat[at[k]], int(apart[k])))
                yield pd.DataFrame(found, columns=["query_id", "id", "distance"])

        part_found = rows.select("id", "digest").mapInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, distance int")
        out = part_found if out is None else out.unionByName(part_found)
    return out
