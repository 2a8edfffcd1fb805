import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from discatlas.operators import orphans

DAY = datetime(2024, 1, 1)
REFS = "row_id long, key string, period string, arrived timestamp_ntz"
TARGETS = "key string, deleted boolean, arrived timestamp_ntz"


def brute(refs, targets):
    out = set()
    for row, key, period, arrived in refs:
        if key is None:
            continue
        mine = [t for t in targets if t[0] == key]
        live = [t for t in mine if not t[1]]
        if not mine:
            out.add((row, period, "missing"))
        elif not live:
            out.add((row, period, "deleted"))
        else:
            first = min((t[2] for t in live if t[2]), default=None)
            if first and arrived and first > arrived:
                out.add((row, period, "late"))
    return out


def run(spark, refs, targets):
    return sorted(map(tuple, orphans.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)).collect()), key=repr)


def test_random_references(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(60)]
    targets = [(rng.choice([*keys[:40], None]), rng.choice([True, False, None]), DAY + timedelta(days=rng.randint(0, 60))) for _ in range(80)]
    refs = [(i, rng.choice([*keys, None, "k1", "k1", "k1", "k50"]), rng.choice(["2024-01", "2024-02", None, ""]), rng.choice([None, DAY + timedelta(days=rng.randint(0, 60))])) for i in range(500)]
    assert run(spark, refs, targets) == sorted(brute(refs, targets), key=repr)


def test_states_and_ties(spark):
    targets = [("a", False, DAY), ("b", True, DAY), ("c", True, DAY), ("c", False, DAY + timedelta(1))]
    refs = [(1, "a", "p", DAY), (2, "b", "p", DAY), (3, "c", "p", DAY), (4, "d", "p", DAY), (5, "c", "p", DAY + timedelta(1)), (6, None, "p", DAY)]
    assert run(spark, refs, targets) == [(2, "p", "deleted"), (3, "p", "late"), (4, "p", "missing")]


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("a", False, DAY)]) == []
    assert run(spark, [(1, "a", "p", DAY)], []) == [(1, "p", "missing")]
    refs = spark.createDataFrame([(1, "a", "p", DAY, "x", 1)], REFS + ", state string, since int")
    targets = spark.createDataFrame([("b", False, DAY, 1)], TARGETS + ", present int")
    assert [tuple(r) for r in orphans.orphans(refs, targets).collect()] == [(1, "p", "missing")]


@pytest.mark.parametrize("bits", [[], [0], [5, 6, 7, 8], list(range(0, 32768)), list(range(0, 32768, 2)), [0, 32767], list(range(100, 9000)) + [20000]])
def test_containers_round_trip(bits):
    packed = orphans.pack(np.array(bits, dtype=np.int64))
    assert list(np.flatnonzero(orphans.unpack(packed))) == bits
    assert len(packed) <= 4097


def test_ranges_overflow_into_further_ones(spark, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_BITS", 64)
    keys = spark.range(1000).selectExpr("concat('k', id) AS key")
    rows = orphans.encode(keys, 10).collect()
    assert len({(r["range"], r["position"]) for r in rows}) == 1000
    assert max(r["position"] for r in rows) < 64


def test_sparse_positions_are_brought_together_before_bitmaps_are_built(spark):
    # A million keys over 32 ranges, 48 months and 50 tasks: whole bitmaps would be many times the positions.
    assert orphans.sparse(1_000_000, 32 * 48, 50, 2)
    assert not orphans.sparse(1_000_000, 32, 50, 2) and not orphans.sparse(0, 1, 8, 2)
    df = spark.range(20_000).selectExpr("id % 500 AS range", "concat('m', id % 12) AS period", "cast(id / 500 AS int) AS position").repartition(8)
    made = {by_range: orphans._bitmap(df, ["range", "period"], {"referred": "true"}, by_range) for by_range in (True, False)}
    plans = {k: v._jdf.queryExecution().executedPlan().toString() for k, v in made.items()}
    # No exchange after the aggregation: only set bits are shuffled.
    assert plans[True].count("Exchange hashpartitioning(range") == 1 and "partial_bitmap" in plans[True].split("Exchange hashpartitioning(range")[0]
    rows = {k: sorted((r["range"], r["period"], bytes(r["referred"])) for r in v.collect()) for k, v in made.items()}
    assert rows[True] == rows[False]


@pytest.mark.parametrize("most", [0, 100_000])
def test_a_hot_orphan_key(spark, monkeypatch, most):
    monkeypatch.setattr(orphans, "HOT_ROWS", 50)
    monkeypatch.setattr(orphans, "MOST_HOT", most)
    refs = [(i, "gone" if i % 3 else f"k{i}", None if i % 2 else "p", DAY) for i in range(900)]
    assert run(spark, refs, [("k0", False, DAY)]) == sorted(brute(refs, [("k0", False, DAY)]), key=repr)
