import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from discatlas.operators import similarity as sim

FILES = "owner long, path string, h string, size long"


def brute(rows, cap, floor):
    sets = {}
    for o, _, h, s in rows:
        if h is not None and s and s > 0:
            own = sets.setdefault(o, {})
            own[h] = min(s, own.get(h, s))
    df = Counter(h for own in sets.values() for h in own)
    out = {}
    for a, b in combinations(sorted(sets), 2):
        both = sets[a].keys() & sets[b].keys()
        if any(2 <= df[h] <= cap for h in both):
            shared = sum(min(sets[a][h], sets[b][h]) for h in both)
            union = sum(sets[a].values()) + sum(sets[b].values()) - shared
            if shared / union >= floor:
                out[(a, b)] = (shared / union, len(both), len(sets[a].keys() | sets[b].keys()), shared, union)
    return out


def rows_of(rng, owners=40):
    return [(rng.randint(1, owners), f"d/{i}", rng.choice([None, *[f"h{k}" for k in range(60)]]), rng.choice([None, 0, 5, 17])) for i in range(600)]


def test_scores_against_brute_force(spark):
    rows = rows_of(random.Random(1))
    rows = [(o, p, h, None if s is None else (len(h) * 7 if h and s else s)) for o, p, h, s in rows]
    sets = sim.content_sets(spark.createDataFrame(rows, FILES))
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in sim.weighted_jaccard(sets, cap=12).collect()}
    assert got == brute(rows, 12, 0.1) and len(got) > 20


def test_near_duplicate_discs(spark):
    common = [("GAME", 100_000), ("LOADER", 5_000), ("DATA", 50_000)]
    rows = [(o, n, n, s) for o in (1, 2) for n, s in common] + [(1, "SAVE", "SAVE1", 200), (2, "SAVE", "SAVE2", 200)]
    (row,) = sim.weighted_jaccard(sim.content_sets(spark.createDataFrame(rows, FILES))).collect()
    assert (row["shared_files"], row["union_files"], row["shared_bytes"], row["union_bytes"]) == (3, 5, 155_000, 155_400)


@pytest.mark.parametrize("owners", [50, 51])
def test_cap_is_inclusive(spark, owners):
    rows = [(o, "x", "h", 1) for o in range(owners)]
    sets = sim.content_sets(spark.createDataFrame(rows, FILES))
    assert sim.weighted_jaccard(sets).count() == (math.comb(50, 2) if owners == 50 else 0)


def test_floor_keeps_its_value(spark):
    rows = [(1, "a", "a", 10), (2, "a", "a", 10), (2, "b", "b", 90)]
    sets = sim.content_sets(spark.createDataFrame(rows, FILES))
    assert [r["score"] for r in sim.weighted_jaccard(sets, floor=0.1).collect()] == [0.1]


def test_refresh_equals_rebuild(spark):
    rng = random.Random(4)
    rows = [(o, p, h, 10) for o, p, h, _ in rows_of(rng) if h]
    before = sim.content_sets(spark.createDataFrame(rows, FILES))
    changed = [r for r in rows if r[0] not in (3, 9)] + [(3, "n", "h1", 10), (3, "n", "h2", 10), (77, "n", "h5", 10)]
    after = sim.content_sets(spark.createDataFrame(changed, FILES))
    dirty = spark.createDataFrame([(3,), (9,), (77,)], "owner long")
    cap = 10_000
    got = sim.refresh(sim.weighted_jaccard(before, cap), after, dirty, cap).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, sim.weighted_jaccard(after, cap).collect()))


def test_components(spark):
    rows = [(1, "A/B/x", "h1", 1), (1, "A/B/y", "h2", 1), (1, "A/z", "h3", 1), (1, "C/D/E/F/G/x", "h4", 1), (1, "C/D/E/F/G/y", "h5", 1), (1, "S/one", "h6", 1), (2, "top", "h1", 1), (1, "A/B/n", None, 1), (1, "A/B/z", "h9", 0)]
    got = {(r["owner"], r["root"], r["depth"], r["n_files"]) for r in sim.components(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {(1, "A", 1, 3), (1, "A/B", 2, 2), (1, "C", 1, 2)}
    few = sim.components(spark.createDataFrame(rows, FILES), most=1).collect()
    assert [r["root"] for r in few] == ["A"]


def test_component_pairs_of_partial_overlap(spark):
    first = [(1, f"A/{n}", n, 10) for n in "xyz"] + [(1, "a/b/c/d/e/!App/p", "p", 5), (1, "a/b/c/d/e/!App/q", "q", 5), (1, "a/b/c/d/r", "r", 90)]
    second = [(2, f"B/{n}", n, 10) for n in "xyw"] + [(2, "!App/p", "p", 5), (2, "!App/q", "q", 5)]
    alone = [(3, "C/x", "x", 10), (3, "C/v", "v", 1000)]
    got = {(r["a"], r["root_a"], r["b"], r["root_b"]): (r["score"], r["shared_files"], r["union_files"]) for r in sim.component_pairs(spark.createDataFrame(first + second + alone, FILES)).collect()}
    assert got == {(1, "A", 2, "B"): (0.5, 2, 4), (1, "a/b/c/d/e/!App", 2, "!App"): (1.0, 2, 2), (1, "a", 2, "!App"): (0.1, 2, 3)}


def test_component_pairs_share_uncommon_content(spark):
    rows = [(o, f"D/{n}", n, 1) for o in range(51) for n in ("everywhere", f"own{o}")]
    assert sim.component_pairs(spark.createDataFrame(rows, FILES)).count() == 0
    assert sim.component_pairs(spark.createDataFrame(rows[:100], FILES)).count() == math.comb(50, 2)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_percentiles_round_half_even(spark, n):
    values = spark.createDataFrame([(i * 10,) for i in range(1, n + 1)], "v long")
    (row,) = sim.distribution(values, "v").collect()
    assert row["n"] == n and row["total"] == (sum(range(10, 10 * n + 1, 10)) or None)
    for p in (50, 90, 95, 99, 100):
        rank = n if p == 100 else min(max(round(p / 100 * n + 0.5), 1), n)
        assert row[f"p{p}"] == (rank * 10 if n else None)


def test_idf_and_histogram(spark):
    sets = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (1, "b", 10)], "owner long, h string, size long")
    weights = {r["h"]: r["weight"] for r in sim.idf(sim.document_frequency(sets), 2).collect()}
    assert weights == {"a": pytest.approx(math.log(2)), "b": pytest.approx(math.log(3))}
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    (row,) = sim.idf_jaccard(sets, pairs, sim.idf(sim.document_frequency(sets), 2)).collect()
    assert row["score"] == pytest.approx(math.log(2) / (math.log(2) + math.log(3)))
    got = {r["bucket"]: r["n"] for r in sim.histogram(spark.createDataFrame([(0,), (1,), (5,), (9,), (100,), (None,)], "v int"), "v", (1, 5, 10)).collect()}
    assert got == {1: 1, 5: 2, 10: 1}


def test_empty(spark):
    empty = spark.createDataFrame([], FILES)
    sets = sim.content_sets(empty)
    assert sim.weighted_jaccard(sets).count() == 0 and sim.components(empty).count() == 0
    assert sim.both_directions(sim.weighted_jaccard(sets)).columns[:2] == ["owner", "other"]
    assert sets.agg(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("most", [3, 10_000])
def test_no_pair_is_lost_without_the_cap(spark, monkeypatch, most):
    monkeypatch.setattr(sim, "SMALL", most)
    rng = random.Random(3)
    popular = {f"p{i}": rng.randint(1, 300) for i in range(8)}
    sets = {o: {**{h: s for h, s in popular.items() if rng.random() < 0.8}, **{f"u{o}-{i}": rng.randint(1, 200) for i in range(rng.randint(0, 5))}} for o in range(90)}
    sets[90] = dict(sets[0])
    rows = spark.createDataFrame([(o, h, s) for o, own in sets.items() for h, s in own.items()], "owner long, h string, size long")
    expected = {}
    for a in sets:
        for b in sets:
            shared = sum(min(sets[a][h], sets[b][h]) for h in sets[a].keys() & sets[b].keys())
            union = sum(sets[a].values()) + sum(sets[b].values()) - shared
            if a < b and shared and shared / union >= 0.4:
                expected[(a, b)] = shared / union
    got = {(r["a"], r["b"]): r["score"] for r in sim.uncapped_pairs(rows, 0.4).collect()}
    assert got == pytest.approx(expected) and len(got) > 100
    assert sim.weighted_jaccard(rows, floor=0.4).count() < len(got)
    classes = {r["owner"]: (r["class_id"], r["n_copies"]) for r in sim.content_classes(rows).collect()}
    assert classes[90] == classes[0] == (0, 2) and classes[1] == (1, 1)
    assert sim.uncapped_pairs(rows.where("false")).count() == 0
