import random
from itertools import combinations

import pytest

from discatlas.llm import setpairs

SCHEMA = "group string, id long, value string"


def brute(rows, t, least):
    sets = {}
    for g, i, v in rows:
        if g is not None and i is not None and v is not None:
            sets.setdefault((g, i), set()).add(v)
    out = set()
    for (g, a), (h, b) in combinations(sorted(sets), 2):
        x, y = sets[(g, a)], sets[(h, b)]
        if g == h and min(len(x), len(y)) >= least and len(x & y) >= t * len(x | y) - 1e-9:
            out.add((g, a, b))
    return out


def make(rng, families, per, size):
    rows, n = [], 0
    for f in range(families):
        base = [f"v{f}-{i}" for i in range(size)]
        for _ in range(per):
            n += 1
            own = [v for v in base if rng.random() > 0.12] + [f"x{n}-{i}" for i in range(rng.randint(0, 2))]
            rows += [("g" if f % 2 else "h", n, v) for v in own]
    return rows


def run(spark, rows, **kw):
    return sorted((r["group"], r["left_id"], r["right_id"]) for r in setpairs.similar_sets(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def test_recall_against_brute_force(spark):
    rng = random.Random(1)
    rows = make(rng, 60, 6, 14)
    expected = brute(rows, 0.6, 4)
    got = run(spark, rows)
    assert set(got) <= expected and len(got) == len(set(got))
    assert len(got) >= 0.995 * len(expected) > 300


def test_crowded_neighbourhoods_are_exact(spark):
    rng = random.Random(2)
    rows = make(rng, 2, 60, 12)
    got = run(spark, rows, crowd=4)
    assert set(got) == brute(rows, 0.6, 4)


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_small_sets_when_everything_is_crowded(spark, t):
    rng = random.Random(3)
    rows = [("g", i, f"v{rng.randint(0, 9)}") for i in range(120) for _ in range(rng.randint(3, 9))]
    assert set(run(spark, rows, similarity=t, crowd=1)) == brute(rows, t, 4)


def test_copies_ties_and_edges(spark):
    a = [f"a{i}" for i in range(5)]
    rows = [("g", 1, v) for v in a] + [("g", 2, v) for v in a] + [("g", 3, v) for v in [*a, "b"]] + [("h", 4, v) for v in a] + [("g", 5, v) for v in a[:3]]
    rows += [("g", 1, "a0"), ("g", None, "a0"), (None, 1, "a0"), ("g", 7, None), ("g", 8, ""), ("g", 3, "b")]
    # 5/6, exactly 0.6 and equal sets count; other groups and sets of three values don't.
    rows += [("g", 20, f"t{i}") for i in range(4)] + [("g", 21, f"t{i}") for i in (0, 1, 2, 9)]
    assert run(spark, rows) == [("g", 1, 2), ("g", 1, 3), ("g", 2, 3), ("g", 20, 21)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n long, vh long")
    classes = {(r["group"], r["id"]): r["set"] for r in setpairs.classes(df, 4)[1].collect()}
    assert classes == {("g", 1): 1, ("g", 2): 1, ("g", 3): 3, ("h", 4): 4, ("g", 20): 20, ("g", 21): 21}
    assert run(spark, []) == []


def test_a_huge_set(spark):
    rows = [("g", 1, f"v{i}") for i in range(20_000)] + [("g", 2, f"v{i}") for i in range(15_000)] + [("g", 3, f"v{i}") for i in range(5)]
    assert run(spark, rows) == [("g", 1, 2)]


def test_depth_follows_the_recall():
    assert setpairs.depth_for(0.6, 32, 0.999) == 3
    assert setpairs.depth_for(0.6, 32, 0.9999) == 2
    assert setpairs.depth_for(0.9, 32, 0.999) == 8
    with pytest.raises(ValueError):
        setpairs.depth_for(0, 8, 0.9)


def test_prefixes_of_large_sets(spark, monkeypatch):
    monkeypatch.setattr(setpairs, "SMALL", 500)
    rng = random.Random(6)
    rows = []
    for family in range(3):
        base = [f"f{family}-{i}" for i in range(800)]
        for k in range(4):
            rows += [("g", family * 10 + k, v) for v in base if rng.random() > 0.1] + [("g", family * 10 + k, f"c{i}") for i in range(100)]
    assert set(run(spark, rows, crowd=1)) == brute(rows, 0.6, 4)


def test_popular_values_make_no_candidates(spark):
    popular = ["p1", "p2", "p3"]
    rows = [("g", i, v) for i in range(3000) for v in [*popular, *(f"u{i}-{k}" for k in range(4))]]
    assert run(spark, rows, crowd=4) == []


def test_recall_is_measured_and_prefixes_shorten(spark, monkeypatch):
    found = spark.createDataFrame([("g", i, i + 1, 9, 10) for i in range(4000)], "group string, left long, right long, n_common long, n_union long")
    reached = setpairs.measured(found, 32, 8, 3, 0.6)
    assert reached[3] > 0.9999 > 0.999 > reached[8] > 0.99 and sorted(reached.values(), reverse=True) == [reached[d] for d in range(3, 9)]
    assert set(setpairs.measured(found.limit(0), 32, 8, 3, 0.6).values()) == {0.0}
    asked = []
    whole = setpairs.neighbours
    monkeypatch.setattr(setpairs, "neighbours", lambda runs, low, high, t: asked.append((low, high)) or whole(runs, low, high, t))
    run(spark, make(random.Random(5), 60, 6, 14), recall=0.99)
    assert asked[0] == (8, 8) and asked[1:] and all(a[0] - 1 == b[1] for a, b in zip(asked, asked[1:]))


def test_crowded_classes_go_to_a_deeper_forest(spark, monkeypatch):
    depths = []
    whole = setpairs.forest
    monkeypatch.setattr(setpairs, "forest", lambda sketch, floor, crowd: depths.append(floor) or whole(sketch, floor, crowd if floor == 3 else 1000))
    monkeypatch.setattr(setpairs, "crowded_pairs", lambda *_: pytest.fail("the deeper forest is enough here"))
    rows = [("g", i, v) for i in range(100) for v in [*(f"c{k}" for k in range(8)), *(f"u{i // 2 if i < 40 else i}-{k}" for k in range(7)), f"x{i}"]]
    expected = brute(rows, 0.6, 4)
    assert len(expected) == 20 and set(run(spark, rows, crowd=10)) == expected and depths == [3, 5]


def test_neighbours_have_the_common_prefix(spark):
    rng = random.Random(4)
    lanes = lambda: [rng.randint(0, 2) for _ in range(8)]
    signatures = [lanes() for _ in range(300)]
    pack = lambda four: int.from_bytes(b"".join((x * 30_000).to_bytes(2, "big") for x in four), "big", signed=True)
    rows = [("g", i, 5 + i % 2, 0, pack(s[:4]), pack(s[4:])) for i, s in enumerate(signatures)]
    df = spark.createDataFrame(rows, "group string, set long, n long, tree short, hi long, lo long")
    runs, crowded = setpairs.forest(df, 2, 1000)
    assert crowded is None

    def prefix(a, b):
        return next((k for k in range(8) if a[k] != b[k]), 8)

    for low, high in [(2, 8), (3, 5), (6, 8)]:
        got = {(r["left"], r["right"]) for r in setpairs.neighbours(runs, low, high, 0.5).collect()}
        assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if low <= prefix(signatures[i], signatures[j]) <= high}


def test_many_copies_are_listed_over_lanes(spark, monkeypatch):
    monkeypatch.setattr(setpairs, "LANE", 7)
    rows = [("g", i, f"v{k}") for i in range(50) for k in range(4)]
    assert run(spark, rows) == [("g", a, b) for a in range(50) for b in range(a + 1, 50)]
