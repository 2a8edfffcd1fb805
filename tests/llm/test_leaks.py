import random

import pytest

from discatlas.llm import leaks


def brute(doc, item, run):
    a, b = leaks.words(doc), leaks.words(item)
    grams = {tuple(b[i : i + run]) for i in range(len(b) - run + 1)}
    return any(tuple(a[i : i + run]) in grams for i in range(len(a) - run + 1))


@pytest.mark.parametrize("run", [3, 4, 5, 8, 13])
def test_search_against_brute_force(run):
    rng = random.Random(run)
    vocabulary = "a b c d".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(12)]
    patterns = leaks.Patterns(items, run)
    for _ in range(300):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            source = leaks.words(rng.choice(items)[1])
            at = rng.randint(0, len(source))
            base[rng.randint(0, len(base)) : 0] = source[at : at + rng.randint(run - 1, run + 1)]
        text = rng.choice([" ", "\n", ", ", "--"]).join(base)
        got = {patterns.items[i][0] for i in patterns.search(text)}
        assert got == {n for n, t in items if brute(text, t, run)}


def test_boundary_of_thirteen_words(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(1, " ".join(f"w{i}" for i in range(7, 20))), (2, " ".join(f"w{i}" for i in range(7, 19))), (3, "X: " + "... ".join(f"W{i}" for i in range(27, 40))), (4, None), (5, ""), (6, item * 1 + " tail"), (1, " ".join(f"w{i}" for i in range(7, 20)))]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, None), (12, "short"), (10, item)], "item_id long, text string")
    assert sorted(map(tuple, leaks.leaks(df, items).collect())) == [(1, 10), (3, 10), (6, 10)]
    assert sorted(map(tuple, leaks.leaks(df, items, block_bytes=64).collect())) == [(1, 10), (3, 10), (6, 10)]
    assert leaks.leaks(df.where("false"), items).count() == 0
    assert leaks.leaks(df, items.where("false")).count() == 0


def test_very_long_text():
    item = " ".join(f"w{i}" for i in range(30))
    text = "the " * 1_000_000 + " ".join(f"w{i}" for i in range(13))
    assert leaks.Patterns([(1, item)]).search(text) == {0}
    assert leaks.Patterns([(1, "the " * 60)]).search(text) == {0}
