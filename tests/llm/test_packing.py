import random

import pytest

from discatlas.llm import packing, tokens

PATH = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"


def test_differencing_balances():
    # The textbook case: 8 7 6 5 4 differ by 2 after two-way differencing.
    groups = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in groups) == [14, 16]
    rng = random.Random(1)
    sizes = [rng.randint(1, 400) for _ in range(2000)]
    sums = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 60)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 4
    assert sorted(i for g in packing.difference(sizes, 60) for i in g) == list(range(2000))


@pytest.mark.parametrize("sizes", [[], [0], [5], [10, 10, 10], [6] * 7, [0, 0, 10, 0], list(range(1, 11)), [9, 9, 2, 2, 1]])
def test_fill_keeps_the_capacity(sizes):
    groups = packing.fill(sizes, 10)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 10 for g in groups)
    assert all(groups)


def test_fill_is_tight_on_realistic_sizes():
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(5.6, 0.9)) + 1) for _ in range(900)]
    groups = packing.fill(sizes, 2048)
    assert sum(sizes) / (2048 * len(groups)) > 0.97
    with pytest.raises(ValueError):
        packing.fill([11], 10)


def test_operator(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["disc", "größe", "地図", "reads"]) for _ in range(rng.choice([3, 50, 400, 900]))) for i in range(300)}
    texts[1000] = "emoji 👩‍👩‍👧 " * 900
    rows = [(i, t, 1) for i, t in texts.items()] + [(2000, "", 1), (2001, None, 1), (5, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, position int")
    got = packing.pack(df, capacity=512, per_window=16).collect()
    filled, seen = {}, {}
    for r in sorted(got, key=lambda r: (r["container_id"], r["position"])):
        at, place = filled.get(r["container_id"], (0, 0))
        assert (r["offset"], r["position"]) == (at, place)
        filled[r["container_id"]] = (at + r["n_tokens"], place + 1)
        seen.setdefault(r["doc_id"], []).append((r["piece_no"], r["token_start"], r["n_tokens"]))
    assert max(at for at, _ in filled.values()) <= 512
    assert sum(at for at, _ in filled.values()) / (512 * len(filled)) > 0.9
    assert len(seen[5]) == 2 * len(set(seen[5])) and seen[2000] == [(0, 0, 0)] and seen[2001] == [(0, 0, 0)]
    for i, t in texts.items():
        total = len(tokens.encode(t, PATH))
        parts = sorted(seen[i])
        if i != 5:
            assert sum(n for _, _, n in parts) == total and [p for p, _, _ in parts] == list(range(len(parts)))
        assert len(parts) == 1 or total > 512 or i == 5


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
