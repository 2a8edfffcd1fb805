import random

import numpy as np
import pytest

from discatlas.llm import chunking, tokens

PATH = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"


def prose(rng, sentences):
    words = "disc sector catalogue copies the of reads !Boot größe été slowly 地図 tape".split()
    out = []
    for _ in range(sentences):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))).capitalize() + rng.choice([". ", ".\n", ".\n\n", "! ", ".\r\n\r\n"]))
    return "".join(out)


TEXTS = {
    "prose": prose(random.Random(1), 900),
    "one word": "a" * 40_000,
    "spaces": " " * 3000 + "x" + "\n" * 5000,
    "no spaces": "地図書類" * 4000,
    "emoji": "👩‍👩‍👧" * 1500,
    "lines": "ab12\n" * 4000,
    "specials": "<|endoftext|> " * 600,
    "mixed": prose(random.Random(2), 200) + "b64" * 5000 + prose(random.Random(3), 200),
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(1024, 64), (100, 20), (64, 0), (128, 32), (64, 16), (32, 8), (16, 4), (16, 7), (8, 3)])
def test_pieces_cover_the_text(name, limit, overlap):
    text = TEXTS[name]
    got = chunking.split(text, limit, overlap, PATH)
    assert len(tokens.encode(text, PATH)) > limit and len(got) > 1
    ids = tokens.encode(text, PATH)
    data = b""
    at = 0
    offsets = tokens.offsets(ids, PATH)
    for i, (over, size, piece) in enumerate(got):
        assert size == len(tokens.encode(piece, PATH)) <= limit
        assert over == 0 if i == 0 else over <= overlap
        raw = piece.encode()
        start = offsets.index(len(data)) - over
        shared = len(data) - offsets[start]
        assert data[len(data) - shared :] == raw[:shared]
        assert len(raw) > shared
        data += raw[shared:]
        at += 1
    assert data.decode() == text


def test_cuts_are_natural_where_possible():
    got = chunking.split(TEXTS["prose"], 1024, 64, PATH)
    ends = [piece[-1] for _, _, piece in got[:-1]]
    assert all(e in "\n.!? " for e in ends)
    assert sum(piece.endswith("\n") for _, _, piece in got[:-1]) >= 0.8 * len(ends)
    sizes = [s for _, s, _ in got]
    assert min(sizes) > 0.5 * max(sizes)
    assert all(over > 0 for over, _, _ in got[1:])


@pytest.mark.parametrize("shares", [(0.02, 0.05, 0.1, 0.6, 0.2, 0.03), (0, 0, 0, 0, 0.95, 0.05), (0.3, 0.2, 0.2, 0.2, 0.1, 0), (0.001, 0, 0.005, 0.7, 0.294, 0)])
@pytest.mark.parametrize("block", [3, 64])
def test_dynamic_program_is_optimal_over_all_boundaries(shares, block, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", block)
    rng = np.random.default_rng(0)
    for limit in (8, 16, 32, 64, 128):
        for overlap in (0, limit // 16, limit // 4, (limit - 1) // 2):
            total = int(rng.integers(limit + 1, limit * 5))
            kind = rng.choice(6, total - 1, p=shares)

            def begin(cut, kind=kind, overlap=overlap):
                window = range(max(1, cut - overlap), cut)
                return next((c for most in (3, 4) for c in window if kind[c - 1] <= most), cut)

            count = max(2, -(-(total - overlap) // (limit - overlap)))
            ideal = (total + (count - 1) * overlap) / count
            best = {0: 0.0}
            for end in [c for c in range(1, total) if kind[c - 1] <= 4] + [total]:
                options = [price + ((end - (begin(s) if s else 0) - ideal) / ideal) ** 2 for s, price in best.items() if end - (begin(s) if s else 0) <= limit]
                if options:
                    best[end] = min(options) + (chunking.PENALTIES[kind[end - 1]] if end < total else 0)
            if total not in best:
                continue
            spans = chunking.cuts(kind, total, limit, overlap)
            price = sum(((b - a - ideal) / ideal) ** 2 for a, b in spans) + sum(chunking.PENALTIES[kind[b - 1]] for _, b in spans[:-1])
            assert price == pytest.approx(best[total]) and max(b - a for a, b in spans) <= limit


@pytest.mark.parametrize(("limit", "overlap"), [(8, 3), (16, 4), (32, 8), (64, 16), (128, 32)])
def test_every_piece_overlaps_the_one_before(limit, overlap):
    rng = random.Random(limit)
    for _ in range(30):
        got = chunking.split(prose(rng, 30), limit, overlap, PATH)
        assert max(size for _, size, _ in got) <= limit
        assert all(0 < over <= overlap for over, _, _ in got[1:])


def test_operator_and_edges(spark):
    rows = [(1, TEXTS["prose"], 5), (2, "short", 5), (3, None, None), (4, "", 0), (1, TEXTS["prose"], 5), (None, TEXTS["lines"], 5), (6, " ".join(["a"] * 1024), 1), (7, " ".join(["a"] * 1025), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_no int")
    got = chunking.pieces(df).collect()
    heads = sorted((r["doc_id"] for r in got if r["piece_no"] == 0), key=str)
    assert heads == [1, 1, 7, None]
    assert chunking.pieces(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chunking.pieces(df, 64, 40)


def test_long_white_space_is_encoded_as_before():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "x", "Ab", "　", "\x85", "9", ".", "'s"]) * rng.randint(1, 6) for _ in range(rng.randint(0, 12)))
        assert tokens.encode(text, PATH, long_run=3) == tokens.encoding(PATH).encode_ordinary(text)
    assert len(tokens.encode("a" + " " * 2_000_000 + "b", PATH)) > 1000


def test_very_long_text():
    text = prose(random.Random(9), 20_000)
    assert len(text) > 1_000_000
    got = chunking.split(text, 1024, 64, PATH)
    assert sum(s for _, s, _ in got) > 200_000
