import pytest

from discatlas.llm import encodings as enc

CLEAN = ["Größe", "Übung", "Straße", "Français", "Élève", "Señal", "Niño", "Ångström", "Smörgås", "Háček", "Przykład", "Żółw", "Игры", "Письма", "Словарь", "Музыка", "データ", "地図", "ÇÃO", "PÃES", "20°C", "½price", "Tom’s", "“Draft”", "Notes–old", "α−β", "Rock’n’Roll"]
MISREADINGS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("mac_roman", "cp1252")]


def garble(text, written, read):
    try:
        data = text.encode(written)
        out = "".join(bytes([b]).decode(read, "strict") if not (read == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else chr(b) for b in data)
    except UnicodeError:
        return None
    return out if out != text and enc.unread(out, ((read, written),)) == text else None


def corpus():
    """Every word in many names; some names also garbled, most beside the clean one."""
    rows, truth, n = [], {}, 0
    for w, word in enumerate(CLEAN):
        for k in range(12):
            n += 1
            rows.append((n, f"{word}_{'kbzr'[k % 4]}ab{w}x{k}", f"Disc/App{k}/{word}_{'kbzr'[k % 4]}ab{w}x{k}"))
    for m, (written, read) in enumerate(MISREADINGS):
        for w, word in enumerate(CLEAN):
            bad = garble(word, written, read)
            if bad is None:
                continue
            n += 1
            stem = f"_{'kbzr'[0]}ab{w}x0" if (m + w) % 2 else f"_only{m}n{w}"
            rows.append((n, bad + stem, f"Disc/{bad}{stem}/x"))
            truth[(n, "filename")] = word + stem
            truth[(n, "path")] = f"Disc/{word}{stem}/x"
    return rows, truth


def test_most_garbled_names_come_back_and_right_ones_stay(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, filename string, path string, key int")
    got = {(r["key"], r["field_name"]): r["restored"] for r in enc.restore(df, "id", ["filename", "path"]).collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    wrong = [k for k in got if got[k] != truth.get(k)]
    assert right >= 0.93 * len(truth)
    assert len(wrong) <= 0.03 * len(truth)


def test_twice_garbled_and_lost(spark):
    rows, _ = corpus()
    twice = "Größe_kab0x1".encode().decode("cp1252").encode().decode("cp1252")
    more = [(9001, twice, None), (9002, "Gr��e", "a/Gr�e/Übung_kab1x1"), (9003, None, ""), (9004, "plain", "plain/ascii")]
    df = spark.createDataFrame(rows + more, "id long, filename string, path string")
    got = {(r["key"], r["field_name"]): r["restored"] for r in enc.restore(df, "id", ["filename", "path"]).where("key > 9000").collect()}
    assert got == {(9001, "filename"): "Größe_kab0x1", (9002, "filename"): "", (9002, "path"): ""}


def test_alignment_names_the_chain():
    found = [enc.CHAINS[i] for i in enc.explain("GrÃ¶ÃŸe_x", "Größe_x")]
    assert (("cp1252", "utf-8"),) in found
    assert enc.explain("Größe_x", "GrÃ¶ÃŸe_x") == []
    assert enc.explain("abc", "abd") == [] and enc.explain("é_a", "a_é") == []


@pytest.mark.parametrize("text", ["", "ascii", "Größe", "\x85", "a/" * 50_000 + "é"])
def test_unread_never_fails(text):
    for chain in enc.CHAINS:
        enc.unread(text, chain)


def test_no_twins_and_empty(spark):
    df = spark.createDataFrame([(1, "GrÃ¶ÃŸe", None), (2, "x�", None)], "id long, filename string, path string")
    assert [tuple(r) for r in enc.restore(df, "id", ["filename", "path"]).collect()] == [(2, "filename", "")]
    assert enc.restore(df.where("false"), "id", ["filename", "path"]).count() == 0
