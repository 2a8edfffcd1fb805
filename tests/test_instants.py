from datetime import datetime, timedelta, timezone

import pytest

from discatlas.operators import instants

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*args, **kw):
    return (datetime(*args, tzinfo=timezone.utc, **kw) - EPOCH) // timedelta(microseconds=1)


CASES = [
    ("1994-03-02T10:11:12", "Europe/London", us(1994, 3, 2, 10, 11, 12)),
    ("1994-07-02 10:11", "Europe/London", us(1994, 7, 2, 9, 11)),
    ("1994-07-02", None, us(1994, 7, 2)),
    ("1994-03-02T10:11:12.5Z", "Asia/Tokyo", us(1994, 3, 2, 10, 11, 12, 500000)),
    ("2004-07-04T01:46:51.818-0400", None, us(2004, 7, 4, 5, 46, 51, 818000)),
    ("1995-07-05T17:04:47+01:00[Europe/London]", "Asia/Tokyo", us(1995, 7, 5, 16, 4, 47)),
    ("1/11/1996 16:56", "America/New_York", us(1996, 11, 1, 21, 56)),
    ("05/06/79", None, us(2079, 6, 5)),
    ("05/06/80", None, us(1980, 6, 5)),
    ("24-Mar-95 03:13:01", None, us(1995, 3, 24, 3, 13, 1)),
    ("01:59:06 04-Nov-2018", "America/New_York", us(2018, 11, 4, 5, 59, 6)),  # first occurrence
    ("2018-03-11 02:30:00", "America/New_York", us(2018, 3, 11, 7, 30)),  # skipped: offset before the change
    ("Dec 17 1989 12:31:08 AM", "UTC", us(1989, 12, 17, 0, 31, 8)),
    ("Dec 17 1989 12:31:08 PM", "UTC", us(1989, 12, 17, 12, 31, 8)),
    ("Wed, 14 May 2014 19:01:29 GMT", "Asia/Tokyo", us(2014, 5, 14, 19, 1, 29)),
    ("Tue, 12 May 1992 04:00:00 +0530", None, us(1992, 5, 11, 22, 30)),
    ("Mon Apr  5 14:45:14 BST 2004", None, us(2004, 4, 5, 13, 45, 14)),
    ("2006-05-16 22:55:32 AEST", None, us(2006, 5, 16, 12, 55, 32)),
    ("2006-05-16 22:55:32 IST", None, us(2006, 5, 16, 17, 25, 32)),
    ("19950205T030632Z", "Asia/Tokyo", us(1995, 2, 5, 3, 6, 32)),
    ("20180603135517", "Europe/London", us(2018, 6, 3, 12, 55, 17)),
    ("920349454", None, 920349454_000000),
    ("920349454.67", None, 920349454_670000),
    ("920349454670", None, 920349454_670000),
    ("920349454670123", None, 920349454_670123),
    ("12345678", None, 12345678_000000),
    ("&53EA287F2C", "Asia/Tokyo", int("53EA287F2C", 16) * 10_000 - 2_208_988_800_000_000),
    ("  1994-07-02  ", None, us(1994, 7, 2)),
    ("1992-02-29", None, us(1992, 2, 29)),
]
IMPOSSIBLE = ["", "-", "n/a", "unknown", "??-???-1991", "1992-02-31T10:00:00", "31/02/1993 09:15", "24/00/1995 11:20:00", "1990-13-04 12:00:00", "0000-00-00 00:00:00", "1900-02-29", "1994-07-02 25:00", "1994-07-02 10:61", "12", "12345678901", "&12", "1994-07-02 10:00:00 XYZ", "1994-07-02 10:00:00 +25:00", "13:00:00 PM", "x" * 100_000]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(r, z) for r, z, _ in CASES] + [(r, None) for r in IMPOSSIBLE] + [("1994-07-02", "No/Such")]
    df = instants.parse_instants(spark.createDataFrame(rows, "raw string, zone string"), instants.zones(spark))
    return {(r["raw"], r["zone"]): r["utc_us"] for r in df.collect()}


@pytest.mark.parametrize(("raw", "zone", "expected"), CASES)
def test_readings(parsed, raw, zone, expected):
    assert parsed[(raw, zone)] == expected


def test_impossible_text_is_null(parsed):
    assert [r for r in IMPOSSIBLE if parsed[(r, None)] is not None] == []
    assert parsed[("1994-07-02", "No/Such")] is None


def test_all_wall_clocks_agree_with_zoneinfo(spark):
    zoneinfo = pytest.importorskip("zoneinfo")
    try:
        zone = zoneinfo.ZoneInfo("Europe/Berlin")
    except zoneinfo.ZoneInfoNotFoundError:
        pytest.skip("no zone data")
    start = datetime(1995, 3, 25)
    walls = [start + timedelta(minutes=17 * i) for i in range(0, 20_000)]
    rows = [(w.strftime("%Y-%m-%d %H:%M"), "Europe/Berlin") for w in walls]
    got = {r["raw"]: r["utc_us"] for r in instants.parse_instants(spark.createDataFrame(rows, "raw string, zone string"), instants.zones(spark)).collect()}
    for w in walls:
        expected = (w.replace(tzinfo=zone, fold=0) - EPOCH) // timedelta(microseconds=1)
        assert got[w.strftime("%Y-%m-%d %H:%M")] == expected


def test_dictionary_grows_only_by_new_values(spark, tmp_path):
    store = instants.InstantDictionary(spark, f"file://{tmp_path}/d")
    rows = spark.createDataFrame([(1, "1994-07-02", None, "x"), (2, "1994-07-02", "UTC", "y"), (3, None, None, "z"), (4, "bad", "Asia/Tokyo", "z")], "id long, raw string, zone string, utc_us string")
    out = {r["id"]: r["utc_us"] for r in instants.normalise(rows, "raw", "zone", store).collect()}
    assert out == {1: us(1994, 7, 2), 2: us(1994, 7, 2), 3: None, 4: None}
    before = store.read().count()
    more = rows.union(spark.createDataFrame([(5, "1994-07-03", None, "")], rows.schema))
    instants.normalise(more, "raw", "zone", store).collect()
    assert store.read().count() == before + 1 and len(store.extensions()) == 2
    assert store.read().select("raw", "zone").distinct().count() == before + 1
    # A further run parses nothing; half a write and a doubled value change nothing.
    instants.normalise(more, "raw", "zone", store).collect()
    assert len(store.extensions()) == 2
    (tmp_path / "d" / "new-broken").mkdir()
    spark.createDataFrame([("1994-07-03", "", "", us(1994, 7, 3))], store.SCHEMA).write.parquet(f"file://{tmp_path}/d/part-zz")
    again = {r["id"]: r["utc_us"] for r in instants.normalise(more, "raw", "zone", store).collect()}
    assert again == {**out, 5: us(1994, 7, 3)} and instants.normalise(more, "raw", "zone", store).count() == 5
    by_source = instants.normalise(rows.withColumnRenamed("utc_us", "tool"), "raw", "zone", store, "tool")
    assert {r["id"]: r["utc_us"] for r in by_source.collect()} == out


def test_empty_table(spark, tmp_path):
    store = instants.InstantDictionary(spark, f"file://{tmp_path}/e")
    assert instants.normalise(spark.createDataFrame([], "id long, raw string, zone string"), "raw", "zone", store).count() == 0
