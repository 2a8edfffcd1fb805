import pytest
from pyspark.sql import functions as F

from discatlas.functions import formats, text
from discatlas.operators import known, sinks


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column).collect()]


def test_labels_and_keys(spark):
    assert one(spark, text.strip_brackets("v"), "Elite (1984) [a]", "(only)", "Plain", "a (b) c", None) == ["Elite", "(only)", "Plain", "a (b) c", None]
    assert one(spark, text.path_label("v"), "Games/Elite/disc 1.adf", "Elite.adf", "a/7", "", "/", None) == ["Elite disc 1", "Elite", "a 7", None, None, None]
    digest = "ab" * 32
    assert one(spark, text.storage_key("v", F.lit("My disc.adf")), digest.upper(), "short", None) == [f"ab/ab/{digest}-My_disc.adf", None, None]
    assert one(spark, text.valid_key("v"), "a/b.c", "", "/a", "a/", "a//b", "../a", "a/./b", "a\\b", "a\x01", None) == [True] + [False] * 9
    assert one(spark, text.mime_type("v"), "a/b.PNG", "x", None) == ["image/png", "application/octet-stream", "application/octet-stream"]
    assert one(spark, text.latin1_repair("v"), "\x80\x99é", "", None) == ["€™é", "", None]


def test_media(spark):
    assert one(spark, formats.media_kind("v"), "WAV", "xyz", None) == ["audio", None, None]
    assert one(spark, formats.is_playable("v"), "mp4", "avi", None) == [True, False, False]
    assert one(spark, formats.codec_name("v"), "7", "99") == ["Moving Blocks", "codec 99"]


def test_products(spark):
    rows = spark.createDataFrame([(1, "a", "x", True), (2, "a", "y", False), (3, "b", "y", False), (4, "c", None, True)], "id long, product string, md5 string, required boolean")
    assert sorted(map(tuple, known.classify(rows).collect())) == [("a", 1, 1, None), ("b", 0, 1, "no required file"), ("c", 1, 0, "a required file has no hash")]
    named = known.canonical_source(spark.createDataFrame([("ACME disc",), ("acme",), ("other",), (None,)], "n string"), "n", [("acme.*", "Acme"), (".*disc", "Disc")])
    assert [r["source"] for r in named.collect()] == ["Acme", "Acme", None, None]


def test_changes(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, blob long")
    mapping = spark.createDataFrame([(10, 10), (11, 10), (12, 1)], "old long, new long")
    assert {tuple(r) for r in sinks.reassign(rows, "blob", mapping).select("id", "blob", "changed").collect()} == {(1, 10, False), (2, 10, True), (3, None, False)}
    files = spark.createDataFrame([(1, "a.zip", None), (2, "in/x", 1), (3, "a.zip/y", 1), (4, "z", 99)], "id long, path string, parent_file_id long")
    assert {tuple(r) for r in sinks.nested_paths(files).collect()} == {(2, 1, "a.zip/in/x"), (3, 1, "a.zip/y")}
    doomed = spark.createDataFrame([(1,)], "id long")
    assert {r["id"] for r in sinks.delete_cascade(files, doomed, "id", "parent_file_id").collect()} == {1, 4}


@pytest.mark.parametrize("rows", [[], [(1, 5, "x")], [(1, 5, None), (2, 5, "b")]])
def test_children_as_json(spark, rows):
    parents = spark.createDataFrame([(5, "p"), (6, None)], "pid long, name string")
    children = spark.createDataFrame(rows, "id long, pid long, v string")
    got = {r["pid"]: r["json"] for r in sinks.children_json(parents, children, "pid", "pid", "kids").collect()}
    assert set(got) == {5, 6} and got[6] == '{"pid":6,"kids":[]}'
    assert got[5].count('"id"') == len(rows)
