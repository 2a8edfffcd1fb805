from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest

from discatlas import runtime
from discatlas.tables import distinct_delivery, first_delivery

START = datetime(2024, 1, 1)


def test_first_delivery(spark):
    rows = [(1, "a", START + timedelta(1)), (1, "b", START), (2, "c", None), (2, "d", START), (3, "e", None), (None, "f", START), (None, "f", START), (4, "g", START), (4, "g", START)]
    df = spark.createDataFrame(rows, "id long, v string, loaded_at timestamp_ntz")
    got = sorted(((r["id"], r["v"]) for r in first_delivery(df).collect()), key=str)
    assert got == sorted([(1, "b"), (2, "d"), (3, "e"), (None, "f"), (None, "f"), (4, "g")], key=str)
    assert first_delivery(df).columns == df.columns
    assert first_delivery(df.where("false")).count() == 0
    assert distinct_delivery(df.where("id = 4"), "id").count() == 1


def test_shared_folder_must_be_named_on_a_cluster(tmp_path):
    def fake(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named if key == runtime.CHECKPOINT_KEY else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert runtime.shared_dir(fake("spark://host:7077", "s3a://bucket/x/")) == "s3a://bucket/x"
    with pytest.raises(RuntimeError):
        runtime.shared_dir(fake("spark://host:7077"))
    assert runtime.shared_dir(fake("local[4]")) == runtime.shared_dir(fake("local")) and runtime.shared_dir(fake("local")).startswith("file:/")


def test_prepare_and_cut(spark):
    runtime.prepare(spark)
    runtime.prepare(spark)
    assert spark.conf.get(runtime.HUGE_METHOD) == "8000"
    df = runtime.cut(spark.range(5).selectExpr("id", "id * 2 AS twice"))
    assert df.count() == 5 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert runtime.scratch(spark, "x") != runtime.scratch(spark, "x")


def test_stored_tables(spark):
    df = runtime.stored(spark.range(5).selectExpr("id", "'a' AS b"))
    assert sorted(df.collect()) == [(i, "a") for i in range(5)]
    none = runtime.stored(spark.range(5).where("id < 0"))
    assert none.count() == 0 and none.columns == ["id"]
