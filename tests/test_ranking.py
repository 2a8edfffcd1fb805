import random

from pyspark.sql import functions as F

from discatlas.functions import hashes
from discatlas.operators import ranking


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r["id"]: r["t"] for r in ranking.running(df, [F.col("id").asc()], F.col("v"), "t").collect()}
    total = 0
    for i, v in sorted(rows):
        total += v
        assert got[i] == total
    assert ranking.running(df.where("false"), [F.col("id").asc()], F.col("v"), "t").count() == 0


def test_numbers_within_keys(spark):
    rows = [(i, "hot" if i % 3 else None, i % 2) for i in range(300)]
    got = {r["id"]: r["k"] for r in ranking.numbered(spark.createDataFrame(rows, "id long, a string, b int"), ["a", "b"], [F.col("id").desc()], "k").collect()}
    for i, a, b in rows:
        assert got[i] == sum(1 for j, x, y in rows if (x, y) == (a, b) and j >= i)


def test_set_fingerprint(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", None), ("e", "x"), ("e", "y"), ("e", "z")], "k string, v string")
    got = {r["k"]: r["f"] for r in df.groupBy("k").agg(hashes.set_fingerprint("v").alias("f")).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 4
