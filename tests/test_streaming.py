from datetime import datetime, timedelta

from discatlas.operators import similarity
from discatlas.streaming import live

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, name="in", files=2):
    df = spark.createDataFrame(rows, schema)
    df.repartition(files).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def drain(df, name):
    query = df.writeStream.outputMode("append" if name == "first" else "complete" if name == "done" else "update").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_activity_and_sessions(spark, tmp_path):
    rows = [("a", START + timedelta(minutes=m)) for m in (0, 1, 2, 50, 51)] + [("b", START)]
    events = stream(spark, tmp_path, rows, "who string, ts timestamp", files=1)
    got = {(r["key"], r["window_start"]): r["n"] for r in drain(live.activity(events, "ts", "who"), "act")}
    assert got == {("a", START): 3, ("a", START + timedelta(minutes=50)): 2, ("b", START): 1}
    batch = live.sessions(spark.createDataFrame(rows, "who string, ts timestamp"), "ts", "who").collect()
    assert sorted((r["key"], r["n"]) for r in batch) == [("a", 2), ("a", 3), ("b", 1)]


def test_first_deliveries(spark, tmp_path):
    rows = [(1, "x", START), (1, "x", START + timedelta(minutes=5)), (2, "y", START)]
    got = drain(live.first_deliveries(stream(spark, tmp_path, rows, "id long, v string, ts timestamp", files=1), "id", "ts"), "first")
    assert sorted(r["id"] for r in got) == [1, 2]


def test_similarity_follows_changes(spark, tmp_path):
    sets = tmp_path / "sets"
    one = [(o, f"h{i}", 10) for o in (1, 2) for i in range(5)] + [(3, f"x{i}", 10) for i in range(5)]
    spark.createDataFrame(one, "owner long, h string, size long").write.parquet(str(sets))
    changes = stream(spark, tmp_path, [(1,), (2,), (3,)], "owner long", "changes", 1)
    path, check = f"file://{tmp_path}/pairs", f"file://{tmp_path}/check"

    def read(session):
        return session.read.parquet(str(sets))

    live.refresh_similarity(changes, read, path, check).awaitTermination()
    assert [(r["a"], r["b"]) for r in live.latest(spark, path).collect()] == [(1, 2)]
    spark.createDataFrame([(4, f"x{i}", 10) for i in range(4)], "owner long, h string, size long").write.mode("append").parquet(str(sets))
    changes = stream(spark, tmp_path, [(4,)], "owner long", "changes", 1)
    live.refresh_similarity(changes, read, path, check).awaitTermination()
    got = sorted(map(tuple, live.latest(spark, path).collect()))
    assert got == sorted(map(tuple, similarity.weighted_jaccard(read(spark)).collect())) and len(got) == 2
    assert live.latest(spark, f"{path}-none") is None


def test_append_new(spark, tmp_path):
    path, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check2"
    rows = stream(spark, tmp_path, [(1, "a"), (1, "b"), (2, "c")], "id long, v string", "rows", 1)
    live.append_new(rows, path, ["id"], check).awaitTermination()
    rows = stream(spark, tmp_path, [(2, "d"), (3, "e")], "id long, v string", "rows", 1)
    live.append_new(rows, path, ["id"], check).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_presence(spark, tmp_path):
    schema = "who string, ts timestamp"
    rows = stream(spark, tmp_path, [("a", START), ("b", START), (None, START)], schema, "beats", 1)
    query = live.presence(rows, "ts", "who").writeStream.outputMode("append").format("memory").queryName("presence").start()
    try:
        query.processAllAvailable()
        for minutes in (0.5, 5, 5.5):
            stream(spark, tmp_path, [("a", START + timedelta(minutes=minutes))], schema, "beats", 1)
            query.processAllAvailable()
        got = [(r["key"], r["state"]) for r in spark.sql("SELECT * FROM presence ORDER BY at, key").collect()]
    finally:
        query.stop()
    assert got[:2] == [("a", "appeared"), ("b", "appeared")] and ("b", "gone") in got and got.count(("b", "gone")) == 1
