from collections import Counter

from pyspark.sql import functions as F

from discatlas.operators import skewagg

SCHEMA = "k string, size long, part long"


def test_profile_of_a_hot_key(spark):
    rows = [("hot", i % 7, i % 50) for i in range(3000)] + [(f"k{i}", i, i) for i in range(500)] + [(None, 1, 1), (None, None, None), ("nulls", None, None), ("nulls", None, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    got = {r["key_value"]: tuple(r)[1:] for r in skewagg.key_profile(df, "k", "size", "part", fan_in=2).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        sizes = [r[1] for r in mine if r[1] is not None]
        assert got[key] == (len(mine), sum(sizes) if sizes else None, len({r[2] for r in mine} - {None}))


def test_heavy_keys_include_ties_and_leave_out_null(spark):
    rows = [("a", 1, 1)] * 10 + [("b", 1, 1)] * 9 + [(None, 1, 1)] * 81 + []
    df = spark.createDataFrame(rows, SCHEMA)
    profile = skewagg.key_profile(df, "k", "size", "part")
    assert [r["key_value"] for r in skewagg.heavy_keys(profile, df.count(), 0.1).collect()] == ["a"]


def test_tree_has_logarithmic_rounds(spark):
    assert [skewagg.rounds(n, 4) for n in (1, 4, 5, 16, 17, 64)] == [1, 1, 2, 2, 3, 3]
    assert [skewagg.rounds(n, 32, 32) for n in (1, 32, 1024, 1025)] == [1, 1, 1, 2]
    df = spark.range(0, 1000, 1, 37).selectExpr("id % 3 AS k", "id AS v")
    got = {r["k"]: (r["v"], r["n"]) for r in skewagg.tree_merge(df, ["k"], {"v": df["v"], "n": df["v"] * 0 + 1}, fan_in=3).collect()}
    counts = Counter(i % 3 for i in range(1000))
    assert got == {k: (sum(i for i in range(1000) if i % 3 == k), counts[k]) for k in range(3)}


def test_no_reducer_gets_more_than_fan_in_states_of_a_key(spark):
    """Over 1,024 splits, one key a third of the table."""
    chunks, fan_in = 1100, 32
    df = spark.range(0, 6600, 1, chunks).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k", "id % 5 AS size", "id % 900 AS part")
    state = df.select("k", F.lit(1).alias("n"), F.spark_partition_id().alias(skewagg.LANE))
    levels = skewagg.tree_levels(state, ["k"], ["n"], chunks, fan_in)
    assert len(levels) == 3
    before = state.select("k", skewagg.LANE).distinct()  # the states that the map side sends
    for level in levels:
        met = before.groupBy("k", F.floor(F.col(skewagg.LANE) / fan_in)).count().agg(F.max("count")).first()[0]
        assert 1 < met <= fan_in
        before = level
    assert {r["k"]: r["n"] for r in levels[-1].where("k = 'hot'").collect()} == {"hot": 2200}
    # The lanes of members meet in rounds too, and a lane holds a share of the members only.
    lanes = skewagg.member_lanes(df, "k", "size", "part", fan_in)
    hot = lanes.where("key_value = 'hot'").collect()
    assert len(hot) > 200 and max(r["n_members"] for r in hot) <= 8 and sum(r["n_members"] for r in hot) == 300
    profile = skewagg.key_profile(df, "k", "size", "part", fan_in)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == skewagg.rounds(chunks, fan_in, fan_in) + 1 + skewagg.rounds(fan_in**2, fan_in)
    assert tuple(profile.where("key_value = 'hot'").first())[1:] == (2200, sum(i % 5 for i in range(0, 6600, 3)), 300)


def test_empty_table_and_clashing_names(spark):
    assert skewagg.key_profile(spark.createDataFrame([], SCHEMA), "k", "size", "part").count() == 0
    df = spark.createDataFrame([("a", 1, 1, 9, 9)], "key_value string, n_rows long, n_members long, __split int, __member int")
    assert [tuple(r) for r in skewagg.key_profile(df, "key_value", "n_rows", "n_members").collect()] == [("a", 1, 1, 1)]
