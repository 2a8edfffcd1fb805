"""Trees given by parent ids: closures, roots, inherited values, depth-first order.

The closure is built by doubling: after round k every node knows its ancestors
up to distance 2**k, so the number of rounds is logarithmic in the depth. Each
round is two equi-joins and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discatlas.operators.ranking import running
from discatlas.runtime import cut

MAX_ROUNDS = 20


def closure(nodes: DataFrame, key: str = "id", parent: str = "parent_id", itself: bool = False) -> DataFrame:
    """All (node, ancestor, distance) of a forest, the smallest distance of each pair.

    Null parents end a path, parents that don't exist are ancestors too. A cycle
    ends where a node is its own ancestor; it doesn't run on. With itself=True
    each node is its own ancestor at distance 0.
    """
    edges = nodes.where(F.col(key).isNotNull() & F.col(parent).isNotNull() & (F.col(key) != F.col(parent))).select(F.col(key).alias("node"), F.col(parent).alias("ancestor")).distinct()
    pairs = cut(edges.withColumn("distance", F.lit(1)))
    known = pairs.count()
    for _ in range(MAX_ROUNDS):
        if not known:
            break
        ahead = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("distance").alias("further"))
        longer = pairs.join(ahead, "ancestor").select("node", F.col("beyond").alias("ancestor"), (F.col("distance") + F.col("further")).alias("distance"))
        pairs = cut(pairs.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        now = pairs.count()
        if now == known:
            break
        known = now
    else:
        if known:
            raise RuntimeError(f"paths go on beyond {MAX_ROUNDS} doublings")
    if itself:
        own = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(key).alias("ancestor"), F.lit(0).alias("distance")).distinct()
        pairs = pairs.where("node != ancestor").unionByName(own)
    return pairs


def roots(nodes: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, root, depth): the topmost ancestor of each node; nodes on a cycle have none."""
    above = closure(nodes, key, parent, itself=True)
    tops = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("ancestor"))
    return above.join(tops, "ancestor", "left_semi").select("node", F.col("ancestor").alias("root"), F.col("distance").alias("depth"))


def nearest(nodes: DataFrame, value: str, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, value) of the nearest of the node and its ancestors that has a value."""
    above = closure(nodes, key, parent, itself=True)
    held = nodes.where(F.col(value).isNotNull()).select(F.col(key).alias("ancestor"), F.col(value).alias("value"))
    return above.join(held, "ancestor").groupBy("node").agg(F.min_by("value", "distance").alias("value"))


def any_above(nodes: DataFrame, flag: Column, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, flag): whether the condition holds for the node or any ancestor."""
    above = closure(nodes, key, parent, itself=True)
    marked = nodes.select(F.col(key).alias("ancestor"), F.coalesce(flag, F.lit(False)).alias("marked"))
    return above.join(marked, "ancestor").groupBy("node").agg(F.bool_or("marked").alias("flag"))


def depth_first(nodes: DataFrame, label: str, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, depth, position): depth-first order of the trees, siblings by label and then key.

    The sort path of a node is the array of its ancestors' (label, key), which
    compares element by element.
    """
    above = closure(nodes, key, parent, itself=True)
    named = nodes.select(F.col(key).alias("ancestor"), F.coalesce(F.lower(label), F.lit("")).alias("name"))
    step = F.struct((-F.col("distance")).alias("d"), "name", F.col("ancestor").alias("k"))
    paths = above.join(named, "ancestor").groupBy("node").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    ordered = paths.select("node", (F.size("steps") - 1).alias("depth"), F.transform("steps", lambda s: F.struct(s["name"], s["k"])).alias("path"))
    return running(ordered, [F.col("path").asc()], F.lit(1).cast("long"), "position").select("node", "depth", "position")


def worst_status(rows: DataFrame, owner_roots: DataFrame, order: list[str]) -> DataFrame:
    """Roll-up of statuses to roots: root, status (the first of `order` that occurs), n of it, total.

    rows has (node, status), owner_roots (node, root).
    """
    counted = rows.join(owner_roots, "node").groupBy("root", "status").agg(F.count(F.lit(1)).alias("c"))
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("status"))
    known = counted.withColumn("rank", rank).where("rank > 0")
    return known.groupBy("root").agg(F.min_by("status", "rank").alias("status"), F.min_by("c", "rank").alias("n"), F.sum("c").alias("total"))
