"""All pairs of similar sets, by forests of sorted minhash sketches.

Equal sets form a class and are compared once. In each of `trees` independent
trees the classes lie in the lexicographic order of their signatures of DEPTH
hashes, so a common prefix is a neighbourhood, a contiguous run, at every depth.
A pair of similarity t shares a prefix of d hashes in one of n trees with
probability 1 - (1 - t**d)**n; `floor` is the depth at which that meets the
target recall at the threshold.

* Comparison begins with the pairs that share whole signatures and goes on to
  shorter prefixes. After each round the recall is measured from the exact
  similarities found so far, each pair weighed by the inverse of its chance to
  be met; the next round takes the deepest prefix whose measured recall, less
  its error, reaches the target. At `floor` it is reached by design.
* A neighbourhood of more than `crowd` classes at `floor` is not compared. Its
  classes go to a further forest, DEEPER hashes deeper and of as many new trees
  as the target recall needs there, so only pairs of crowded classes are met
  again and none is lost. What crowds even at DEPTH is met by an exact way:
  similar sets share a value among the rarest (1 - t) of each (prefix filter).

Pairs are verified exactly, on 64-bit hashes of the values, by joins. No set, no
neighbourhood and no class is gathered into one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discatlas.runtime import cut, stored

#: Fixed value: odd multiplier of the hash family (golden ratio of 2**64).
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of a signature; 16 bits of each are kept, so a signature is two longs.
DEPTH = 8
#: How much deeper the forest of crowded classes is.
DEEPER = 2
#: Sets of more values than this are not sorted in one task.
SMALL = 10_000
#: Copies of one set that meet in one lane when pairs of equal sets are listed.
LANE = 256


def chance(similarity: float, depth: int, trees: int) -> float:
    """Probability that a pair of that similarity shares a prefix of that depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(similarity: float, trees: int, recall: float) -> int:
    """The deepest prefix at which a pair of that similarity is met with the target recall."""
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity must be in (0, 1], recall in (0, 1)")
    depth = 1
    while depth < DEPTH and chance(similarity, depth + 1, trees) >= recall:
        depth += 1
    return depth


def trees_for(similarity: float, depth: int, recall: float) -> int:
    """How many trees meet a pair of that similarity at that depth with the target recall."""
    share = similarity**depth
    return 1 if share >= recall else math.ceil(math.log(1 - recall) / math.log(1 - share))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketches(members: DataFrame, trees: int, family: int = 0) -> DataFrame:
    """Signatures per set and tree: group, set, n, tree, hi, lo (four hashes of 16 bits each), from members (group, set, vh, n).

    Forests of different families have independent hashes.
    """
    kind = members.schema["set"].dataType.simpleString()
    slots = trees * DEPTH
    seeds = _mix((np.arange(1, slots // 2 + 1, dtype=np.uint64) + np.uint64(family << 32)) * _ODD)
    names = [f"s{i}" for i in range(DEPTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).dictionary_encode().indices.to_numpy().astype(np.int64) << 32 | batch.column(1).dictionary_encode().indices.to_numpy()
            order = np.argsort(key, kind="stable")
            hashes = batch.column(2).to_numpy().view(np.uint64)[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1))
            least = np.empty((len(starts), slots), dtype=np.int32)
            for pair, seed in enumerate(seeds):  # the halves of one mixed value serve two slots
                mixed = _mix(hashes ^ seed)
                least[:, 2 * pair] = np.minimum.reduceat((mixed >> np.uint64(33)).astype(np.int32), starts)
                least[:, 2 * pair + 1] = np.minimum.reduceat((mixed & np.uint64(0x7FFFFFFF)).astype(np.int32), starts)
            first = pa.array(np.repeat(order[starts], trees))
            tree = np.tile(np.arange(trees, dtype=np.int16), len(starts))
            shaped = least.reshape(-1, DEPTH)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(first) for i in (0, 1, 3)), pa.array(tree), *(pa.array(shaped[:, i]) for i in range(DEPTH))], names=["group", "set", "n", "tree", *names])

    partial = members.select("group", "set", "vh", "n").mapInArrow(run, f"group string, set {kind}, n long, tree short, {', '.join(f'{n} int' for n in names)}")
    whole = partial.groupBy("group", "set", "n", "tree").agg(*(F.min(n).alias(n) for n in names))

    def packed(four: list[str]) -> Column:
        lanes = [F.shiftleft(F.col(n).cast("long").bitwiseAND(F.lit(0xFFFF)), 48 - 16 * i) for i, n in enumerate(four)]
        return lanes[0].bitwiseOR(lanes[1]).bitwiseOR(lanes[2]).bitwiseOR(lanes[3])

    return whole.select("group", "set", "n", "tree", packed(names[:4]).alias("hi"), packed(names[4:]).alias("lo"))


def _head(depth: int) -> Column:
    """Number of the neighbourhood at a depth: group, tree and the first hashes of the signature."""
    short = [F.shiftrightunsigned("hi", 64 - 16 * min(depth, 4))] + ([F.shiftrightunsigned("lo", 128 - 16 * depth)] if depth > 4 else [])
    return F.xxhash64("group", "tree", F.lit(depth), *short)


def forest(sketch: DataFrame, floor: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """(runs, crowded) of a forest at a depth.

    runs: head, hi, lo, group, set, n of the neighbourhoods of 2 to `crowd`
    classes, every neighbourhood in one partition, in the order of head and
    signature; crowded: the classes (group, set) of larger ones, None if there
    are none. Neighbourhoods are counted by partial counts and not gathered.
    """
    placed = stored(sketch).withColumn("head", _head(floor))
    counts = cut(placed.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    shared = placed.join(counts.where(F.col("m") <= crowd), "head")
    runs = cut(shared.select("head", "hi", "lo", "group", "set", "n").repartition("head").sortWithinPartitions("head", "hi", "lo"))
    heads = counts.where(F.col("m") > crowd)
    if heads.isEmpty():
        return runs, None
    return runs, cut(placed.join(heads, "head").select("group", "set").distinct())


def _lanes(x: np.ndarray) -> np.ndarray:
    """How many of the leading 16-bit lanes are zero."""
    return (x < np.uint64(1 << 48)).astype(np.int8) + (x < np.uint64(1 << 32)) + (x < np.uint64(1 << 16)) + (x == 0)


def neighbours(runs: DataFrame, low: int, high: int, similarity: float) -> DataFrame:
    """Pairs whose longest common prefix in a tree has `low` to `high` hashes and whose sizes allow the similarity: group, left, right, nl, nr."""
    kind = runs.schema["set"].dataType.simpleString()

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        head, n = table["head"].to_numpy(), table["n"].to_numpy()
        hi, lo = (table[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        group, sets = table["group"].combine_chunks(), table["set"].combine_chunks()
        step = 1
        while step < len(head) and len(i := np.flatnonzero(head[step:] == head[:-step])):
            j = i + step
            x = hi[i] ^ hi[j]
            common = np.where(x != 0, _lanes(x), 4 + _lanes(lo[i] ^ lo[j]))
            fits = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-9
            keep = (common >= low) & (common <= high) & fits
            if keep.any():
                i, j = pa.array(i[keep]), pa.array(j[keep])
                swap = pc.greater(sets.take(i), sets.take(j))
                i, j = pc.if_else(swap, j, i), pc.if_else(swap, i, j)
                sizes = table["n"].combine_chunks()
                yield pa.RecordBatch.from_arrays([group.take(i), sets.take(i), sets.take(j), sizes.take(i), sizes.take(j)], names=["group", "left", "right", "nl", "nr"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            head = table["head"].to_numpy()
            changes = np.flatnonzero(np.diff(head)) + 1
            open_at = int(changes[-1]) if len(changes) else 0  # the last run may go on
            if open_at:
                yield from pairs(table.slice(0, open_at))
            held = table.slice(open_at)
        if held is not None:
            yield from pairs(held)

    return runs.mapInArrow(run, f"group string, left {kind}, right {kind}, nl long, nr long").distinct()


def measured(found: DataFrame, trees: int, now: int, floor: int, similarity: float) -> dict[int, float]:
    """Recall to be expected at each depth from floor to now, less its error, measured on the verified pairs of depth now."""
    t = F.col("n_common") / F.col("n_union")

    def p(depth: int) -> Column:
        return 1 - F.pow(1 - F.pow(t, F.lit(depth)), F.lit(trees))

    weight = 1 / p(now)
    sums = [F.sum(weight).alias("all")]
    for d in range(floor, now + 1):
        sums += [F.sum(weight * (1 - p(d))).alias(f"m{d}"), F.sum(F.pow(weight * (1 - p(d)), F.lit(2))).alias(f"v{d}")]
    row = found.agg(*sums).first()
    if not row["all"]:
        return dict.fromkeys(range(floor, now + 1), 0.0)
    # Two standard errors, and three for pairs at the threshold of which none was met.
    rest = {d: 3 * (1 - chance(similarity, d, trees)) / chance(similarity, now, trees) for d in range(floor, now + 1)}
    return {d: 1 - (row[f"m{d}"] + 2 * math.sqrt(row[f"v{d}"]) + rest[d]) / row["all"] for d in range(floor, now + 1)}


def _fit(left: Column, right: Column, similarity: float) -> Column:
    """Sizes between which the similarity is possible."""
    return (F.least(left, right) >= F.greatest(left, right) * F.lit(similarity) - F.lit(1e-9))


def classes(sets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of a table (group, id, value).

    members: group, set, vh, n of one representative, the smallest id, of each
    class of equal sets with at least `least` distinct values; classes: group,
    id, set, n and copies, the number of ids in the class. Values are compared by
    a 64-bit hash: two values of the same two sets collide with a probability
    below their number squared / 2**64.
    """
    distinct = stored(sets.where("group IS NOT NULL AND id IS NOT NULL AND value IS NOT NULL").select("group", "id", F.xxhash64("value").alias("vh")).distinct())
    prints = distinct.groupBy("group", "id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("vh").alias("f1"), F.bit_xor(F.xxhash64("vh", F.lit(1))).alias("f2"))
    kept = prints.where(F.col("n") >= least)
    firsts = kept.groupBy("group", "n", "f1", "f2").agg(F.min("id").alias("set"), F.count(F.lit(1)).alias("copies"))
    belongs = cut(kept.join(firsts, ["group", "n", "f1", "f2"]).select("group", "id", "set", "n", "copies"))
    members = distinct.join(belongs.where("id = set").select("group", "id", "n"), ["group", "id"])
    return stored(members.select("group", F.col("id").alias("set"), "vh", "n")), belongs


def similar_classes(members: DataFrame, similarity: float, trees: int = 32, recall: float = 0.999, crowd: int = 64) -> DataFrame:
    """Pairs of classes with |common| / |union| >= similarity: group, left, right, n_common, n_union."""
    inside, depth, forests, found = members, depth_for(similarity, trees, recall), [], None
    while True:
        runs, crowded = forest(sketches(inside, trees, len(forests)), depth, crowd)
        forests.append((runs, depth, trees))
        if crowded is None:
            break
        inside = stored(inside.join(crowded, ["group", "set"]))
        depth += DEEPER
        if depth > DEPTH:
            found = cut(verify(crowded_pairs(inside, similarity), members, similarity))
            break
        trees = trees_for(similarity, depth, recall)
    for runs, depth, trees in reversed(forests):
        found = compare(runs, members, similarity, depth, trees, recall, found)
    return found


def compare(runs: DataFrame, members: DataFrame, similarity: float, floor: int, trees: int, recall: float, found: DataFrame | None = None) -> DataFrame:
    """The pairs found so far and those of a forest, from whole signatures to ever shorter prefixes."""
    own, low, high = None, DEPTH, DEPTH
    while True:
        candidates = neighbours(runs, low, high, similarity)
        if found is not None:
            candidates = candidates.join(found.select("group", "left", "right"), ["group", "left", "right"], "left_anti")
        fresh = cut(verify(candidates, members, similarity))
        own = fresh if own is None else own.unionByName(fresh)
        found = fresh if found is None else found.unionByName(fresh)
        if low == floor:
            return found
        reached = measured(own, trees, low, floor, similarity)
        if reached[low] >= recall:
            return found
        low, high = max((d for d in range(floor, low) if reached[d] >= recall), default=floor), low - 1


def crowded_pairs(inside: DataFrame, similarity: float) -> DataFrame:
    """Pairs of classes that share a value rare enough for that similarity: a superset of the similar ones."""
    rarity = inside.groupBy("group", "vh").agg(F.count(F.lit(1)).alias("df"))
    ranked = inside.join(rarity, ["group", "vh"]).withColumn("rank", F.shiftleft(F.least("df", F.lit(1 << 30)), 32) + F.col("vh").bitwiseAND(0xFFFFFFFF))
    return _pair(_prefixes(ranked, similarity), "prefix", similarity)


def _prefixes(ranked: DataFrame, similarity: float) -> DataFrame:
    """The n - ceil(t n) + 1 rarest values of every set: group, set, n, prefix.

    Two sets of that similarity share one of them. Sets of at most SMALL values
    are ranked in a window; of larger ones a quantile, whose state is bounded,
    bounds the rank from above.
    """
    order = Window.partitionBy("group", "set").orderBy("rank", "vh")
    wanted = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)) + 1
    small = ranked.where(F.col("n") <= SMALL).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= wanted)
    large = ranked.where(F.col("n") > SMALL)
    limits = large.groupBy("group", "set").agg(F.percentile_approx("rank", min(1.0, 1 - similarity + 0.002), 10_000).alias("limit"))
    rare = small.select("group", "set", "n", "vh").unionByName(large.join(limits, ["group", "set"]).where("rank <= limit").select("group", "set", "n", "vh"))
    return rare.select("group", "set", "n", F.xxhash64("group", "vh").alias("prefix"))


def _pair(places: DataFrame, key: str, similarity: float) -> DataFrame:
    left = places.select(key, "group", F.col("set").alias("left"), F.col("n").alias("nl"))
    right = places.select(key, F.col("group").alias("group_r"), F.col("set").alias("right"), F.col("n").alias("nr"))
    joined = left.join(right, key).where((F.col("group") == F.col("group_r")) & (F.col("left") < F.col("right")) & _fit(F.col("nl"), F.col("nr"), similarity))
    return joined.select("group", "left", "right", "nl", "nr").distinct()


def verify(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact similarity is high enough, counted by joins on the values."""
    of_left = pairs.join(members.select("group", F.col("set").alias("left"), "vh"), ["group", "left"])
    both = of_left.join(members.select("group", F.col("set").alias("right"), "vh"), ["group", "right", "vh"])
    counted = both.groupBy("group", "left", "right", "nl", "nr").agg(F.count(F.lit(1)).alias("n_common"))
    union = F.col("nl") + F.col("nr") - F.col("n_common")
    return counted.where(F.col("n_common") >= F.lit(similarity) * union - F.lit(1e-9)).select("group", "left", "right", "n_common", union.alias("n_union"))


def copies(belongs: DataFrame) -> DataFrame:
    """Pairs of ids within each class of equal sets: group, left_id, right_id, n.

    The ids of a large class are spread over lanes of about LANE ids, and every
    lane meets the whole class, so no task lists more than LANE partners of an id.
    """
    many = belongs.where("copies > 1").withColumn("lanes", F.ceil(F.col("copies") / LANE))
    left = many.select("group", "set", "n", F.col("id").alias("left_id"), F.explode(F.sequence(F.lit(0), F.col("lanes").cast("int") - 1)).alias("lane"))
    right = many.select("group", "set", F.col("id").alias("right_id"), F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int").alias("lane"))
    return left.join(right, ["group", "set", "lane"]).where("left_id < right_id").select("group", "left_id", "right_id", "n")


def similar_sets(sets: DataFrame, similarity: float = 0.6, least: int = 4, trees: int = 32, recall: float = 0.999, crowd: int = 64) -> DataFrame:
    """Pairs of sets whose overlap is at least `similarity`: group, left_id, right_id, n_common, n_union.

    sets has (group, id, value); only sets of one group are compared, each pair
    of ids once with left_id < right_id. Sets that hold the same values are a
    pair like any other; `classes` gives them without listing pairs. Null
    groups, ids and values count for nothing, repeated values once; sets of
    fewer than `least` values and empty tables give no pairs.
    """
    members, belongs = classes(sets, least)
    found = similar_classes(members, similarity, trees, recall, crowd)
    left = belongs.select("group", F.col("set").alias("left"), F.col("id").alias("a"))
    right = belongs.select("group", F.col("set").alias("right"), F.col("id").alias("b"))
    spread = found.join(left, ["group", "left"]).join(right, ["group", "right"])
    between = spread.select("group", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "n_common", "n_union")
    return between.unionByName(copies(belongs).select("group", "left_id", "right_id", F.col("n").alias("n_common"), F.col("n").alias("n_union")))
