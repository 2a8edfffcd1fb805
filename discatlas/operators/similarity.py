"""Size-weighted set similarity of file owners (artefacts, partitions, directory components).

Everything is keyed on (owner, h, size) rows. Candidate pairs come from a
self-join on shared content; content held by more owners than `cap` is left out
of candidate search only, and still counts in the scores. Sums stay integers and
are divided once, so scores are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discatlas.functions import hashes, paths
from discatlas.operators.ranking import running
from discatlas.runtime import cut, scratch

CAP = 50
FLOOR = 0.10
#: Contents of an owner that are ordered in one task at most.
SMALL = 10_000


def content_sets(files: DataFrame, owner: str = "owner", h: str = "h", size: str = "size") -> DataFrame:
    """One row per owner and content, with its smallest size: owner, h, size. Null hashes and sizes of 0 or null count for nothing."""
    return files.where(F.col(h).isNotNull() & (F.col(size) > 0)).groupBy(F.col(owner).alias("owner"), F.col(h).alias("h")).agg(F.min(size).alias("size"))


def document_frequency(sets: DataFrame) -> DataFrame:
    """In how many owners each content occurs: h, df."""
    return sets.groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def idf(frequency: DataFrame, owners: int) -> DataFrame:
    """Weight ln(1 + N / df) of each content: h, df, weight."""
    return frequency.withColumn("weight", F.log(F.lit(1.0) + F.lit(owners) / F.greatest("df", F.lit(1))))


def candidates(sets: DataFrame, cap: int = CAP) -> DataFrame:
    """Pairs a < b of owners that share content held by 2 to `cap` owners."""
    rare = document_frequency(sets).where(F.col("df").between(2, cap)).select("h")
    kept = sets.join(rare, "h").select("h", "owner")
    left, right = kept.withColumnRenamed("owner", "a"), kept.withColumnRenamed("owner", "b")
    return left.join(right, "h").where("a < b").select("a", "b").distinct()


def totals(sets: DataFrame) -> DataFrame:
    """Files and bytes of each owner: owner, n, bytes."""
    return sets.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Content that both owners of a pair hold: a, b, shared_files, shared_bytes (of the smaller size)."""
    left = sets.select(F.col("owner").alias("a"), "h", F.col("size").alias("sa"))
    right = sets.select(F.col("owner").alias("b"), "h", F.col("size").alias("sb"))
    both = pairs.join(left, "a").join(right, ["b", "h"])
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_files"), F.sum(F.least("sa", "sb")).alias("shared_bytes"))


def weighted_jaccard(sets: DataFrame, cap: int = CAP, floor: float = FLOOR) -> DataFrame:
    """Similar pairs: a, b, score, shared_files, union_files, shared_bytes, union_bytes, with score >= floor.

    A self-join on rare content finds the candidates; what they share is counted
    over all content. Owners without content are in no pair; empty input gives
    no rows.
    """
    return score_pairs(candidates(sets, cap), sets).where(F.col("score") >= floor)


def content_classes(sets: DataFrame) -> DataFrame:
    """Owners of equal content: owner, class_id (the smallest owner of the class), n_copies. Fingerprints are combined by partial aggregation."""
    prints = sets.groupBy("owner").agg(hashes.set_fingerprint(F.concat_ws(":", "h", F.col("size").cast("string"))).alias("print"))
    firsts = prints.groupBy("print").agg(F.min("owner").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return prints.join(firsts, "print").select("owner", "class_id", "n_copies")


def indexed(sets: DataFrame, floor: float) -> DataFrame:
    """The contents (h, owner) by which owners of a score >= floor must meet.

    Of each owner's contents, in the order of how many hold them, the most held
    are left out as long as they weigh less than the floor of its bytes: two
    owners that share only those score below the floor, so the rarest content
    that a similar pair shares is kept of both. Owners of more than SMALL
    contents keep all, which only adds candidates.
    """
    ranked = sets.join(document_frequency(sets), "h").join(totals(sets), "owner")
    order = Window.partitionBy("owner").orderBy(F.desc("df"), "h").rowsBetween(Window.unboundedPreceding, 0)
    small = ranked.where(F.col("n") <= SMALL).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") >= F.lit(floor * (1 - 1e-9)) * F.col("bytes"))
    return small.select("h", "owner").unionByName(ranked.where(F.col("n") > SMALL).select("h", "owner"))


def uncapped_pairs(sets: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The pairs of weighted_jaccard without its cap: none with score >= floor is lost, however many hold a content.

    sets should hold one owner of each class of equal content, see
    content_classes; copies are then members of their class and no pairs. Empty
    input gives no rows.
    """
    kept = cut(indexed(sets, floor))
    pairs = kept.toDF("h", "a").join(kept.toDF("h", "b"), "h").where("a < b").select("a", "b").distinct()
    return score_pairs(pairs, sets).where(F.col("score") >= floor)


def idf_jaccard(sets: DataFrame, pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of pairs with bytes weighted by rarity: a, b, score; content without a weight counts once."""
    weighted = sets.join(weights.select("h", "weight"), "h", "left").withColumn("w", F.col("size") * F.coalesce("weight", F.lit(1.0)))
    sums = weighted.groupBy("owner").agg(F.sum("w").alias("total"))
    left = weighted.select(F.col("owner").alias("a"), "h", F.col("w").alias("wa"))
    right = weighted.select(F.col("owner").alias("b"), "h", F.col("w").alias("wb"))
    common = pairs.select("a", "b").join(left, "a").join(right, ["b", "h"]).groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("common"))
    joined = common.join(sums.select(F.col("owner").alias("a"), F.col("total").alias("ta")), "a").join(sums.select(F.col("owner").alias("b"), F.col("total").alias("tb")), "b")
    return joined.select("a", "b", (F.col("common") / (F.col("ta") + F.col("tb") - F.col("common"))).alias("score"))


def below_roots(files: DataFrame, most_depth: int = 4, apps: bool = False) -> DataFrame:
    """Content below each directory that can be a component: owner, root, h, size.

    With apps, the first directory of a path that begins with '!' counts at any depth.
    """
    roots = paths.ancestors("path", most_depth)
    if apps:
        roots = F.array_distinct(F.array_compact(F.concat(roots, F.array(paths.app_directory("path")))))
    below = files.where("h IS NOT NULL AND size > 0").select("owner", "h", "size", F.explode(roots).alias("root"))
    return below.groupBy("owner", "root", "h").agg(F.min("size").alias("size"))


def components(files: DataFrame, most_depth: int = 4, least_files: int = 2, most: int = 500, apps: bool = False) -> DataFrame:
    """Directory components of owners, with equal ones folded: owner, root, depth, n_files, n_bytes, fingerprint.

    files has (owner, path, h, size). A component is a directory down to
    most_depth with at least least_files different contents below it. Components
    of one owner with the same contents fold into the shallowest, then first by
    name; of the rest the `most` with most files are kept. The fingerprint is
    the digest of the ordered contents. With apps, the first directory of a path
    that begins with '!' is a component at any depth.
    """
    return folded(below_roots(files, most_depth, apps), least_files, most)


def folded(distinct: DataFrame, least_files: int = 2, most: int = 500) -> DataFrame:
    """Components of the content below each directory, as `below_roots` gives it."""
    entry = F.concat_ws(":", "h", F.col("size").cast("string"))
    built = distinct.groupBy("owner", "root").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), hashes.set_fingerprint(entry).alias("fingerprint"))
    sized = built.where(F.col("n_files") >= least_files).withColumn("depth", paths.depth("root"))
    first = Window.partitionBy("owner", "fingerprint").orderBy("depth", "root")
    rank = Window.partitionBy("owner").orderBy(F.desc("n_files"), "root")
    kept = sized.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= most)
    return kept.select("owner", "root", "depth", "n_files", "n_bytes", "fingerprint")


def _stored(df: DataFrame) -> DataFrame:
    """df written to a table of the shared folder, which is smaller than a checkpoint, and read again."""
    path = scratch(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def component_pairs(files: DataFrame, cap: int = CAP, floor: float = FLOOR) -> DataFrame:
    """Similar directory components of different owners: a, root_a, b, root_b, score, shared_files, union_files, shared_bytes, union_bytes.

    Components are compared like owners, keyed by (owner, root): candidates share
    content that 2 to `cap` components hold, and pairs with score >= floor stay.
    """
    below = _stored(below_roots(files, apps=True))
    kept = cut(folded(below).select("owner", "root", F.monotonically_increasing_id().alias("id")))
    members = _stored(below.join(kept, ["owner", "root"]).select("id", F.col("owner").alias("whole"), "h", "size"))
    rare = members.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, cap)).select("h")
    useful = members.join(rare, "h").select("h", "id", "whole")
    pairs = useful.toDF("h", "a", "wa").join(useful.toDF("h", "b", "wb"), "h").where("wa < wb").select("a", "b").distinct()
    scored = score_pairs(pairs, members.select(F.col("id").alias("owner"), "h", "size")).where(F.col("score") >= floor)
    left, right = kept.toDF("owner_a", "root_a", "a"), kept.toDF("owner_b", "root_b", "b")
    named = scored.join(left, "a").join(right, "b")
    return named.select(F.col("owner_a").alias("a"), "root_a", F.col("owner_b").alias("b"), "root_b", "score", "shared_files", "union_files", "shared_bytes", "union_bytes")


def nearest_rank(n: Column, percent: float) -> Column:
    """Position from 1 of a percentile: half-even rounding of percent / 100 n + 1/2, clamped; 100 is the last."""
    if percent >= 100:
        return n
    return F.greatest(F.lit(1), F.least(n, F.bround(F.lit(percent / 100) * n + F.lit(0.5), 0).cast("long")))


def distribution(values: DataFrame, value: str, percents: tuple[float, ...] = (50, 90, 95, 99, 100)) -> DataFrame:
    """One row: n, total, mean and a column pNN per percentile, over the non-null values; of none, n is 0 and the rest null.

    Ranks come from a running total of the counts per distinct value.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = running(counted, [F.col("v").asc()], F.col("c"), "upto")
    n = F.lit(upto.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]).cast("long")
    picks = [F.min(F.when(F.col("upto") >= nearest_rank(n, p), F.col("v"))).alias(f"p{int(p)}") for p in percents]
    total = F.sum(F.col("v") * F.col("c"))
    return upto.agg(n.alias("n"), total.alias("total"), (total / F.sum("c")).alias("mean"), *picks)


def histogram(values: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """Counts of values in [edge, next edge), the last without end: bucket (its lower edge), n. Values below the first edge and nulls are left out."""
    bucket = F.when(F.col(value) >= edges[-1], F.lit(edges[-1]))
    for low, high in zip(edges, edges[1:], strict=False):
        bucket = bucket.when((F.col(value) >= low) & (F.col(value) < high), F.lit(low))
    return values.select(bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def both_directions(pairs: DataFrame) -> DataFrame:
    """Undirected edges as (owner, other, ...) from both ends."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    one = pairs.select(F.col("a").alias("owner"), F.col("b").alias("other"), *rest)
    return one.unionByName(pairs.select(F.col("b").alias("owner"), F.col("a").alias("other"), *rest))


def refresh(stored: DataFrame, sets: DataFrame, dirty: DataFrame, cap: int = CAP, floor: float = FLOOR) -> DataFrame:
    """Stored pairs brought up to date after the owners in dirty (owner) changed.

    Only pairs with a dirty end are computed again: their candidates come from
    the dirty side of the self-join. Equals the full rebuild where the document
    frequencies of other pairs' content did not cross the cap.
    """
    kept = stored.join(dirty.select(F.col("owner").alias("a")), "a", "left_anti").join(dirty.select(F.col("owner").alias("b")), "b", "left_anti")
    rare = document_frequency(sets).where(F.col("df").between(2, cap)).select("h")
    useful = sets.join(rare, "h").select("h", "owner")
    touched = useful.join(dirty.select("owner"), "owner", "left_semi").select("h", F.col("owner").alias("x"))
    pairs = touched.join(useful.withColumnRenamed("owner", "y"), "h").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    involved = pairs.select(F.col("a").alias("owner")).union(pairs.select("b")).distinct()
    scored = score_pairs(pairs, sets.join(involved, "owner", "left_semi"))
    return kept.select("a", "b", "score", "shared_files", "union_files", "shared_bytes", "union_bytes").unionByName(scored.where(F.col("score") >= floor))


def score_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Scores of given pairs, as weighted_jaccard gives them, without a floor."""
    sums = totals(sets)
    return (
        shared(pairs, sets)
        .join(sums.select(F.col("owner").alias("a"), F.col("n").alias("na"), F.col("bytes").alias("ba")), "a")
        .join(sums.select(F.col("owner").alias("b"), F.col("n").alias("nb"), F.col("bytes").alias("bb")), "b")
        .withColumn("union_files", F.col("na") + F.col("nb") - F.col("shared_files"))
        .withColumn("union_bytes", F.col("ba") + F.col("bb") - F.col("shared_bytes"))
        .withColumn("score", F.when(F.col("union_bytes") == 0, 0.0).otherwise(F.col("shared_bytes") / F.col("union_bytes")))
        .select("a", "b", "score", "shared_files", "union_files", "shared_bytes", "union_bytes")
    )
