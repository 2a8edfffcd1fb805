"""Reference databases of known files: linking, recognition of products, generation.

Known files have (id, product, md5, size, required). Joins are on distinct
content, so a content that many files and many products share is not multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discatlas.functions import hashes


def link(files: DataFrame, known: DataFrame) -> DataFrame:
    """Lowest known file of equal md5 and lenient size of each file: file_id, known_id.

    A null size on either side matches any size. Files have (file_id, md5, size).
    The lowest ids per content and size are aggregated first, so the join to the
    files never multiplies rows. Files without a match are left out.
    """
    known = known.where("md5 IS NOT NULL AND md5 != ''")
    exact = known.where("size IS NOT NULL").groupBy("md5", "size").agg(F.min("id").alias("exact_id"))
    by_hash = known.groupBy("md5").agg(F.min("id").alias("any_id"), F.min(F.when(F.col("size").isNull(), F.col("id"))).alias("open_id"))
    rows = files.where("md5 IS NOT NULL AND md5 != ''").join(by_hash, "md5").join(exact, ["md5", "size"], "left")
    found = F.when(F.col("size").isNull(), F.col("any_id")).otherwise(F.least("exact_id", "open_id"))
    return rows.select("file_id", found.alias("known_id")).where("known_id IS NOT NULL")


def matches(files: DataFrame, known: DataFrame) -> DataFrame:
    """Every (file content, product) match once: md5, product, known_id (lowest)."""
    wanted = files.where("md5 IS NOT NULL").select("md5").distinct()
    return known.join(wanted, "md5", "left_semi").groupBy("md5", "product").agg(F.min("id").alias("known_id"))


def recognise(files: DataFrame, known: DataFrame) -> DataFrame:
    """Folders that hold all required files of a product among their immediate children.

    files: (partition_id, folder, md5); known: (id, product, md5, required).
    Gives partition_id, folder, product, n_required, n_optional (matched) and
    n_optional_total. Products without required files are not recognised.

    Relational division seeded by rarity: candidates come from each product's
    rarest required content only, then the rest is verified with the folder as a
    further join key. Two known files of one content each count.
    """
    present = files.where("md5 IS NOT NULL").select("partition_id", "folder", "md5").distinct()
    frequency = present.groupBy("md5").agg(F.count(F.lit(1)).alias("df"))
    required = known.where("required").join(frequency, "md5", "left")
    products = required.groupBy("product").agg(F.count(F.lit(1)).alias("n_required"), F.count_if(F.col("df").isNull()).alias("absent"), F.min_by("md5", F.struct("df", "md5")).alias("seed")).where("absent = 0")
    seeds = products.select("product", "n_required", F.col("seed").alias("md5"))
    candidates = present.join(seeds, "md5").select("partition_id", "folder", "product", "n_required")
    wanted = candidates.join(known.select("product", "id", "md5", "required"), "product")
    held = wanted.join(present.withColumn("held", F.lit(True)), ["partition_id", "folder", "md5"], "left")
    counted = held.groupBy("partition_id", "folder", "product", "n_required").agg(F.count_if(F.col("required") & F.col("held")).alias("matched"), F.count_if(~F.col("required") & F.col("held")).alias("n_optional"), F.count_if(~F.col("required")).alias("n_optional_total"))
    return counted.where("matched = n_required").drop("matched")


def fingerprint(files: DataFrame, keys: list[str], entry: Column) -> DataFrame:
    """Digest of the set of entries per key, whatever their order: keys, n_files, fingerprint."""
    distinct = files.select(*keys, entry.alias("entry")).where("entry IS NOT NULL").distinct()
    return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), hashes.set_fingerprint("entry").alias("fingerprint"))


def uniqueness(files: DataFrame, content: str, places: list[str]) -> DataFrame:
    """In how many different places each content occurs: content, n_places, is_unique."""
    distinct = files.where(F.col(content).isNotNull()).select(content, *places).distinct()
    return distinct.groupBy(content).agg(F.count(F.lit(1)).alias("n_places")).withColumn("is_unique", F.col("n_places") == 1)


def spelling(rows: DataFrame, key: Column, spelled: str) -> DataFrame:
    """Most frequent spelling of each key, the first in order on ties: key, spelling, n."""
    counted = rows.select(key.alias("key"), F.col(spelled).alias("spelling")).groupBy("key", "spelling").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("key").orderBy(F.desc("n"), "spelling")
    return counted.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def classify(known: DataFrame) -> DataFrame:
    """What can be recognised of each product: product, n_required, n_optional, reason (null if it can be recognised)."""
    counted = known.groupBy("product").agg(F.count_if("required").alias("n_required"), F.count_if(~F.col("required")).alias("n_optional"), F.count_if(F.col("required") & F.col("md5").isNull()).alias("unhashed"))
    reason = F.when(F.col("n_required") == 0, "no required file").when(F.col("unhashed") > 0, "a required file has no hash")
    return counted.select("product", "n_required", "n_optional", reason.alias("reason"))


def canonical_source(names: DataFrame, name: str, rules: list[tuple[str, str]]) -> DataFrame:
    """names with the source of the first rule (pattern, source) whose anchored pattern fits, ignoring case; null if none does.

    Rules are a short list of the user's; they become one expression.
    """
    source = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        source = F.when(F.col(name).rlike(f"(?i)^(?:{pattern})$"), F.lit(value)).otherwise(source)
    return names.withColumn("source", source)
