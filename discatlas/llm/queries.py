"""Queries of the problems of training data (names pN_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discatlas.llm import chunking, encodings, leaks, packing, setpairs
from discatlas.tables import distinct_delivery, load


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    """Path sets of the partitions and sha256 sets of the catalogue items: group, id, value."""
    files = load(spark, folder, "extracted_files").where("is_directory = false").select(F.lit("path").alias("group"), F.col("partition_id").alias("id"), F.col("path").alias("value"))
    held = distinct_delivery(load(spark, folder, "artefacts").where("upload_blob_id IS NOT NULL AND item_id IS NOT NULL").select("id", "item_id", "upload_blob_id"), "id")
    pairs = held.select("item_id", "upload_blob_id").distinct()
    blobs = distinct_delivery(load(spark, folder, "upload_blobs").select(F.col("id").alias("upload_blob_id"), F.lower("sha256").alias("value")), "upload_blob_id")
    return files.unionByName(pairs.join(blobs, "upload_blob_id").select(F.lit("sha256").alias("group"), F.col("item_id").alias("id"), "value"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sets of at least 4 values that overlap by 0.6 or more, equal ones included."""
    return setpairs.similar_sets(_sets(spark, folder), 0.6, 4).select(F.col("group").alias("set_kind"), "left_id", "right_id")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal sets that each set of at least 4 values belongs to."""
    return setpairs.classes(_sets(spark, folder), 4)[1].select(F.col("group").alias("set_kind"), F.col("id").alias("set_id"), F.col("set").alias("class_id"), F.col("n").alias("n_values"))


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose name or path is not plain ASCII, once each."""
    files = load(spark, folder, "extracted_files").select("id", "filename", "path")
    return distinct_delivery(files.where(r"filename RLIKE '[^\\x00-\\x7F]' OR path RLIKE '[^\\x00-\\x7F]'"), "id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """File names and paths garbled by a wrong decoding, with their original."""
    return encodings.restore(_garbled(spark, folder), "id", ["filename", "path"]).withColumnRenamed("key", "file_id")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and position of every document or piece, 2,048 tokens a container."""
    return packing.pack(load(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which they hold 13 or more consecutive words."""
    return leaks.leaks(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents over 1,024 tokens."""
    return p9_pieces(spark, folder).where("piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered pieces of the documents over 1,024 tokens, overlapping by 64 tokens or fewer."""
    return chunking.pieces(load(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p6_found": p6_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
}

_SETS = """
WITH m AS (
  SELECT DISTINCT 'path' AS set_kind, partition_id AS id, path AS v FROM extracted_files WHERE is_directory = false AND path IS NOT NULL AND partition_id IS NOT NULL
  UNION
  SELECT DISTINCT 'sha256', a.item_id, lower(b.sha256) FROM artefacts a JOIN upload_blobs b ON a.upload_blob_id = b.id WHERE a.item_id IS NOT NULL AND b.sha256 IS NOT NULL),
s AS (SELECT set_kind, id, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 4)
"""
ORACLE = {
    "p1_found": _SETS + """, c AS (
  SELECT a.set_kind, a.id AS left_id, b.id AS right_id, count(*) AS n FROM m a JOIN m b ON a.set_kind = b.set_kind AND a.v = b.v AND a.id < b.id GROUP BY ALL)
SELECT c.set_kind, c.left_id, c.right_id FROM c
JOIN s l ON l.set_kind = c.set_kind AND l.id = c.left_id JOIN s r ON r.set_kind = c.set_kind AND r.id = c.right_id
WHERE c.n >= 0.6 * (l.n + r.n - c.n)""",
    "p1_classes": _SETS + """, f AS (SELECT m.set_kind, m.id, s.n, string_agg(md5(v), ',' ORDER BY md5(v)) AS f FROM m JOIN s USING (set_kind, id) GROUP BY ALL)
SELECT set_kind, id AS set_id, min(id) OVER (PARTITION BY set_kind, f) AS class_id, n AS n_values FROM f""",
    "p8_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(k) WHERE len(w) >= 13),
ig AS (SELECT item_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM i, unnest(range(1, len(w) - 11)) AS t(k) WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
