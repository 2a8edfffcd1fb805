"""Reading directories and reference databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discatlas.functions import formats, hashes, paths


def directory(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Files below a folder: path (relative), filename, file_size, modified, md5, sha1, sha256, risc_os_filetype, and content if wanted.

    The type comes from a name,xxx suffix, which the name then lacks. Hashes are
    computed in the scan; nothing goes through the driver. Files of no bytes are
    not listed, as the scan leaves them out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.removeprefix("file://").rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^{_quote(base)}/", "")
    name, kind = paths.suffix_type(paths.basename(relative))
    columns = [relative.alias("path"), name.alias("filename"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), kind.alias("risc_os_filetype")]
    return raw.select(*columns, *(["content"] if content else []))


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def importable(files: DataFrame) -> DataFrame:
    """Disc images and archives of a listing (path) by top folder: group, path, base, raw_type, form (0 archive, 1 compressed, 2 raw)."""
    name = F.lower(paths.basename("path"))
    compressed = name.rlike(rf"\.(?:{'|'.join(formats.COMPRESSORS)})$")
    raw = formats.extension(paths.basename("path"))
    form = F.when(formats.lookup(formats.IMAGE_TYPES, raw) == "ARCHIVE", 0).when(compressed, 1).otherwise(2)
    base = F.regexp_replace(F.regexp_replace(paths.basename("path"), rf"(?i)\.(?:{'|'.join(formats.COMPRESSORS)})$", ""), r"\.[A-Za-z0-9]+$", "")
    group = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    return files.select(group.alias("group"), "path", base.alias("base"), raw.alias("raw_type"), form.alias("form")).where(formats.lookup(formats.IMAGE_TYPES, F.col("raw_type")).isNotNull())


def sidecars(images: DataFrame, files: DataFrame) -> DataFrame:
    """Text and picture files beside an image whose name begins with the image's base: image, sidecar. An equi-join on the folder."""
    left = images.select(F.col("path").alias("image"), paths.parent("path").alias("folder"), F.lower("base").alias("base"))
    right = files.select(F.col("path").alias("sidecar"), paths.parent("path").alias("folder"), F.lower(paths.basename("path")).alias("name"))
    kinds = r"\.(?:txt|nfo|md|jpg|jpeg|png|log)$"
    return left.join(right.where(F.col("name").rlike(kinds)), "folder").where("image != sidecar AND startswith(name, base)").select("image", "sidecar")


DATABASE = "schema_version int, name string, products array<struct<title:string, files:array<struct<filename:string, md5:string, sha1:string, sha256:string, file_size:long, relative_path:string, is_required:boolean>>>>"


def database_json(spark: SparkSession, path: str) -> DataFrame:
    """Known files of JSON reference databases, one per document: database, product, filename, md5, sha1, sha256, file_size, relative_path, is_required.

    Only schema version 1 is read. Products and files without a title or name are
    left out; is_required is true unless it is false.
    """
    return database_files(spark.read.schema(DATABASE).option("multiLine", "true").json(path))


def database_files(read: DataFrame) -> DataFrame:
    """Known files of parsed reference databases."""
    products = read.where("schema_version = 1").select(F.col("name").alias("database"), F.explode("products").alias("p")).where(F.trim("p.title") != "")
    files = products.select("database", F.trim("p.title").alias("product"), F.explode("p.files").alias("f"))
    return _known(files.select("database", "product", "f.*"))


def database_csv(spark: SparkSession, path: str, database: str) -> DataFrame:
    """The same from CSV with a header: product_title, filename, md5, sha1, sha256, file_size, relative_path, is_required ('1', blank counts as 1)."""
    read = spark.read.option("header", "true").csv(path).where(F.trim("product_title") != "")
    required = F.coalesce(F.nullif(F.trim("is_required"), F.lit("")), F.lit("1")) == "1"
    return _known(read.select(F.lit(database).alias("database"), F.trim("product_title").alias("product"), "filename", "md5", "sha1", "sha256", F.trim("file_size").try_cast("long").alias("file_size"), "relative_path", required.alias("is_required")))


def _known(files: DataFrame) -> DataFrame:
    kept = files.where("filename IS NOT NULL AND filename != ''")
    return kept.select("database", "product", "filename", *(hashes.normalise_hash(h).alias(h) for h in ("md5", "sha1", "sha256")), "file_size", "relative_path", F.coalesce("is_required", F.lit(True)).alias("is_required"))


def import_new(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows not yet in a reference database: by md5 within a product, by sha1 where there is no md5; the first of equals by name."""
    key = F.coalesce(F.concat(F.lit("m:"), "md5"), F.concat(F.lit("s:"), "sha1"))
    fresh = rows.withColumn("__key", key).where("__key IS NOT NULL")
    first = fresh.groupBy("product", "__key").agg(F.min(F.struct("filename", *(c for c in rows.columns if c not in ("filename", "product")))).alias("r"))
    held = target.withColumn("__key", key).where("__key IS NOT NULL").select("product", "__key")
    return first.join(held, ["product", "__key"], "left_anti").select("product", "r.*")
