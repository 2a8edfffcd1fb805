"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import formats, hashes, paths, text
from discatlas.operators.ranking import numbered

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query(r"""SELECT id AS item_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s_/]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 200), '-+$', '', 'g'), ''), 'untitled') AS slug FROM i""")
def fun01_item_slugs(c: Catalogue) -> DataFrame:
    """Slug of every item's name."""
    return c.items.select(F.col("id").alias("item_id"), text.slug("name").alias("slug"))


@R.query(r""", s AS (SELECT id, parent_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s_/]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 200), '-+$', '', 'g'), ''), 'untitled') AS slug FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(parent_id, -1), slug ORDER BY id) AS k FROM s) SELECT id AS item_id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n""")
def fun02_numbered_slugs(c: Catalogue) -> DataFrame:
    """Slugs numbered by id where siblings share one."""
    rows = numbered(c.items.select("id", "parent_id", text.slug("name").alias("slug")), ["parent_id", "slug"], [F.col("id").asc()], "k")
    return rows.select(F.col("id").alias("item_id"), F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("k").cast("string"))).alias("slug"))


@R.query("SELECT id AS blob_id, nullif(lower(trim(sha256)), '') AS sha256, nullif(lower(trim(md5)), '') AS md5 FROM b")
def fun03_normal_hashes(c: Catalogue) -> DataFrame:
    """Hashes of the blobs trimmed and in lower case."""
    return c.blobs.select(F.col("id").alias("blob_id"), hashes.normalise_hash("sha256").alias("sha256"), hashes.normalise_hash("md5").alias("md5"))


@R.query("SELECT id AS file_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS base FROM f WHERE path IS NOT NULL")
def fun05_folder_and_base(c: Catalogue) -> DataFrame:
    """Folder and base name of every path."""
    return c.files_of("path").where("path IS NOT NULL").select(F.col("id").alias("file_id"), paths.parent("path").alias("folder"), paths.basename("path").alias("base"))


@R.query("""SELECT id AS artefact_id, CASE coalesce(nullif(regexp_extract(regexp_replace(lower(original_filename), '\\.(gz|bz2|xz|zst|z)$', ''), '\\.([a-z0-9]+)$', 1), ''), '-')
 WHEN 'adf' THEN 'SECTOR_IMAGE' WHEN 'ads' THEN 'SECTOR_IMAGE' WHEN 'adl' THEN 'SECTOR_IMAGE' WHEN 'ssd' THEN 'SECTOR_IMAGE' WHEN 'dsd' THEN 'SECTOR_IMAGE' WHEN 'img' THEN 'SECTOR_IMAGE' WHEN 'ima' THEN 'SECTOR_IMAGE' WHEN 'imd' THEN 'SECTOR_IMAGE'
 WHEN 'hfe' THEN 'FLUX' WHEN 'scp' THEN 'FLUX' WHEN 'ipf' THEN 'FLUX' WHEN 'a2r' THEN 'FLUX' WHEN 'iso' THEN 'CD_IMAGE' WHEN 'bin' THEN 'CD_IMAGE' WHEN 'cue' THEN 'CD_IMAGE' WHEN 'hdf' THEN 'HARD_DISC_IMAGE' WHEN 'hda' THEN 'HARD_DISC_IMAGE'
 WHEN 'zip' THEN 'ARCHIVE' WHEN 'arc' THEN 'ARCHIVE' WHEN 'lha' THEN 'ARCHIVE' WHEN 'lzh' THEN 'ARCHIVE' WHEN '7z' THEN 'ARCHIVE' WHEN 'tar' THEN 'ARCHIVE' WHEN 'rar' THEN 'ARCHIVE' ELSE 'UNKNOWN' END AS type FROM a""".replace("\\\\", "\\"))
def fun12_type_by_extension(c: Catalogue) -> DataFrame:
    """Artefact type that the original file name suggests."""
    return c.artefacts.select(F.col("id").alias("artefact_id"), formats.artefact_type("original_filename").alias("type"))


@R.query("SELECT id AS file_id, coalesce(lower(risc_os_filetype) IN ('ddc','a91','f89','3fb','68e'), false) OR coalesce(lower(extension) IN ('zip','arc','lha','7z','tar','rar','gz'), false) AS is_archive_type FROM f")
def fun13_archive_types(c: Catalogue) -> DataFrame:
    """Which files are archives by type or extension."""
    return c.files_of("risc_os_filetype", "extension").select(F.col("id").alias("file_id"), formats.is_archive("risc_os_filetype", "extension").alias("is_archive_type"))


@R.query("SELECT risc_os_filetype AS code, CASE lower(risc_os_filetype) " + " ".join(f"WHEN '{k}' THEN '{v} (&{k.upper()})'" for k, v in formats.FILETYPES.items()) + " ELSE '&' || upper(risc_os_filetype) END AS name, count(*) AS n FROM f WHERE risc_os_filetype IS NOT NULL GROUP BY ALL")
def fun16_filetype_names(c: Catalogue) -> DataFrame:
    """Files by file type with its display name."""
    counted = c.files_of("risc_os_filetype").where("risc_os_filetype IS NOT NULL").groupBy(F.col("risc_os_filetype").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("code", formats.filetype_name("code").alias("name"), "n")


@R.query(", t AS (SELECT id, file_size, CASE WHEN file_size < 1048576 THEN 1024 WHEN file_size < 1073741824 THEN 1048576 ELSE 1073741824 END AS unit FROM b WHERE file_size IS NOT NULL), d AS (SELECT *, (file_size * 20 + unit) // (2 * unit) AS tenths FROM t) SELECT id AS blob_id, CASE WHEN file_size < 1024 THEN file_size || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || CASE unit WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS size FROM d")
def fun17_human_sizes(c: Catalogue) -> DataFrame:
    """Sizes of the blobs for people."""
    return c.blobs.where("file_size IS NOT NULL").select(F.col("id").alias("blob_id"), text.human_size("file_size").alias("size"))


@R.query(r"""SELECT id AS artefact_id, TRY_CAST(nullif(regexp_extract(label, '(?i)\b(?:disc|disk|cd)\s*([0-9]+)(?:\s*(?:of|/)\s*([0-9]+))?', 1), '') AS INTEGER) AS number, TRY_CAST(nullif(regexp_extract(label, '(?i)\b(?:disc|disk|cd)\s*([0-9]+)(?:\s*(?:of|/)\s*([0-9]+))?', 2), '') AS INTEGER) AS out_of,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '(?i)\b(?:disc|disk|cd)\s*[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?', ' ', 'g'), '(?i)\bv?[0-9]+\.[0-9]+[a-z]?\b', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM a WHERE label IS NOT NULL""")
def fun20_labels(c: Catalogue) -> DataFrame:
    """Disc number and clean title in every label."""
    number, out_of = text.disc_number("label")
    return c.artefacts.where("label IS NOT NULL").select(F.col("id").alias("artefact_id"), number.alias("number"), out_of.alias("out_of"), text.clean_label("label").alias("title"))


@R.query("""SELECT id AS file_id, nullif(regexp_extract(path, '^((?:[^/]*/)*?![^/]+)(?:/|$)', 1), '') AS app FROM f WHERE path LIKE '%!%'""")
def fun25_app_folders(c: Catalogue) -> DataFrame:
    """Application folder of every path that has one."""
    return c.files_of("path").where("path LIKE '%!%'").select(F.col("id").alias("file_id"), paths.app_folder("path").alias("app"))


@R.query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def fun34_content_hashes(c: Catalogue) -> DataFrame:
    """Hashes of the documents' text."""
    return c.documents.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@R.query(r"""SELECT id AS artefact_id, left(uuid, 8) || CASE WHEN trim(label) <> '' THEN '-' || coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(label), '[\s_/]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 200), '-+$', '', 'g'), ''), 'untitled') ELSE '' END AS url_id FROM a""")
def fun36_url_ids(c: Catalogue) -> DataFrame:
    """Short URL id of every artefact."""
    return c.artefacts.select(F.col("id").alias("artefact_id"), text.url_id("uuid", "label").alias("url_id"))


@R.query("""SELECT id AS analysis_id, CASE WHEN regexp_matches(tool_name, '^[=+\\-@\\t\\r]') THEN '''' || tool_name ELSE tool_name END AS tool, error_message FROM an""".replace("\\\\", "\\"))
def snk09_csv_export(c: Catalogue) -> DataFrame:
    """Rows of a CSV export, with formulas made harmless."""
    return c.analyses.select(F.col("id").alias("analysis_id"), text.csv_guard("tool_name").alias("tool"), text.csv_guard("error_message").alias("error_message"))


@R.query("SELECT id AS file_id, coalesce(md5, 'id:' || id) AS dedupe_key, nullif(md5, '') AS fingerprint FROM f")
def fun_content_keys(c: Catalogue) -> DataFrame:
    """Keys under which files fold together for search and for application fingerprints."""
    none = F.lit(None).cast("string")
    return c.files_of("md5").select(F.col("id").alias("file_id"), hashes.dedupe_key(none, none, "md5", "id").alias("dedupe_key"), hashes.fingerprint_key("md5", none, none).alias("fingerprint"))


@R.query("SELECT upper(load) AS load, filetype, stamp_us FROM (VALUES " + ", ".join(f"('FFF{t}{h:02X}', '{t.lower()}', {(h << 32 | 305419896) * 10_000 - 2_208_988_800_000_000})" for t in ("FFD", "FEB", "FFB") for h in range(0x30, 0x70, 8)) + ") AS t(load, filetype, stamp_us)")
def fun07_load_addresses(c: Catalogue) -> DataFrame:
    """File type and stamp in load and exec addresses, over a grid of both."""
    grid = c.spark.range(0x30, 0x70, 8).withColumn("t", F.explode(F.array(*(F.lit(t) for t in ("FFD", "FEB", "FFB"))))).select(F.concat(F.lit("FFF"), "t", F.lpad(F.hex("id"), 2, "0")).alias("load"), F.lit("12345678").alias("exec"))
    return grid.select("load", formats.filetype_of_load("load").alias("filetype"), formats.stamp_of_load("load", "exec").alias("stamp_us"))
