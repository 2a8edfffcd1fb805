"""Queries in the search language and filters of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import formats, hashes, paths, text
from discatlas.operators import listings, search

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
FILE_COLUMNS = ("partition_id", "path", "filename", "extension", "file_size", "md5", "risc_os_filetype", "is_directory", "extraction_depth")


def found(c: Catalogue, query: str) -> DataFrame:
    return search.search_files(query, c.files_of(*FILE_COLUMNS), c.partitions, c.artefacts, c.items)


def _search(name: str, query: str, where: str, doc: str, joins: str = "") -> None:
    def run(c: Catalogue) -> DataFrame:
        return found(c, query).select(F.col("id").alias("file_id"))

    run.__doc__ = f"{doc}: {query}"
    R.query(f" SELECT f.id AS file_id FROM f {joins} WHERE NOT f.is_directory AND {where}", name)(run)


P = "JOIN p ON p.id = f.partition_id "
A = P + "JOIN a ON a.id = p.artefact_id "
I = A + "JOIN i ON i.id = a.item_id "  # noqa: E741
_search("flt02_hash_prefix", "md5:0a", "f.md5 ILIKE '0a%'", "Files by the beginning of a hash")
_search("flt03_name_substring", "filename:*sprite*", "f.filename ILIKE '%sprite%'", "Files by part of the name")
_search("flt03_name_wildcard", "filename:!r*", "f.filename ILIKE '!r%'", "Files by a pattern of the name")
_search("flt03_path_substring", "path:sprite", "f.path ILIKE '%sprite%'", "Files by part of the path")
_search("flt03_name_exact", "filename:!run", "f.filename ILIKE '!run'", "Files by the whole name")
_search("flt04_path_wildcard", "path:*/!Boot", "f.path ILIKE '%/!Boot'", "Files by a pattern of the path")
_search("flt06_null_safe_negation", "filename:* !filetype:Text", "f.filename ILIKE '%' AND NOT coalesce(lower(f.risc_os_filetype) = 'fff', false)", "Negation keeps files without a type")
_search("flt08_size_range", "size:1000..5000", "f.file_size BETWEEN 1000 AND 5000", "Files by a range of sizes")
_search("flt08_size_bound", "size:>=100000", "f.file_size >= 100000", "Files by a bound of the size")
_search("flt09_filetype", "type:BASIC type:ffa", "lower(f.risc_os_filetype) IN ('ffb', 'ffa')", "Files by name or code of the type")
_search("flt10_file_clause", 'ext:txt ext:doc size:<2000 !path:Utils/*', "lower(f.extension) IN ('txt', 'doc') AND f.file_size < 2000 AND NOT coalesce(f.path ILIKE 'Utils/%', false)", "All keys, any value of a key, and a negation")
_search("flt13_partition_clause", "fs:ADFS filename:*!Run*", "upper(p.filesystem) = 'ADFS' AND f.filename ILIKE '%!Run%'", "Files of a file system", P)
_search("joi01_star_join", "platform:archimedes artefact:FLUX filetype:Obey", "lower(i.platform) = 'archimedes' AND upper(a.artefact_type) = 'FLUX' AND lower(f.risc_os_filetype) = 'feb'", "Files over all four tables", I)


@R.query(" SELECT coalesce(f.md5, 'id:' || f.id) AS hkey, arg_min(f.id, (coalesce(f.path, chr(1114109)), f.id)) AS id, count(*) AS n FROM f WHERE NOT f.is_directory AND f.filename ILIKE '%a%' GROUP BY 1")
def pip04_search_folded(c: Catalogue) -> DataFrame:
    """Search with equal contents folded to their first file in path order."""
    none = F.lit(None).cast("string")
    return search.fold(found(c, "filename:*a*"), hashes.dedupe_key(none, none, "md5", "id"), ["path", "id"])


@R.query(" SELECT 'files' AS bucket, count(*) AS n FROM f WHERE NOT is_directory AND filename ILIKE '%disc%' UNION ALL SELECT 'artefacts', count(*) FROM a WHERE label ILIKE '%disc%' UNION ALL SELECT 'items', count(*) FROM i WHERE name ILIKE '%disc%' UNION ALL SELECT 'documents', count(*) FROM documents WHERE text ILIKE '%disc%'")
def set05_bucket_totals(c: Catalogue) -> DataFrame:
    """How often a word is found in files, artefacts, items and documents."""
    parts = [
        ("files", found(c, "filename:*disc*")),
        ("artefacts", search.search_words(["disc"], c.artefacts.select("label"), ["label"])),
        ("items", search.search_words(["disc"], c.items.select("name"), ["name"])),
        ("documents", search.search_words(["disc"], c.documents.select("text"), ["text"])),
    ]
    out = None
    for name, rows in parts:
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("bucket"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@R.query(" SELECT doc_id FROM documents WHERE (text ILIKE '%disc%' OR source ILIKE '%disc%') AND (text ILIKE '%file%' OR source ILIKE '%file%')")
def flt14_free_text(c: Catalogue) -> DataFrame:
    """Documents in which every word occurs in text or source."""
    return search.search_words(["disc", "file"], c.documents.select("doc_id", "text", "source"), ["text", "source"]).select("doc_id")


@R.query(r" SELECT id AS file_id FROM f WHERE NOT is_directory AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?is)^!.*s$')")
def flt22_name_glob(c: Catalogue) -> DataFrame:
    """Files whose base name fits a shell pattern."""
    files = c.files_of("path", "is_directory").where("NOT is_directory")
    return files.where(paths.basename("path").rlike(paths.glob("!*s"))).select(F.col("id").alias("file_id"))


@R.query(" SELECT partition_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n_children, count(*) FILTER (WHERE is_directory) AS n_folders FROM f WHERE path IS NOT NULL GROUP BY ALL")
def flt28_children_of_folders(c: Catalogue) -> DataFrame:
    """Immediate children of every folder: an equality on the computed parent instead of a prefix pattern."""
    files = c.files_of("partition_id", "path", "is_directory").where("path IS NOT NULL")
    return files.groupBy("partition_id", paths.parent("path").alias("folder")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if("is_directory").alias("n_folders"))


@R.query(" SELECT id AS analysis_id, analysis_type, error_message FROM an WHERE status = 'FAILED' AND error_message ILIKE '%time%'")
def flt23_failed_analyses(c: Catalogue) -> DataFrame:
    """Failed analyses by part of the error."""
    return c.analyses.where((F.col("status") == "FAILED") & F.col("error_message").ilike(text.like_search("time"))).select(F.col("id").alias("analysis_id"), "analysis_type", "error_message")


@R.query(" SELECT id AS file_id, partition_id FROM f WHERE (is_archive OR extraction_depth > 0) AND NOT is_directory")
def flt25_archives_and_nested(c: Catalogue) -> DataFrame:
    """Archives and what was extracted from them."""
    files = c.files_of("partition_id", "is_archive", "extraction_depth", "is_directory")
    return files.where("(is_archive OR extraction_depth > 0) AND NOT is_directory").select(F.col("id").alias("file_id"), "partition_id")


@R.query(" SELECT a.id AS artefact_id FROM a JOIN i ON i.id = a.item_id WHERE a.parent_artefact_id IS NULL AND i.platform IN ('archimedes', 'bbc_micro')")
def flt26_root_selection(c: Catalogue) -> DataFrame:
    """Root artefacts of two platforms."""
    wanted = c.items.where(F.col("platform").isin("archimedes", "bbc_micro")).select(F.col("id").alias("item_id"))
    return c.artefacts.where("parent_artefact_id IS NULL").join(wanted, "item_id", "left_semi").select(F.col("id").alias("artefact_id"))


@R.query(" SELECT DISTINCT i.id AS item_id FROM i JOIN a ON a.item_id = i.id JOIN documents d ON d.artefact_id = a.id WHERE d.category = 'manual'")
def joi17_items_with_manuals(c: Catalogue) -> DataFrame:
    """Items one of whose artefacts has a manual: semi-joins, so nothing multiplies."""
    held = c.artefacts.select("id", "item_id").join(c.documents.where("category = 'manual'").select(F.col("artefact_id").alias("id")), "id", "left_semi")
    return c.items.select(F.col("id").alias("item_id")).join(held.select("item_id"), "item_id", "left_semi")


@R.query(" SELECT left(uuid, 2) AS prefix, count(*) AS n, min(uuid) AS first_uuid FROM a GROUP BY 1")
def flt30_uuid_prefixes(c: Catalogue) -> DataFrame:
    """Artefacts by the first characters of the uuid."""
    return c.artefacts.groupBy(F.substring("uuid", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("uuid").alias("first_uuid"))


@R.query(" SELECT d.doc_id, a.item_id, i.name FROM documents d JOIN a ON a.id = d.artefact_id LEFT JOIN i ON i.id = a.item_id")
def joi03_documents_to_items(c: Catalogue) -> DataFrame:
    """Every document's artefact and item."""
    held = c.artefacts.select(F.col("id").alias("artefact_id"), "item_id")
    return c.documents.select("doc_id", "artefact_id").join(held, "artefact_id").join(c.items.select(F.col("id").alias("item_id"), "name"), "item_id", "left").select("doc_id", "item_id", "name")


@R.query(" SELECT a.item_id, d.source AS tag, count(*) AS n FROM documents d JOIN a ON a.id = d.artefact_id WHERE d.source IS NOT NULL AND a.item_id IS NOT NULL GROUP BY ALL")
def joi04_tags_of_items(c: Catalogue) -> DataFrame:
    """Sources of documents as tags of the items they belong to."""
    held = c.artefacts.where("item_id IS NOT NULL").select(F.col("id").alias("artefact_id"), "item_id")
    return c.documents.where("source IS NOT NULL").select("artefact_id", F.col("source").alias("tag")).join(held, "artefact_id").groupBy("item_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@R.query(" SELECT b.id AS blob_id, so.object_id, so.storage_directory FROM b LEFT JOIN so ON so.storage_path = b.storage_path")
def joi15_blobs_with_objects(c: Catalogue) -> DataFrame:
    """Every blob with the objects listed under its path, if any."""
    objects = c.stored.select("storage_path", "object_id", "storage_directory")
    return c.blobs.select(F.col("id").alias("blob_id"), "storage_path").join(objects, "storage_path", "left").select("blob_id", "object_id", "storage_directory")


@R.query(" SELECT id AS artefact_id FROM a WHERE id NOT IN (SELECT artefact_id FROM an WHERE artefact_id IS NOT NULL)")
def joi16_never_analysed(c: Catalogue) -> DataFrame:
    """Artefacts without any analysis."""
    return c.artefacts.select(F.col("id").alias("artefact_id")).join(c.analyses.select("artefact_id"), "artefact_id", "left_anti")


@R.query(" SELECT lower(b.sha256) AS sha256, count(DISTINCT b.id) AS n_blobs, count(DISTINCT a.id) AS n_artefacts, min(b.id) AS first_blob FROM b LEFT JOIN a ON a.upload_blob_id = b.id GROUP BY 1")
def joi20_hash_lookup(c: Catalogue) -> DataFrame:
    """For every hash its blobs and all artefacts that hold it; artefacts are counted per blob before the join."""
    held = c.artefacts.where("upload_blob_id IS NOT NULL").groupBy(F.col("upload_blob_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    joined = c.blobs.select("id", F.lower("sha256").alias("sha256")).join(held, "id", "left")
    return joined.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_artefacts"), F.min("id").alias("first_blob"))


@R.query(" SELECT partition_id, path, CASE WHEN count(DISTINCT md5) = 1 THEN min(md5) END AS md5 FROM f WHERE path IS NOT NULL GROUP BY partition_id, path")
def joi23_single_source_hash(c: Catalogue) -> DataFrame:
    """Hash of every path where there is exactly one; min and max stand in for a distinct count."""
    files = c.files_of("partition_id", "path", "md5").where("path IS NOT NULL")
    return files.groupBy("partition_id", "path").agg(F.when(F.min("md5") == F.max("md5"), F.min("md5")).alias("md5"))


@R.query(" SELECT md5 AS h FROM f WHERE md5 IS NOT NULL UNION SELECT lower(md5) FROM b WHERE md5 IS NOT NULL")
def set06_distinct_hashes(c: Catalogue) -> DataFrame:
    """All md5 values of files and blobs."""
    one = c.raw("extracted_files").where("md5 IS NOT NULL").select(F.col("md5").alias("h"))
    return one.union(c.raw("upload_blobs").where("md5 IS NOT NULL").select(F.lower("md5"))).distinct()


@R.query(" SELECT owner_id FROM a WHERE owner_id IS NOT NULL INTERSECT SELECT user_id FROM k")
def set02_owners_with_keys(c: Catalogue) -> DataFrame:
    """Users who own artefacts and hold API keys."""
    return c.artefacts.where("owner_id IS NOT NULL").select("owner_id").intersect(c.keys.select("user_id"))


@R.query(" SELECT id FROM u EXCEPT SELECT owner_id FROM a")
def set04_users_without_artefacts(c: Catalogue) -> DataFrame:
    """Users who own nothing."""
    return c.users.select("id").subtract(c.artefacts.select("owner_id"))


@R.query(" SELECT id AS artefact_id, label FROM a ORDER BY lower(label) NULLS LAST, id LIMIT 50 OFFSET 50")
def srt02_second_page(c: Catalogue) -> DataFrame:
    """Second page of fifty artefacts by label."""
    rows = c.artefacts.select(F.col("id").alias("artefact_id"), "label")
    return listings.page(rows, [F.lower("label").asc_nulls_last(), F.col("artefact_id").asc()], 2, 50)[0]


@R.query(" SELECT id AS analysis_id, status, created_at FROM an ORDER BY CASE status WHEN 'RUNNING' THEN 0 WHEN 'PENDING' THEN 1 WHEN 'FAILED' THEN 2 ELSE 3 END, created_at DESC, id LIMIT 100")
def srt04_status_order(c: Catalogue) -> DataFrame:
    """First hundred analyses by a fixed order of statuses, newest first."""
    rows = c.analyses.select(F.col("id").alias("analysis_id"), "status", "created_at")
    return rows.orderBy(listings.ranked("status", ["RUNNING", "PENDING", "FAILED"]), F.desc("created_at"), "analysis_id").limit(100)


@R.query(" SELECT id AS analysis_id, priority, created_at FROM an WHERE status = 'PENDING' ORDER BY priority DESC, created_at, id LIMIT 50")
def srt05_queue_order(c: Catalogue) -> DataFrame:
    """Next fifty pending analyses."""
    rows = c.analyses.where("status = 'PENDING'").select(F.col("id").alias("analysis_id"), "priority", "created_at")
    return rows.orderBy(F.desc("priority"), "created_at", "analysis_id").limit(50)


@R.query(r""" SELECT id AS file_id, path FROM f WHERE NOT is_directory AND path IS NOT NULL ORDER BY lower(path), id LIMIT 100""")
def srt01_canonical_order(c: Catalogue) -> DataFrame:
    """First hundred files in path order."""
    files = c.files_of("path", "is_directory").where("NOT is_directory AND path IS NOT NULL")
    return files.select(F.col("id").alias("file_id"), "path").orderBy(F.lower("path"), "file_id").limit(100)


@R.query(r""" SELECT id AS artefact_id, array_to_string(list_transform(regexp_extract_all(lower(label), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(coalesce(nullif(ltrim(r, '0'), ''), '0'), 20, '0') ELSE r END), '') AS sort_key FROM a WHERE label IS NOT NULL""")
def srt07_natural_order(c: Catalogue) -> DataFrame:
    """Natural sort key of every artefact label."""
    return c.artefacts.where("label IS NOT NULL").select(F.col("id").alias("artefact_id"), text.natural_key("label").alias("sort_key"))


@R.query(" SELECT f.id AS file_id, lower(i.name) AS item, lower(a.label) AS artefact, lower(f.path) AS path, p.filesystem FROM f " + I.replace("JOIN", "LEFT JOIN") + " WHERE NOT f.is_directory AND f.md5 IN (SELECT md5 FROM f WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1)")
def pip06_duplicate_listing(c: Catalogue) -> DataFrame:
    """All copies of contents that occur more than once, with where they are."""
    files = c.files_of("partition_id", "path", "md5", "is_directory")
    dup = files.where("md5 IS NOT NULL").groupBy("md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("md5")
    copies = files.where("NOT is_directory").join(dup, "md5", "left_semi")
    place = c.partitions.select(F.col("id").alias("partition_id"), "artefact_id", "filesystem").join(c.artefacts.select(F.col("id").alias("artefact_id"), "item_id", F.lower("label").alias("artefact")), "artefact_id", "left").join(c.items.select(F.col("id").alias("item_id"), F.lower("name").alias("item")), "item_id", "left")
    return copies.join(place, "partition_id", "left").select(F.col("id").alias("file_id"), "item", "artefact", F.lower("path").alias("path"), "filesystem")


@R.query(" SELECT id AS file_id, CASE WHEN risc_os_filetype IS NULL THEN lower(extension) ELSE risc_os_filetype END AS kind, is_archive FROM f WHERE (regexp_matches(filename, '(?is)^.*un.*$') AND NOT is_directory) OR is_archive")
def flt21_listing_filter(c: Catalogue) -> DataFrame:
    """Listing by a pattern of the name; archives are always kept."""
    files = c.files_of("filename", "extension", "risc_os_filetype", "is_directory", "is_archive")
    kept = files.where((F.col("filename").rlike(paths.glob("*un*")) & ~F.col("is_directory")) | F.col("is_archive"))
    return kept.select(F.col("id").alias("file_id"), F.coalesce("risc_os_filetype", F.lower("extension")).alias("kind"), "is_archive")


@R.query(" SELECT item_id, count(*) AS n, count(*) FILTER (WHERE lower(original_filename) LIKE '%.zip') AS n_zip, count(DISTINCT artefact_type) AS n_types FROM a WHERE item_id IS NOT NULL GROUP BY item_id")
def itm01_item_overview(c: Catalogue) -> DataFrame:
    """Artefacts of every item: all, zipped, and how many types."""
    rows = c.artefacts.where("item_id IS NOT NULL")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(formats.extension("original_filename") == "zip").alias("n_zip"), F.count_distinct("artefact_type").alias("n_types"))
