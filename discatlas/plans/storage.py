"""Queries on duplicates, storage, counters and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import formats, hashes
from discatlas.operators import dedup, listings

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
REFS = ", r AS (SELECT a.id AS artefact_id, b.id AS blob_id, b.file_size, lower(b.sha256) AS sha256 FROM a JOIN b ON b.id = a.upload_blob_id), g AS (SELECT file_size, sha256, count(*) AS n FROM r WHERE file_size > 0 AND sha256 IS NOT NULL GROUP BY ALL)"
STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED"]


def refs(c: Catalogue) -> DataFrame:
    return dedup.references(c.artefacts, c.blobs)


@R.query("SELECT count(*) AS n_blobs, coalesce(sum(file_size), 0)::BIGINT AS n_bytes FROM b")
def agg15_blob_totals(c: Catalogue) -> DataFrame:
    """Number and bytes of the uploaded blobs."""
    return c.blobs.agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))


@R.query(REFS + " SELECT sum(file_size)::BIGINT AS logical_bytes FROM r")
def agg16_logical_bytes(c: Catalogue) -> DataFrame:
    """Bytes summed over all artefacts that refer to blobs."""
    return refs(c).agg(F.sum("file_size").alias("logical_bytes"))


@R.query(REFS + " SELECT count(*) AS n FROM g WHERE n > 1")
def agg17_shared_contents(c: Catalogue) -> DataFrame:
    """How many contents several artefacts share."""
    return dedup.duplicate_groups(refs(c).where("file_size > 0"), ["file_size", "sha256"]).agg(F.count(F.lit(1)).alias("n"))


@R.query(REFS + " SELECT sum(file_size)::BIGINT AS physical_bytes, sum(file_size * n)::BIGINT AS logical_bytes, sum(file_size * n - file_size)::BIGINT AS saved_bytes, count(*) FILTER (WHERE n > 1) AS shared_contents, sum(file_size * n)::BIGINT::DOUBLE / sum(file_size)::BIGINT AS ratio FROM g")
def agg18_dedup_report(c: Catalogue) -> DataFrame:
    """Physical and logical bytes, what sharing saves, and the ratio."""
    return dedup.storage_report(refs(c))


@R.query(REFS + " SELECT file_size, sha256, n FROM g WHERE n > 1")
def agg19_duplicate_groups(c: Catalogue) -> DataFrame:
    """Contents that several artefacts share."""
    return dedup.duplicate_groups(refs(c).where("file_size > 0"), ["file_size", "sha256"])


@R.query("SELECT md5, count(*) AS n, count(DISTINCT partition_id) AS n_partitions FROM f WHERE NOT is_directory AND md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1")
def agg20_duplicate_badges(c: Catalogue) -> DataFrame:
    """Copies of every file content that occurs more than once."""
    files = c.files_of("md5", "partition_id", "is_directory").where("NOT is_directory AND md5 IS NOT NULL")
    return files.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition_id").alias("n_partitions")).where("n > 1")


@R.query("""SELECT p.id AS partition_id, count(f.id) AS total_files, count(f.id) FILTER (WHERE NOT f.is_directory) AS plain_files, count(f.id) FILTER (WHERE NOT f.is_directory AND f.md5 IS NULL) AS unhashed_files, coalesce(sum(f.file_size), 0)::BIGINT AS n_bytes
FROM p LEFT JOIN f ON f.partition_id = p.id GROUP BY p.id""")
def agg21_partition_counters(c: Catalogue) -> DataFrame:
    """Counters of every partition, zero where it has no files."""
    files = c.files_of("partition_id", "md5", "is_directory", "file_size")
    counted = files.groupBy("partition_id").agg(F.count(F.lit(1)).alias("total_files"), F.count_if(~F.col("is_directory")).alias("plain_files"), F.count_if(~F.col("is_directory") & F.col("md5").isNull()).alias("unhashed_files"), F.sum("file_size").alias("n_bytes"))
    return c.partitions.select(F.col("id").alias("partition_id")).join(counted, "partition_id", "left").fillna(0)


@R.query("""SELECT p.id AS partition_id, p.total_files AS stored, count(f.id) AS delivered FROM p LEFT JOIN extracted_files f ON f.partition_id = p.id WHERE p.total_files IS NOT NULL GROUP BY ALL HAVING count(f.id) <> p.total_files""")
def agg21_counter_drift(c: Catalogue) -> DataFrame:
    """Partitions whose stored total differs from the rows delivered for them: files missing or delivered again."""
    counted = c.raw("extracted_files").groupBy("partition_id").agg(F.count(F.lit(1)).alias("delivered"))
    joined = c.partitions.where("total_files IS NOT NULL").select(F.col("id").alias("partition_id"), F.col("total_files").alias("stored")).join(counted, "partition_id", "left").fillna(0, ["delivered"])
    return joined.where("stored != delivered").select("partition_id", "stored", "delivered")


@R.query("SELECT analysis_type, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s.lower()}" for s in STATUSES) + " FROM an GROUP BY analysis_type")
def agg22_status_pivot(c: Catalogue) -> DataFrame:
    """Analyses of every type by status, in one pass."""
    return dedup.pivot_counts(c.analyses, ["analysis_type"], "status", STATUSES)


@R.query("""SELECT (SELECT count(*) FROM i) AS n_items, (SELECT count(*) FROM a) AS n_artefacts, (SELECT count(*) FROM p) AS n_partitions, (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM an) AS n_analyses, (SELECT count(*) FROM b) AS n_blobs""")
def agg25_dashboard(c: Catalogue) -> DataFrame:
    """Totals of the catalogue: counts of distinct ids, one aggregate per table, gathered in one row."""
    tables = {"n_items": "catalogue_items", "n_artefacts": "artefacts", "n_partitions": "disc_partitions", "n_files": "extracted_files", "n_analyses": "analyses", "n_blobs": "upload_blobs"}
    parts = [c.raw(t).select("id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables))


@R.query("SELECT i.id AS item_id, count(a.id) AS n_artefacts, count(a.id) FILTER (WHERE a.is_private) AS n_private FROM i LEFT JOIN a ON a.item_id = i.id GROUP BY i.id")
def agg26_artefacts_per_item(c: Catalogue) -> DataFrame:
    """Artefacts of every item, zero where it has none."""
    counted = c.artefacts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_artefacts"), F.count_if("is_private").alias("n_private"))
    return c.items.select(F.col("id").alias("item_id")).join(counted, "item_id", "left").fillna(0)


@R.query("SELECT i.id AS item_id, count(x.id) AS n_children FROM i LEFT JOIN i x ON x.parent_id = i.id GROUP BY i.id")
def agg26_children_per_item(c: Catalogue) -> DataFrame:
    """Children of every item."""
    counted = c.items.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return c.items.select(F.col("id").alias("item_id")).join(counted, "item_id", "left").fillna(0)


@R.query("SELECT u.id AS user_id, count(DISTINCT a.id) AS n_artefacts, (SELECT count(*) FROM k WHERE k.user_id = u.id) AS n_keys FROM u LEFT JOIN a ON a.owner_id = u.id GROUP BY u.id")
def agg26_owned_per_user(c: Catalogue) -> DataFrame:
    """Artefacts and API keys of every user; both sides are counted before the join."""
    owned = c.artefacts.groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n_artefacts"))
    keys = c.keys.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_keys"))
    return c.users.select(F.col("id").alias("user_id")).join(owned, "user_id", "left").join(keys, "user_id", "left").fillna(0)


@R.query("SELECT coalesce(risc_os_filetype, '.' || lower(extension), '') AS facet, count(*) AS n FROM f WHERE NOT is_directory GROUP BY 1")
def agg29_filetype_facet(c: Catalogue) -> DataFrame:
    """Files by file type, else by extension."""
    files = c.files_of("risc_os_filetype", "extension", "is_directory").where("NOT is_directory")
    return files.groupBy(F.coalesce("risc_os_filetype", F.concat(F.lit("."), F.lower("extension")), F.lit("")).alias("facet")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT artefact_type, count(*) AS n FROM a WHERE parent_artefact_id IS NOT NULL GROUP BY artefact_type")
def agg30_output_types(c: Catalogue) -> DataFrame:
    """Derived artefacts by type."""
    return c.artefacts.where("parent_artefact_id IS NOT NULL").groupBy("artefact_type").agg(F.count(F.lit(1)).alias("n"))


LETTER = ", l AS (SELECT upper(substr(trim(label), 1, 1)) AS letter, count(*) AS n FROM a WHERE trim(label) <> '' GROUP BY 1)"


@R.query(LETTER + " SELECT letter, n, ((sum(n) OVER (ORDER BY letter) - n) // 25 + 1)::BIGINT AS page FROM l")
def agg32_letter_pages(c: Catalogue) -> DataFrame:
    """On which page of 25 each first letter begins."""
    return listings.letter_pages(c.artefacts, "label", 25)


@R.query("SELECT count(*) AS n_rows, count(DISTINCT md5) AS n_contents, count(DISTINCT partition_id) AS n_partitions, count(DISTINCT filename) AS n_names FROM f")
def agg33_distinct_totals(c: Catalogue) -> DataFrame:
    """Distinct contents, partitions and names of the files."""
    return listings.distinct_totals(c.files_of("md5", "partition_id", "filename"), {"n_contents": "md5", "n_partitions": "partition_id", "n_names": "filename"})


@R.query("""SELECT f.partition_id, list_sort(list(DISTINCT cat)) AS categories FROM f, unnest(CASE WHEN f.is_directory THEN [] ELSE list_filter([
 CASE WHEN lower(risc_os_filetype) IN ('fff','faf') OR lower(extension) IN ('txt','doc','htm','html','md') THEN 'text' END,
 CASE WHEN lower(risc_os_filetype) IN ('ffb','ff8','ffa','feb') OR lower(extension) IN ('bas','asm','c','exe') THEN 'program' END,
 CASE WHEN lower(risc_os_filetype) IN ('ff9','aff','c85','695','b60','ff0') OR lower(extension) IN ('bmp','gif','jpg','jpeg','png','tif') THEN 'image' END,
 CASE WHEN lower(risc_os_filetype) IN ('fb1','cb6') OR lower(extension) IN ('wav','mp3','mod','ogg') THEN 'audio' END,
 CASE WHEN lower(risc_os_filetype) IN ('ae7','af8') OR lower(extension) IN ('avi','mov','mpg','mp4','rpl') THEN 'video' END,
 CASE WHEN lower(risc_os_filetype) IN ('ddc','a91','f89','3fb','68e') OR lower(extension) IN ('zip','arc','lha','7z','tar','rar','gz') THEN 'archive' END], lambda x: x IS NOT NULL) END) AS t(cat) GROUP BY f.partition_id""")
def agg38_content_categories(c: Catalogue) -> DataFrame:
    """Content categories present in every partition."""
    files = c.files_of("partition_id", "risc_os_filetype", "extension", "is_directory").where("NOT is_directory")
    found = files.select("partition_id", F.explode(formats.categories("risc_os_filetype", "extension")).alias("category"))
    return found.groupBy("partition_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))


@R.query("SELECT storage_directory, count(*) AS n, sum(file_size)::BIGINT AS reclaimable_bytes FROM so WHERE deleted_at IS NULL AND storage_path NOT IN (SELECT storage_path FROM b WHERE storage_path IS NOT NULL) GROUP BY storage_directory")
def agg39_unreferenced_objects(c: Catalogue) -> DataFrame:
    """Stored objects that no blob names, and the bytes they hold."""
    loose = dedup.unreferenced(c.stored.where("deleted_at IS NULL"), c.blobs)
    return loose.groupBy("storage_directory").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("reclaimable_bytes"))


@R.query("SELECT DISTINCT artefact_id, analysis_type FROM an WHERE status = 'FAILED' AND artefact_id IS NOT NULL")
def agg40_requeue_targets(c: Catalogue) -> DataFrame:
    """Artefacts and analysis types that failed, once each."""
    return c.analyses.where("status = 'FAILED' AND artefact_id IS NOT NULL").select("artefact_id", "analysis_type").distinct()


@R.query("""SELECT md5 AS h, min(id) AS file_id, count(*) AS n FROM f WHERE NOT is_directory AND md5 IS NOT NULL AND md5 <> '' GROUP BY md5""")
def agg41_snapshot_database(c: Catalogue) -> DataFrame:
    """First file, by id, of every content: a reference database made of the catalogue itself."""
    files = c.files_of("md5", "is_directory").where("NOT is_directory AND md5 IS NOT NULL AND md5 != ''")
    return files.groupBy(F.col("md5").alias("h")).agg(F.min("id").alias("file_id"), F.count(F.lit(1)).alias("n"))


@R.query("""SELECT id AS blob_id, CASE WHEN file_size IS NULL OR sha256 IS NULL THEN id ELSE min(id) OVER (PARTITION BY file_size, lower(sha256)) END AS canonical_id FROM b""")
def snk04_canonical_blobs(c: Catalogue) -> DataFrame:
    """The blob that stands for the content of each upload."""
    return dedup.canonical(c.blobs)


@R.query(REFS + ", d AS (SELECT file_size, sha256 FROM g WHERE n > 1) SELECT r.artefact_id, r.blob_id, r.file_size, r.sha256 FROM r JOIN d USING (file_size, sha256)")
def pip06_duplicate_instances(c: Catalogue) -> DataFrame:
    """All artefacts whose content another artefact has."""
    rows = refs(c).where("file_size > 0 AND sha256 IS NOT NULL")
    groups = dedup.duplicate_groups(rows, ["file_size", "sha256"]).select("file_size", "sha256")
    return rows.join(groups, ["file_size", "sha256"], "left_semi").select("artefact_id", "blob_id", "file_size", "sha256")


@R.query(REFS + " SELECT file_size, sha256, n, (n - 1) * file_size AS wasted FROM g WHERE n > 1 ORDER BY wasted DESC, sha256 LIMIT 20")
def srt06_top_waste(c: Catalogue) -> DataFrame:
    """The twenty contents whose copies would take most room."""
    groups = dedup.duplicate_groups(refs(c).where("file_size > 0"), ["file_size", "sha256"])
    return groups.withColumn("wasted", (F.col("n") - 1) * F.col("file_size")).orderBy(F.desc("wasted"), "sha256").limit(20)


@R.query("SELECT storage_directory, count(*) AS n_objects, count(*) FILTER (WHERE deleted_at IS NULL) AS n_live, sum(file_size)::BIGINT AS n_bytes, (coalesce(sum(file_size) FILTER (WHERE deleted_at IS NULL), 0))::BIGINT AS live_bytes FROM so GROUP BY storage_directory")
def pip12_capacity(c: Catalogue) -> DataFrame:
    """Objects and bytes of every storage directory, in all and not deleted."""
    live = F.col("deleted_at").isNull()
    return c.stored.groupBy("storage_directory").agg(F.count(F.lit(1)).alias("n_objects"), F.count_if(live).alias("n_live"), F.sum("file_size").alias("n_bytes"), F.coalesce(F.sum(F.when(live, F.col("file_size"))), F.lit(0)).alias("live_bytes"))


@R.query("SELECT id AS blob_id FROM b WHERE file_size > 0 AND sha256 IS NOT NULL")
def flt27_dedupable(c: Catalogue) -> DataFrame:
    """Blobs whose content counts in deduplication."""
    return c.blobs.where(hashes.dedupable("file_size", "sha256")).select(F.col("id").alias("blob_id"))


@R.query("SELECT * FROM (SELECT artefact_id, analysis_type, id AS analysis_id, status FROM an WHERE artefact_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY artefact_id, analysis_type ORDER BY analysis_id DESC) = 1")
def win03_newest_per_key(c: Catalogue) -> DataFrame:
    """Newest analysis of every artefact and type."""
    rows = c.analyses.where("artefact_id IS NOT NULL").select("artefact_id", "analysis_type", F.col("id").alias("analysis_id"), "status")
    return dedup.newest(rows, ["artefact_id", "analysis_type"], [F.desc("analysis_id")])


@R.query("SELECT status, id AS analysis_id, created_at FROM an QUALIFY row_number() OVER (PARTITION BY status ORDER BY created_at DESC, id DESC) <= 5")
def win04_newest_of_each_status(c: Catalogue) -> DataFrame:
    """The five newest analyses of each status."""
    rows = c.analyses.select("status", F.col("id").alias("analysis_id"), "created_at")
    return dedup.nth_newest(rows, ["status"], [F.desc("created_at"), F.desc("analysis_id")], 5)


@R.query("SELECT id AS file_id, md5, count(*) OVER (PARTITION BY md5) AS n FROM f WHERE md5 IS NOT NULL")
def win01_copies_per_row(c: Catalogue) -> DataFrame:
    """Each file with the number of copies of its content: the counts are aggregated first and joined, so a hot content is no single window."""
    files = c.files_of("md5").where("md5 IS NOT NULL").select(F.col("id").alias("file_id"), "md5")
    return files.join(files.groupBy("md5").agg(F.count(F.lit(1)).alias("n")), "md5").select("file_id", "md5", "n")


@R.query("SELECT coalesce(md5, 'id:' || id) AS hkey, id AS file_id FROM f WHERE NOT is_directory QUALIFY row_number() OVER (PARTITION BY coalesce(md5, 'id:' || id) ORDER BY partition_id, path, id) = 1")
def win02_first_of_content(c: Catalogue) -> DataFrame:
    """The first file of every content in the canonical order; a file without a hash stands for itself."""
    files = c.files_of("md5", "partition_id", "path", "is_directory").where("NOT is_directory")
    keyed = files.select(F.coalesce("md5", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("hkey"), F.struct(F.col("partition_id").isNull().alias("x"), "partition_id", F.col("path").isNull().alias("y"), "path", "id").alias("at"))
    return keyed.groupBy("hkey").agg(F.min("at").alias("at")).select("hkey", F.col("at.id").alias("file_id"))
