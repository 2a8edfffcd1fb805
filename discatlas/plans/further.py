"""Further queries: changes to tables, products in detail, what is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import paths, text
from discatlas.operators import dedup, hierarchy, known, listings, nested, sinks
from discatlas.plans.known import KNOWN, VALID, _apps, contents, reference
from discatlas.plans.trees import DERIVED

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query(VALID + """, mo AS (SELECT dj.id, an.artefact_id, CASE json_type(j -> 'modules') WHEN 'ARRAY' THEN from_json(j -> 'modules', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'modules'] END AS arr FROM dj JOIN an ON an.id = dj.id),
me AS (SELECT id, artefact_id, k - 1 AS ordinal, arr[k] ->> 'file_path' AS path FROM mo, unnest(range(1, len(arr) + 1)) AS t(k) WHERE arr IS NOT NULL AND json_type(arr[k]) = 'OBJECT'),
af AS (SELECT p.artefact_id, f.path, count(*) AS n FROM f JOIN p ON p.id = f.partition_id WHERE f.path IS NOT NULL GROUP BY ALL)
SELECT me.id AS analysis_id, me.ordinal, coalesce(af.n, 0) AS n_files FROM me LEFT JOIN af ON af.artefact_id = me.artefact_id AND af.path = me.path""")
def joi02_module_files(c: Catalogue) -> DataFrame:
    """Files of the module's artefact and path, for every module: a composite equi-join with counts made before."""
    rows = nested.entities(nested.shred(c.analyses.select("id", "details"), "id", "details"), "modules", {"file_path": "string"}).where("parent_path = '$'")
    modules = rows.select(F.col("key").alias("id"), "ordinal", F.col("file_path").alias("path")).join(c.analyses.select("id", "artefact_id"), "id")
    held = c.files_of("partition_id", "path").where("path IS NOT NULL").join(c.partitions.select(F.col("id").alias("partition_id"), "artefact_id"), "partition_id")
    counted = held.groupBy("artefact_id", "path").agg(F.count(F.lit(1)).alias("n_files"))
    return modules.join(counted, ["artefact_id", "path"], "left").select(F.col("id").alias("analysis_id"), "ordinal", F.coalesce("n_files", F.lit(0)).alias("n_files"))


@R.query(KNOWN + " SELECT id AS known_id, product, rel_path FROM kf WHERE product ILIKE 'adfs:%' AND rel_path ILIKE '%run%' ORDER BY product, rel_path, id LIMIT 201")
def joi21_database_search(c: Catalogue) -> DataFrame:
    """First two hundred known files of a database by part of the path, and one more that shows there are others."""
    found = reference(c).where(F.col("product").ilike("adfs:%") & F.col("rel_path").ilike(text.like_search("run")))
    return found.select(F.col("id").alias("known_id"), "product", "rel_path").orderBy("product", "rel_path", "known_id").limit(201)


@R.query(", cb AS (SELECT id AS old, CASE WHEN file_size IS NULL OR sha256 IS NULL THEN id ELSE min(id) OVER (PARTITION BY file_size, lower(sha256)) END AS new FROM b) SELECT a.id AS artefact_id, coalesce(cb.new, a.upload_blob_id) AS upload_blob_id, coalesce(cb.new <> cb.old, false) AS changed FROM a LEFT JOIN cb ON cb.old = a.upload_blob_id")
def snk05_blobs_reassigned(c: Catalogue) -> DataFrame:
    """Artefacts referring to the blob that stands for their content."""
    mapping = dedup.canonical(c.blobs).select(F.col("blob_id").alias("old"), F.col("canonical_id").alias("new"))
    return sinks.reassign(c.artefacts.select(F.col("id").alias("artefact_id"), "upload_blob_id"), "upload_blob_id", mapping).select("artefact_id", "upload_blob_id", "changed")


@R.query(KNOWN + ", l AS (SELECT f.id AS file_id, min(kf.id) AS known_id FROM f JOIN kf ON kf.md5 = f.md5 AND (kf.size IS NULL OR f.file_size IS NULL OR kf.size = f.file_size) WHERE NOT f.is_directory GROUP BY f.id) SELECT l.file_id FROM l JOIN kf ON kf.id = l.known_id WHERE kf.product LIKE 'FAT12:%'")
def snk08_links_of_a_database(c: Catalogue) -> DataFrame:
    """Files whose link goes when the database of a file system is dropped."""
    ref = reference(c)
    links = known.link(contents(c).select(F.col("id").alias("file_id"), "md5", F.col("file_size").alias("size")), ref)
    doomed = ref.where("product LIKE 'FAT12:%'").select(F.col("id").alias("known_id"))
    return links.join(doomed, "known_id", "left_semi").select("file_id")


@R.query(" SELECT m.id, m.parent_file_id, CASE WHEN starts_with(m.path, o.path || '/') THEN m.path ELSE o.path || '/' || m.path END AS full_path FROM f m JOIN f o ON o.id = m.parent_file_id")
def snk11_nested_paths(c: Catalogue) -> DataFrame:
    """Path of archive members below their archive."""
    return sinks.nested_paths(c.files_of("path", "parent_file_id").select("id", "path", "parent_file_id"))


@R.query()
def snk12_item_json(c: Catalogue) -> DataFrame:
    """Every item with its artefacts as JSON text."""
    items = c.items.select(F.col("id").alias("item_id"), "name", "platform")
    return sinks.children_json(items, c.artefacts.where("item_id IS NOT NULL").select("item_id", "id", "label", "artefact_type"), "item_id", "item_id", "artefacts")


@R.query(KNOWN + " SELECT f.id AS file_id FROM f WHERE NOT f.is_directory AND f.md5 IS NOT NULL AND f.md5 NOT IN (SELECT md5 FROM kf)")
def lnk02_unlinked_files(c: Catalogue) -> DataFrame:
    """Files whose content no reference database knows."""
    return contents(c).select(F.col("id").alias("file_id"), "md5").join(reference(c).select("md5"), "md5", "left_anti").select("file_id")


@R.query(KNOWN + " SELECT product, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE NOT required) AS n_optional, CASE WHEN count(*) FILTER (WHERE required) = 0 THEN 'no required file' END AS reason FROM kf GROUP BY product")
def fun24_classified_products(c: Catalogue) -> DataFrame:
    """Which products can be recognised, and why others can't."""
    return known.classify(reference(c))


@R.query(KNOWN + " SELECT kf.product, kf.rel_path, kf.required, count(f.id) AS n_matches FROM kf LEFT JOIN f ON f.md5 = kf.md5 AND NOT f.is_directory GROUP BY ALL")
def hdb02_product_details(c: Catalogue) -> DataFrame:
    """Files of every product with the number of files of equal content."""
    counted = contents(c).groupBy("md5").agg(F.count(F.lit(1)).alias("n_matches"))
    return reference(c).join(counted, "md5", "left").select("product", "rel_path", "required", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@R.query(KNOWN + " SELECT a.item_id, count(DISTINCT (rel.partition_id, rel.app)) AS n_apps, count(DISTINCT rel.product) AS n_products FROM rel JOIN p ON p.id = rel.partition_id JOIN a ON a.id = p.artefact_id WHERE a.item_id IS NOT NULL GROUP BY a.item_id")
def gen04_apps_of_items(c: Catalogue) -> DataFrame:
    """Applications and products in every item."""
    apps = _apps(c).select("partition_id", "app", "product").distinct()
    place = c.partitions.select(F.col("id").alias("partition_id"), "artefact_id").join(c.artefacts.where("item_id IS NOT NULL").select(F.col("id").alias("artefact_id"), "item_id"), "artefact_id")
    return apps.join(place, "partition_id").groupBy("item_id").agg(F.count_distinct("partition_id", "app").alias("n_apps"), F.count_distinct("product").alias("n_products"))


@R.query(KNOWN + r" SELECT partition_id, app, bool_or(rel_path = '!Run') AS has_run, bool_or(rel_path = '!RunImage') AS has_image, bool_or(rel_path IN ('!Sprites', '!Sprites22')) AS has_sprites FROM rel GROUP BY ALL")
def gen05_boot_files(c: Catalogue) -> DataFrame:
    """Which of its boot files every application has."""
    names = F.col("rel_path")
    return _apps(c).groupBy("partition_id", "app").agg(F.bool_or(names == "!Run").alias("has_run"), F.bool_or(names == "!RunImage").alias("has_image"), F.bool_or(names.isin("!Sprites", "!Sprites22")).alias("has_sprites"))


@R.query(" SELECT id AS file_id, CASE WHEN is_directory THEN path ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS browse_path FROM f WHERE path IS NOT NULL")
def fun37_browse_paths(c: Catalogue) -> DataFrame:
    """Folder in which a file is shown; a folder shows itself."""
    files = c.files_of("path", "is_directory").where("path IS NOT NULL")
    return files.select(F.col("id").alias("file_id"), F.when(F.col("is_directory"), F.col("path")).otherwise(paths.parent("path")).alias("browse_path"))


@R.query(r" SELECT id AS artefact_id, CASE WHEN regexp_matches(label, '^\s*[\[(]') THEN label ELSE trim(regexp_replace(label, '(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]))+\s*$', '')) END AS bare FROM a WHERE label IS NOT NULL")
def fun21_bare_labels(c: Catalogue) -> DataFrame:
    """Labels without bracketed remarks at the end."""
    return c.artefacts.where("label IS NOT NULL").select(F.col("id").alias("artefact_id"), text.strip_brackets("label").alias("bare"))


@R.query(r""" SELECT object_id, regexp_matches(storage_path, '^[^\x00-\x1f\\]+$') AND NOT regexp_matches(storage_path, '(?:^|/)(?:\.{0,2})(?:/|$)') AS valid, CASE lower(regexp_extract(storage_path, '\.([A-Za-z0-9]+)$', 1)) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MIME.items()) + " ELSE 'application/octet-stream' END AS mime FROM so WHERE storage_path IS NOT NULL")
def fun42_storage_keys_checked(c: Catalogue) -> DataFrame:
    """Whether every key of the store is safe, and its media type."""
    return c.stored.where("storage_path IS NOT NULL").select("object_id", text.valid_key("storage_path").alias("valid"), text.mime_type("storage_path").alias("mime"))


@R.query(r""", im AS (SELECT DISTINCT partition_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '')) AS base FROM f WHERE NOT is_directory AND path IS NOT NULL),
sc AS (SELECT partition_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM f WHERE NOT is_directory AND path IS NOT NULL)
SELECT im.partition_id, im.path AS image, sc.path AS sidecar FROM im JOIN sc USING (partition_id, folder) WHERE im.path <> sc.path AND starts_with(sc.name, im.base)""")
def imp02_sidecars(c: Catalogue) -> DataFrame:
    """Files beside a file whose name begins with the other's."""
    files = c.files_of("partition_id", "path", "is_directory").where("NOT is_directory AND path IS NOT NULL")
    base = F.lower(F.regexp_replace(paths.basename("path"), r"\.[A-Za-z0-9]+$", ""))
    images = files.select("partition_id", F.col("path").alias("image"), paths.parent("path").alias("folder"), base.alias("base")).distinct()
    others = files.select("partition_id", F.col("path").alias("sidecar"), paths.parent("path").alias("folder"), F.lower(paths.basename("path")).alias("name"))
    return images.join(others, ["partition_id", "folder"]).where("image != sidecar AND startswith(name, base)").select("partition_id", "image", "sidecar")


@R.query(" SELECT partition_id, path FROM f WHERE is_directory AND path IS NOT NULL ORDER BY partition_id, path, id LIMIT 200000")
def srt10_capped_tree(c: Catalogue) -> DataFrame:
    """Directories in order, at most 200,000."""
    files = c.files_of("partition_id", "path", "is_directory").where("is_directory AND path IS NOT NULL")
    return files.orderBy(F.col("partition_id").asc_nulls_last(), "path", "id").limit(200_000).select("partition_id", "path")


@R.query(DERIVED + """, tf AS (SELECT t.root AS root_id, f.id AS file_id, f.partition_id, f.path, f.is_directory FROM f JOIN p ON p.id = f.partition_id JOIN top t ON t.node = p.artefact_id WHERE f.path IS NOT NULL AND f.is_directory IS NOT NULL),
tn AS (SELECT *, row_number() OVER (PARTITION BY root_id, is_directory ORDER BY partition_id, path, file_id) AS nth, count(*) OVER (PARTITION BY root_id, is_directory) AS n FROM tf)
SELECT root_id, partition_id, file_id, path, is_directory, max(n) OVER (PARTITION BY root_id) > 200000 AS is_truncated FROM tn QUALIFY nth <= 200000""")
def srt10_tree_paths(c: Catalogue) -> DataFrame:
    """Files and directories of every derivation tree, each at most 200,000 a tree, and whether the tree has more."""
    tops = hierarchy.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("root_id"))
    place = c.partitions.select(F.col("id").alias("partition_id"), "artefact_id").join(tops, "artefact_id").select("partition_id", "root_id")
    files = c.files_of("partition_id", "path", "is_directory").where("path IS NOT NULL AND is_directory IS NOT NULL")
    rows = files.join(place, "partition_id").select("root_id", "partition_id", F.col("id").alias("file_id"), "path", "is_directory")
    return listings.capped_trees(rows, "root_id", "is_directory", [F.col("partition_id").asc(), F.col("path").asc(), F.col("file_id").asc()])


@R.query(DERIVED + " SELECT an.id AS analysis_id FROM an JOIN top t ON t.node = an.artefact_id JOIN a r ON r.id = t.root WHERE an.status = 'PENDING' AND r.is_private")
def rec15_pending_under_private(c: Catalogue) -> DataFrame:
    """Pending analyses in the derivation trees of private artefacts."""
    tops = hierarchy.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("id"))
    inside = tops.join(c.artefacts.where("is_private").select("id"), "id", "left_semi").select("artefact_id")
    return c.analyses.where("status = 'PENDING'").join(inside, "artefact_id", "left_semi").select(F.col("id").alias("analysis_id"))


@R.query(VALID + """, ou AS (SELECT id, CASE json_type(j -> 'outputs') WHEN 'ARRAY' THEN from_json(j -> 'outputs', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'outputs'] END AS arr FROM dj), oe AS (SELECT id, arr[k] AS e FROM ou, unnest(range(1, len(arr) + 1)) AS t(k) WHERE arr IS NOT NULL)
SELECT e ->> 'filename' AS filename, min(id) AS analysis_id, count(*) AS n FROM oe WHERE json_type(e) = 'OBJECT' AND json_type(e -> 'filename') NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY 1""")
def trc01_canonical_outputs(c: Catalogue) -> DataFrame:
    """First analysis that made each output, and how many did."""
    rows = nested.entities(nested.shred(c.analyses.select("id", "details"), "id", "details"), "outputs", {"filename": "string"}).where("parent_path = '$' AND filename IS NOT NULL")
    return rows.groupBy("filename").agg(F.min("key").alias("analysis_id"), F.count(F.lit(1)).alias("n"))


@R.query(" SELECT artefact_id, min(id) AS partition_id, count(*) AS n FROM p WHERE artefact_id IS NOT NULL GROUP BY artefact_id")
def str11_first_partitions(c: Catalogue) -> DataFrame:
    """First partition of every artefact and how many there are."""
    return c.partitions.where("artefact_id IS NOT NULL").groupBy("artefact_id").agg(F.min("id").alias("partition_id"), F.count(F.lit(1)).alias("n"))


@R.query(" SELECT id AS analysis_id, artefact_id FROM an WHERE status = 'PENDING' AND coalesce(artefact_id, -1) NOT IN (SELECT artefact_id FROM an WHERE status = 'RUNNING' AND artefact_id IS NOT NULL)")
def str01_not_blocked(c: Catalogue) -> DataFrame:
    """Pending analyses of artefacts on which nothing runs."""
    busy = c.analyses.where("status = 'RUNNING' AND artefact_id IS NOT NULL").select("artefact_id")
    return c.analyses.where("status = 'PENDING'").select(F.col("id").alias("analysis_id"), "artefact_id").join(busy, "artefact_id", "left_anti").select("analysis_id", "artefact_id")


@R.query(" SELECT date_trunc('month', created_at)::DATE AS month, tool_name, count(*) AS n, count(*) FILTER (WHERE success) AS n_success, sum(epoch_us(completed_at) - epoch_us(started_at))::BIGINT AS busy_us FROM an GROUP BY ALL")
def ana02_work_by_month(c: Catalogue) -> DataFrame:
    """Analyses, successes and time spent by month and tool."""
    us = [F.unix_micros(F.col(t).cast("timestamp")) for t in ("completed_at", "started_at")]
    return c.analyses.groupBy(F.trunc("created_at", "month").alias("month"), "tool_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.sum(us[0] - us[1]).alias("busy_us"))
