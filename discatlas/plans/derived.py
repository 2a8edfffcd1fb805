"""Further queries: reports, composite joins, indexes of analyses, functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import formats, paths, text
from discatlas.operators import dedup, hierarchy, nested, sinks
from discatlas.operators import similarity as sim
from discatlas.plans import known as known_plans
from discatlas.plans import similarity as similarity_plans
from discatlas.plans.known import KNOWN, VALID, _apps
from discatlas.plans.similarity import PAIRS, SETS
from discatlas.plans.trees import DERIVED, UP

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query(" SELECT f.id AS file_id, f.partition_id, f.path FROM f JOIN p ON p.id = f.partition_id WHERE p.filesystem IN ('ADFS', 'HFS')")
def src02_scan_of_partitions(c: Catalogue) -> DataFrame:
    """Files of the partitions of two file systems: a semi-join instead of chunks of ids."""
    wanted = c.partitions.where(F.col("filesystem").isin("ADFS", "HFS")).select(F.col("id").alias("partition_id"))
    return c.files_of("partition_id", "path").join(wanted, "partition_id", "left_semi").select(F.col("id").alias("file_id"), "partition_id", "path")


@R.query(r""" SELECT id AS file_id, modified_time FROM f WHERE regexp_full_match(modified_time, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00') AND left(modified_time, 19)::TIMESTAMP >= TIMESTAMP '1975-01-01' AND left(modified_time, 19)::TIMESTAMP <= loaded_at + INTERVAL 60 SECONDS""")
def flt29_plausible_times(c: Catalogue) -> DataFrame:
    """Files whose canonical time is neither before 1975 nor after their arrival."""
    from discatlas.operators.instants import CANONICAL

    files = c.files_of("modified_time").where(F.col("modified_time").rlike(CANONICAL))
    at = F.try_to_timestamp(F.substring("modified_time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return files.where((at >= F.lit("1975-01-01").cast("timestamp_ntz")) & (at <= F.col("loaded_at") + F.make_dt_interval(secs=F.lit(60)))).select(F.col("id").alias("file_id"), "modified_time")


@R.query(" SELECT i.id AS item_id FROM i WHERE i.name ILIKE '%set%' AND EXISTS (SELECT 1 FROM a WHERE a.item_id = i.id AND a.artefact_type = 'FLUX')")
def flt24_item_filters(c: Catalogue) -> DataFrame:
    """Items by part of the name that hold a flux image."""
    flux = c.artefacts.where("artefact_type = 'FLUX'").select("item_id")
    return c.items.where(F.col("name").ilike(text.like_search("set"))).select(F.col("id").alias("item_id")).join(flux, "item_id", "left_semi")


@R.query(KNOWN + " SELECT r.partition_id, r.app, kf.product, count(*) AS n_files FROM rel r JOIN kf ON kf.product = r.product AND lower(kf.rel_path) = lower(r.rel_path) AND kf.md5 = r.md5 GROUP BY ALL")
def joi09_path_aware_matches(c: Catalogue) -> DataFrame:
    """Files of every application that its product knows at the same relative path."""
    ref = known_plans.reference(c).select("product", F.lower("rel_path").alias("rel"), "md5")
    return _apps(c).select("partition_id", "app", "product", F.lower("rel_path").alias("rel"), "md5").join(ref, ["product", "rel", "md5"]).groupBy("partition_id", "app", "product").agg(F.count(F.lit(1)).alias("n_files"))


@R.query(PAIRS + ", d AS (SELECT id FROM p WHERE filesystem = 'HFS') SELECT DISTINCT o AS owner FROM (SELECT b AS o FROM c WHERE a IN (SELECT id FROM d) UNION ALL SELECT a FROM c WHERE b IN (SELECT id FROM d))")
def joi11_candidates_of_some(c: Catalogue) -> DataFrame:
    """Partitions that share rare content with those of one file system."""
    some = c.partitions.where("filesystem = 'HFS'").select(F.col("id").alias("owner"))
    pairs = sim.both_directions(sim.candidates(similarity_plans.content(c)))
    return pairs.join(some, "owner", "left_semi").select(F.col("other").alias("owner")).distinct()


@R.query(" SELECT b.id AS blob_id FROM b WHERE b.id IN (SELECT upload_blob_id FROM a WHERE is_private) AND b.id IN (SELECT upload_blob_id FROM a WHERE NOT is_private)")
def joi22_blobs_held_both_ways(c: Catalogue) -> DataFrame:
    """Blobs to which private and public artefacts refer."""
    held = c.artefacts.where("upload_blob_id IS NOT NULL").groupBy(F.col("upload_blob_id").alias("id")).agg(F.bool_or("is_private").alias("private"), F.bool_or(~F.col("is_private")).alias("public"))
    return c.blobs.select("id").join(held.where("private AND public"), "id", "left_semi").select(F.col("id").alias("blob_id"))


@R.query(KNOWN + " SELECT f.partition_id, string_agg(DISTINCT kf.product, ', ' ORDER BY kf.product) AS reason FROM f JOIN kf ON kf.md5 = f.md5 WHERE kf.product LIKE 'ISO9660:%' AND NOT f.is_directory AND f.partition_id IS NOT NULL GROUP BY f.partition_id")
def joi24_reasons(c: Catalogue) -> DataFrame:
    """Products of a flagged database that each partition holds a file of, in order."""
    flagged = known_plans.reference(c).where("product LIKE 'ISO9660:%'").select("md5", "product").distinct()
    files = known_plans.contents(c).where("partition_id IS NOT NULL").select("partition_id", "md5").distinct()
    names = files.join(flagged, "md5").select("partition_id", "product").distinct()
    return names.groupBy("partition_id").agg(F.array_join(F.sort_array(F.collect_list("product")), ", ").alias("reason"))


@R.query(" SELECT split_part(storage_path, '/', 1) AS shelf, count(DISTINCT b.id) AS n_blobs, count(DISTINCT a.id) AS n_artefacts FROM b LEFT JOIN a ON a.upload_blob_id = b.id WHERE storage_path IS NOT NULL GROUP BY 1")
def joi25_owners_by_shelf(c: Catalogue) -> DataFrame:
    """Blobs and owning artefacts by the first part of the storage path."""
    held = c.artefacts.where("upload_blob_id IS NOT NULL").groupBy(F.col("upload_blob_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    shelved = c.blobs.where("storage_path IS NOT NULL").select("id", F.split_part("storage_path", F.lit("/"), F.lit(1)).alias("shelf"))
    return shelved.join(held, "id", "left").groupBy("shelf").agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_artefacts"))


@R.query(PAIRS + """ SELECT 'owners' AS metric, count(DISTINCT owner)::DOUBLE AS value FROM s UNION ALL SELECT 'contents', count(DISTINCT h) FROM s UNION ALL SELECT 'candidate_pairs', count(*) FROM c
UNION ALL SELECT 'similar_pairs', count(*) FROM pr UNION ALL SELECT 'best_score', round(max(score), 6) FROM pr UNION ALL SELECT 'over_cap', count(*) FROM df WHERE df > 50""")
def agg14_evaluation_report(c: Catalogue) -> DataFrame:
    """Key figures of the similarity index as (metric, value)."""
    sets = similarity_plans.content(c)
    pairs = sim.candidates(sets)
    found = sim.score_pairs(pairs, sets).where(F.col("score") >= sim.FLOOR)
    n = F.count(F.lit(1)).cast("double")
    parts = {
        "owners": sets.agg(F.count_distinct("owner").cast("double")), "contents": sets.agg(F.count_distinct("h").cast("double")), "candidate_pairs": pairs.agg(n),
        "similar_pairs": found.agg(n), "best_score": found.agg(F.round(F.max("score"), 6)), "over_cap": sim.document_frequency(sets).where(F.col("df") > sim.CAP).agg(n),
    }
    out = None
    for name, part in parts.items():
        row = part.toDF("value").select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


NEWEST = VALID + """, nw AS (SELECT id FROM an WHERE analysis_type = 'DISC_PROTECTION_DETECT' AND artefact_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY artefact_id ORDER BY id DESC) = 1),
ia AS (SELECT an.artefact_id, CASE json_type(j -> 'indicators') WHEN 'ARRAY' THEN from_json(j -> 'indicators', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'indicators'] END AS arr FROM dj JOIN an ON an.id = dj.id WHERE dj.id IN (SELECT id FROM nw)),
ie AS (SELECT artefact_id, unnest(arr) AS e FROM ia WHERE arr IS NOT NULL)"""


@R.query(NEWEST + " SELECT e ->> 'type' AS type, count(*) AS n, count(DISTINCT artefact_id) AS n_artefacts FROM ie WHERE json_type(e) = 'OBJECT' AND json_type(e -> 'type') = 'VARCHAR' GROUP BY 1")
def agg31_protection_rollup(c: Catalogue) -> DataFrame:
    """Indicators by type in the newest protection analysis of every artefact."""
    rows = c.analyses.where("analysis_type = 'DISC_PROTECTION_DETECT' AND artefact_id IS NOT NULL").select("id", "artefact_id", "details")
    newest = dedup.newest(rows, ["artefact_id"], [F.desc("id")])
    found = nested.entities(nested.shred(newest, "artefact_id", "details"), "indicators", {"type": "string"}).where("parent_path = '$' AND type IS NOT NULL")
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_artefacts"))


@R.query(" SELECT md5(text) AS content, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def win06_first_document_of_text(c: Catalogue) -> DataFrame:
    """First document of every text with the number of copies; texts are compared by their digest."""
    return c.documents.where("text IS NOT NULL").groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@R.query(" SELECT id AS file_id, file_size FROM f WHERE NOT is_directory ORDER BY file_size DESC NULLS LAST, id LIMIT 100")
def srt03_largest_first(c: Catalogue) -> DataFrame:
    """Hundred largest files, sizes that are unknown last."""
    from discatlas.operators import listings

    files = c.files_of("file_size", "is_directory").where("NOT is_directory")
    return files.orderBy(*listings.sort_columns("size", True, {"size": "file_size", "id": "id"}, "id")).limit(100).select(F.col("id").alias("file_id"), "file_size")


@R.query(" SELECT owner_id AS user_id, id AS item_id, 'item' AS via FROM i WHERE owner_id IS NOT NULL UNION ALL SELECT DISTINCT owner_id, item_id, 'artefact' FROM a WHERE owner_id IS NOT NULL AND item_id IS NOT NULL")
def set01_ways_of_access(c: Catalogue) -> DataFrame:
    """Users and items they reach by owning the item or an artefact of it."""
    own = c.items.where("owner_id IS NOT NULL").select(F.col("owner_id").alias("user_id"), F.col("id").alias("item_id"), F.lit("item").alias("via"))
    held = c.artefacts.where("owner_id IS NOT NULL AND item_id IS NOT NULL").select(F.col("owner_id").alias("user_id"), "item_id", F.lit("artefact").alias("via")).distinct()
    return own.unionByName(held)


@R.query(" SELECT id AS blob_id FROM b WHERE md5 IN (SELECT md5 FROM b GROUP BY md5 HAVING count(*) > 1) INTERSECT SELECT id FROM b WHERE lower(sha256) IN (SELECT lower(sha256) FROM b GROUP BY 1 HAVING count(*) > 1)")
def set03_hashes_in_both(c: Catalogue) -> DataFrame:
    """Blobs that share their md5 with others and their sha256 with others: two pools of ids, intersected."""

    def pool(h: Column) -> DataFrame:
        rows = c.blobs.select(F.col("id").alias("blob_id"), h.alias("h")).where("h IS NOT NULL")
        return rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h", "left_semi").select("blob_id")

    return pool(F.col("md5")).intersect(pool(F.lower("sha256")))


@R.query(UP + " SELECT DISTINCT i.owner_id AS user_id, s.node AS item_id FROM self s JOIN i ON i.id = s.ancestor WHERE i.owner_id IS NOT NULL")
def rec04_access_to_descendants(c: Catalogue) -> DataFrame:
    """Items each user reaches: those they own and all below."""
    below = hierarchy.closure(c.items, itself=True)
    return below.join(c.items.where("owner_id IS NOT NULL").select(F.col("id").alias("ancestor"), F.col("owner_id").alias("user_id")), "ancestor").select("user_id", F.col("node").alias("item_id")).distinct()


@R.query(UP + ", tp AS (SELECT node, ancestor AS root FROM self WHERE ancestor IN (SELECT id FROM i WHERE parent_id IS NULL)) SELECT tp.root AS root_id, count(DISTINCT tp.node) AS n_items, count(a.id) AS n_artefacts FROM tp LEFT JOIN a ON a.item_id = tp.node GROUP BY tp.root")
def rec09_totals_of_roots(c: Catalogue) -> DataFrame:
    """Items and artefacts under every root item; artefacts are counted per item before the join."""
    tops = hierarchy.roots(c.items).select("node", F.col("root").alias("root_id"))
    counted = c.artefacts.groupBy(F.col("item_id").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return tops.join(counted, "node", "left").groupBy("root_id").agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_artefacts"))


@R.query(DERIVED + " SELECT t.root AS root_id, t.node AS artefact_id, t.distance AS depth, a.label, a.artefact_type, count(an.id) AS n_analyses FROM top t JOIN a ON a.id = t.node LEFT JOIN an ON an.artefact_id = t.node GROUP BY ALL")
def rec13_processing_tree(c: Catalogue) -> DataFrame:
    """Artefacts of every derivation tree with depth and number of analyses."""
    tops = hierarchy.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("root_id"), "depth")
    counted = c.analyses.groupBy("artefact_id").agg(F.count(F.lit(1)).alias("n_analyses"))
    named = c.artefacts.select(F.col("id").alias("artefact_id"), "label", "artefact_type")
    return tops.join(named, "artefact_id").join(counted, "artefact_id", "left").fillna(0, ["n_analyses"]).select("root_id", "artefact_id", "depth", "label", "artefact_type", "n_analyses")


@R.query(DERIVED + " SELECT t.root AS root_id, count(an.id) AS total, count(an.id) FILTER (WHERE an.status = 'FAILED') AS failed FROM top t JOIN an ON an.artefact_id = t.node GROUP BY t.root")
def ana05_failures_of_trees(c: Catalogue) -> DataFrame:
    """Analyses and failures under each root artefact."""
    tops = hierarchy.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("root_id"))
    return c.analyses.select("artefact_id", "status").join(tops, "artefact_id").groupBy("root_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@R.query(" SELECT id AS file_id, translate(filename, '#$^&%@?/.', '?<>+;=#./') AS dos_name FROM f WHERE filename IS NOT NULL")
def fun10_dos_names(c: Catalogue) -> DataFrame:
    """File names as a DOS file system writes them."""
    return c.files_of("filename").where("filename IS NOT NULL").select(F.col("id").alias("file_id"), paths.translate_name("filename").alias("dos_name"))


@R.query("SELECT id AS file_id, CASE lower(extension) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in formats.MEDIA.items()) + " END AS kind, coalesce(lower(extension) IN (" + ", ".join(f"'{x}'" for x in formats.PLAYABLE) + "), false) AS playable FROM f WHERE extension IS NOT NULL")
def fun15_media_kinds(c: Catalogue) -> DataFrame:
    """Kind of medium of every file with an extension."""
    return c.files_of("extension").where("extension IS NOT NULL").select(F.col("id").alias("file_id"), formats.media_kind("extension").alias("kind"), formats.is_playable("extension").alias("playable"))


@R.query(r""", x AS (SELECT id, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM f WHERE path IS NOT NULL), y AS (SELECT id, parts, regexp_replace(parts[-1], '\.[A-Za-z0-9]{1,4}$', '') AS base FROM x WHERE len(parts) > 0)
SELECT id AS file_id, CASE WHEN len(parts) > 1 AND regexp_matches(base, '(?i)^(?:(?:disc|disk|cd|side)\s*)?[0-9]+$') THEN parts[-2] || ' ' || base ELSE base END AS label FROM y""")
def fun22_labels_of_paths(c: Catalogue) -> DataFrame:
    """Label of every path."""
    return c.files_of("path").where("path IS NOT NULL").select(F.col("id").alias("file_id"), text.path_label("path").alias("label")).where("label IS NOT NULL")


@R.query(VALID + " SELECT id AS analysis_id, j ->> '$.path_prefix' AS path_prefix FROM dj WHERE json_type(j) = 'OBJECT' AND json_type(j -> 'path_prefix') = 'VARCHAR'")
def fun29_path_hints(c: Catalogue) -> DataFrame:
    """Path prefix named in an analysis."""
    adjacency = nested.shred(c.analyses.select("id", "details"), "id", "details")
    return adjacency.where("parent = 0 AND label = 'path_prefix' AND kind = 'string' AND ordinal IS NULL").select(F.col("key").alias("analysis_id"), F.col("scalar").alias("path_prefix"))


@R.query(VALID + """, fc AS (SELECT id, CASE json_type(j -> 'failed_conversions') WHEN 'ARRAY' THEN from_json(j -> 'failed_conversions', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'failed_conversions'] END AS arr FROM dj) SELECT id AS analysis_id, k - 1 AS ordinal, arr[k] ->> 'filename' AS filename FROM fc, unnest(range(1, len(arr) + 1)) AS t(k) WHERE arr IS NOT NULL AND json_type(arr[k]) = 'OBJECT'""")
def fun30_failed_conversions(c: Catalogue) -> DataFrame:
    """Conversions that failed."""
    adjacency = nested.shred(c.analyses.select("id", "details"), "id", "details")
    return nested.entities(adjacency, "failed_conversions", {"filename": "string"}).where("parent_path = '$'").select(F.col("key").alias("analysis_id"), "ordinal", "filename")


@R.query(VALID + """, ok AS (SELECT an.id, an.artefact_id, dj.j FROM an JOIN dj ON dj.id = an.id WHERE an.status = 'COMPLETED' AND an.success AND an.artefact_id IS NOT NULL),
lists AS (SELECT id, artefact_id, label, CASE json_type(j -> label) WHEN 'ARRAY' THEN from_json(j -> label, '["JSON"]') WHEN 'OBJECT' THEN [j -> label] END AS arr FROM ok, (VALUES ('outputs'), ('failed_conversions')) AS t(label)),
el AS (SELECT id, artefact_id, label, k - 1 AS ordinal, arr[k] AS e FROM lists, unnest(range(1, len(arr) + 1)) AS t(k) WHERE arr IS NOT NULL AND json_type(arr[k]) = 'OBJECT'),
nm AS (SELECT *, CASE label WHEN 'outputs' THEN CASE WHEN json_type(e -> 'filename') NOT IN ('OBJECT', 'ARRAY') THEN e ->> 'filename' END WHEN 'failed_conversions' THEN CASE WHEN json_type(e -> 'source') NOT IN ('OBJECT', 'ARRAY') THEN e ->> 'source' END END AS source FROM el),
bad AS (SELECT * FROM nm WHERE label = 'failed_conversions' AND source <> '' QUALIFY row_number() OVER (PARTITION BY artefact_id, source ORDER BY id, ordinal) = 1),
good AS (SELECT DISTINCT artefact_id, source FROM nm WHERE label = 'outputs' AND source <> '')
SELECT coalesce(bad.artefact_id, good.artefact_id) AS artefact_id, coalesce(bad.source, good.source) AS source, good.source IS NOT NULL AS converted, bad.id AS analysis_id, TRY_CAST(bad.e ->> '$.error.code' AS INTEGER) AS error_code, bad.e ->> '$.error.text' AS error_text
FROM bad FULL JOIN good ON good.artefact_id = bad.artefact_id AND good.source = bad.source""")
def fun30_conversion_status(c: Catalogue) -> DataFrame:
    """For every artefact and source whether it was converted, and the first failure with its error; of completed analyses that succeeded."""
    done = c.analyses.where("status = 'COMPLETED' AND success AND artefact_id IS NOT NULL").select(F.col("id").alias("key"), "artefact_id")
    texts = c.analyses.select("id", "details")

    def elements(label: str, name: str, fields: dict[str, str]) -> DataFrame:
        found = nested.flat(texts, "id", "details", label, {name: "string", **fields}).where(F.col("node_path") == F.concat(F.lit(f"$.{label}["), "ordinal", F.lit("]")))
        return found.withColumnRenamed(name, "source").where("source != ''").join(done, "key")

    return conversion_status(elements("outputs", "filename", {}), elements("failed_conversions", "source", {"error.code": "int", "error.text": "string"}))


def conversion_status(outputs: DataFrame, failures: DataFrame) -> DataFrame:
    """Sources with outputs (artefact_id, source) and failures (also key, ordinal, error_code, error_text) as one row per artefact and source."""
    first = failures.groupBy("artefact_id", "source").agg(F.min(F.struct("key", "ordinal", "error_code", "error_text")).alias("first"))
    converted = outputs.select("artefact_id", "source", F.lit(True).alias("made")).distinct()
    both = first.join(converted, ["artefact_id", "source"], "full")
    return both.select("artefact_id", "source", F.coalesce("made", F.lit(False)).alias("converted"), F.col("first.key").alias("analysis_id"), F.col("first.error_code").alias("error_code"), F.col("first.error_text").alias("error_text"))


@R.query(r""" SELECT b.id AS blob_id, left(lower(b.sha256), 2) || '/' || substr(lower(b.sha256), 3, 2) || '/' || lower(b.sha256) || coalesce('-' || nullif(regexp_replace(regexp_extract(b.storage_path, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), ''), '') AS key FROM b WHERE regexp_full_match(lower(b.sha256), '[0-9a-f]{64}')""")
def fun31_storage_keys(c: Catalogue) -> DataFrame:
    """Content-addressed key of every blob."""
    return c.blobs.select(F.col("id").alias("blob_id"), text.storage_key("sha256", paths.basename("storage_path")).alias("key")).where("key IS NOT NULL")


@R.query(" SELECT k.id AS key_id, CASE k.permission WHEN 'READ_ONLY' THEN 0 WHEN 'READ_UPLOAD' THEN 1 WHEN 'READ_WRITE' THEN 2 WHEN 'STAFF' THEN 3 END AS rank FROM k WHERE k.permission IS NOT NULL")
def fun39_permission_ranks(c: Catalogue) -> DataFrame:
    """Rank of every key's permission."""
    rank = F.array_position(F.array(*(F.lit(p) for p in ("READ_ONLY", "READ_UPLOAD", "READ_WRITE", "STAFF"))), F.col("permission")) - 1
    return c.keys.where("permission IS NOT NULL").select(F.col("id").alias("key_id"), F.when(rank >= 0, rank).alias("rank"))


@R.query(VALID + """, mv AS (SELECT id, CASE json_type(j -> 'movies') WHEN 'ARRAY' THEN from_json(j -> 'movies', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'movies'] END AS arr FROM dj), mm AS (SELECT unnest(arr) AS m FROM mv WHERE arr IS NOT NULL)
SELECT CASE WHEN json_type(m -> 'width') IN ('OBJECT', 'ARRAY') THEN NULL ELSE TRY_CAST(m ->> 'width' AS BIGINT) END AS width, count(*) AS n FROM mm WHERE json_type(m) = 'OBJECT' GROUP BY 1""")
def flt12_movies_by_width(c: Catalogue) -> DataFrame:
    """Movies by width of the picture."""
    adjacency = nested.shred(c.analyses.select("id", "details"), "id", "details")
    return nested.entities(adjacency, "movies", {"width": "long"}).where("parent_path = '$'").groupBy("width").agg(F.count(F.lit(1)).alias("n"))


@R.query(VALID + """, mo AS (SELECT id, CASE json_type(j -> 'modules') WHEN 'ARRAY' THEN from_json(j -> 'modules', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'modules'] END AS arr FROM dj), me AS (SELECT id, k - 1 AS ordinal, arr[k] AS m FROM mo, unnest(range(1, len(arr) + 1)) AS t(k) WHERE arr IS NOT NULL),
co AS (SELECT id, ordinal, CASE json_type(m -> 'commands') WHEN 'ARRAY' THEN from_json(m -> 'commands', '["JSON"]') WHEN 'OBJECT' THEN [m -> 'commands'] END AS arr FROM me WHERE json_type(m) = 'OBJECT'), ce AS (SELECT id, ordinal, unnest(arr) AS x FROM co WHERE arr IS NOT NULL)
SELECT id AS analysis_id, '$.modules[' || ordinal || ']' AS module_path, count(*) AS n_commands FROM ce WHERE json_type(x) = 'OBJECT' GROUP BY ALL""")
def flt11_modules_with_commands(c: Catalogue) -> DataFrame:
    """Modules with commands, by the link from child to parent rows."""
    found = nested.objects(nested.shred(c.analyses.select("id", "details"), "id", "details")).where("label = 'commands' AND owner RLIKE '^[$].modules.[0-9]+.$'")
    return found.groupBy(F.col("key").alias("analysis_id"), F.col("owner").alias("module_path")).agg(F.count(F.lit(1)).alias("n_commands"))


@R.query(VALID + """, mo AS (SELECT id, CASE json_type(j -> 'modules') WHEN 'ARRAY' THEN from_json(j -> 'modules', '["JSON"]') WHEN 'OBJECT' THEN [j -> 'modules'] END AS arr FROM dj), me AS (SELECT id, unnest(arr) AS m FROM mo WHERE arr IS NOT NULL),
sw AS (SELECT id, unnest(from_json(m -> 'swi_names', '["JSON"]')) AS x FROM me WHERE json_type(m) = 'OBJECT' AND json_type(m -> 'swi_names') = 'ARRAY') SELECT id AS analysis_id, count(*) AS n FROM sw WHERE (x ->> '$') ILIKE '%swi8%' GROUP BY id""")
def flt05_json_elements(c: Catalogue) -> DataFrame:
    """Analyses one of whose modules offers a call by part of the name: elements of JSON arrays, not text of the JSON."""
    adjacency = nested.shred(c.analyses.select("id", "details"), "id", "details")
    found = adjacency.where((F.col("label") == "swi_names") & F.col("ordinal").isNotNull() & F.col("scalar").ilike(text.like_search("swi8")))
    return found.groupBy(F.col("key").alias("analysis_id")).agg(F.count(F.lit(1)).alias("n"))


@R.query(" SELECT id AS artefact_id, CASE WHEN owner_id IN (SELECT id FROM u WHERE deleted_at IS NOT NULL) THEN NULL ELSE owner_id END AS owner_id FROM a")
def pip13_owners_released(c: Catalogue) -> DataFrame:
    """Artefacts with their owner, none where the user was removed."""
    gone = c.users.where("deleted_at IS NOT NULL").select(F.col("id").alias("owner_id"), F.lit(True).alias("gone"))
    return c.artefacts.select(F.col("id").alias("artefact_id"), "owner_id").join(gone, "owner_id", "left").select("artefact_id", F.when(F.col("gone").isNull(), F.col("owner_id")).alias("owner_id"))


@R.query(" SELECT id AS file_id, partition_id FROM f WHERE NOT is_directory AND extraction_depth < 3 AND (coalesce(lower(risc_os_filetype) IN ('ddc','a91','f89','3fb','68e'), false) OR coalesce(lower(extension) IN ('zip','arc','lha','7z','tar','rar','gz'), false))")
def pip14_archives_to_unpack(c: Catalogue) -> DataFrame:
    """Archives that are not nested too deeply to be unpacked."""
    files = c.files_of("partition_id", "risc_os_filetype", "extension", "is_directory", "extraction_depth")
    return files.where((~F.col("is_directory")) & (F.col("extraction_depth") < 3) & formats.is_archive("risc_os_filetype", "extension")).select(F.col("id").alias("file_id"), "partition_id")


@R.query(" SELECT a.id AS artefact_id, t.analysis_type FROM a JOIN (SELECT DISTINCT a.artefact_type, an.analysis_type FROM an JOIN a ON a.id = an.artefact_id) t ON t.artefact_type = a.artefact_type WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.artefact_id = a.id AND an.analysis_type = t.analysis_type)")
def str10_missing_analyses(c: Catalogue) -> DataFrame:
    """Analyses that artefacts of the same type have had and an artefact hasn't."""
    done = c.analyses.select("artefact_id", "analysis_type").distinct()
    typed = c.artefacts.select(F.col("id").alias("artefact_id"), "artefact_type")
    wanted = done.join(typed, "artefact_id").select("artefact_type", "analysis_type").distinct()
    return typed.join(wanted, "artefact_type").select("artefact_id", "analysis_type").join(done, ["artefact_id", "analysis_type"], "left_anti")


@R.query(KNOWN + ", pl AS (SELECT md5, count(DISTINCT (partition_id, app)) AS n FROM rel GROUP BY md5) SELECT r.product, count(*) AS n_files, count(*) FILTER (WHERE pl.n = 1) AS n_unique FROM rel r JOIN pl USING (md5) GROUP BY r.product")
def gen03_unique_files_of_products(c: Catalogue) -> DataFrame:
    """Files of every product, and those whose content occurs in one application only."""
    from discatlas.operators import known

    apps = _apps(c)
    single = known.uniqueness(apps, "md5", ["partition_id", "app"]).where("is_unique").select("md5", F.lit(True).alias("single"))
    return apps.select("product", "md5").join(single, "md5", "left").groupBy("product").agg(F.count(F.lit(1)).alias("n_files"), F.count("single").alias("n_unique"))


@R.query(" SELECT doc_id, category, lang, source FROM documents WHERE coalesce(lang, '') <> '' QUALIFY row_number() OVER (PARTITION BY category, lang, source ORDER BY created_at DESC, doc_id) = 1")
def itm03_newest_of_each_tag(c: Catalogue) -> DataFrame:
    """Newest document of every category, language and source."""
    rows = c.documents.where("coalesce(lang, '') != ''").select("doc_id", "category", "lang", "source", "created_at")
    return dedup.newest(rows, ["category", "lang", "source"], [F.desc("created_at"), F.asc("doc_id")]).drop("created_at")


@R.query(SETS + ", n AS (SELECT owner, count(*) AS n FROM s GROUP BY owner), o AS (SELECT id AS owner, total_files AS n FROM p WHERE total_files IS NOT NULL) SELECT coalesce(o.owner, n.owner) AS owner, CASE WHEN o.owner IS NULL THEN 'insert' WHEN n.owner IS NULL THEN 'delete' WHEN o.n IS NOT DISTINCT FROM n.n THEN 'keep' ELSE 'update' END AS op FROM o FULL JOIN n ON n.owner = o.owner")
def sim02_reconciled_counts(c: Catalogue) -> DataFrame:
    """What would bring stored counts of content up to date."""
    counted = sim.totals(similarity_plans.content(c)).select("owner", "n")
    stored = c.partitions.where("total_files IS NOT NULL").select(F.col("id").alias("owner"), F.col("total_files").cast("long").alias("n"))
    return sinks.reconcile(stored, counted, ["owner"]).select("owner", "op")
