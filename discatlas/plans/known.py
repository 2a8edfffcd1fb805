"""Queries on known files, products, sinks and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import paths
from discatlas.operators import jobs, known, sinks

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: The catalogue as its own reference database: per file system and application the first file of every relative path.
KNOWN = r""", apps AS (SELECT f.id, f.partition_id, p.filesystem, f.path, f.md5, f.file_size, regexp_extract(f.path, '^((?:[^/]*/)*?![^/]+)(?:/|$)', 1) AS app FROM f JOIN p ON p.id = f.partition_id WHERE NOT f.is_directory AND f.md5 IS NOT NULL AND p.filesystem IS NOT NULL AND f.path LIKE '%!%'),
rel AS (SELECT *, filesystem || ':' || regexp_extract(app, '([^/]*)$', 1) AS product, substr(path, length(app) + 2) AS rel_path FROM apps WHERE app <> '' AND length(path) > length(app)),
kf AS (SELECT id, product, md5, file_size AS size, rel_path, left(rel_path, 1) = '!' AND NOT contains(rel_path, '/') AS required FROM rel QUALIFY row_number() OVER (PARTITION BY product, rel_path ORDER BY id) = 1)"""


def _apps(c: Catalogue) -> DataFrame:
    files = c.files_of("partition_id", "path", "md5", "file_size", "is_directory").where("NOT is_directory AND md5 IS NOT NULL AND path LIKE '%!%'")
    places = c.partitions.where("filesystem IS NOT NULL").select(F.col("id").alias("partition_id"), "filesystem")
    inside = files.withColumn("app", paths.app_folder("path")).where("app IS NOT NULL AND length(path) > length(app)").join(places, "partition_id")
    return inside.select("id", "partition_id", "md5", F.col("file_size").alias("size"), "app", F.concat_ws(":", "filesystem", paths.basename("app")).alias("product"), F.expr("substring(path, length(app) + 2)").alias("rel_path"))


def reference(c: Catalogue) -> DataFrame:
    """Known files: id, product, md5, size, rel_path, required."""
    firsts = _apps(c).groupBy("product", "rel_path").agg(F.min(F.struct("id", "md5", "size")).alias("f"))
    return firsts.select(F.col("f.id").alias("id"), "product", F.col("f.md5").alias("md5"), F.col("f.size").alias("size"), "rel_path", (F.col("rel_path").startswith("!") & ~F.col("rel_path").contains("/")).alias("required"))


def contents(c: Catalogue) -> DataFrame:
    return c.files_of("partition_id", "path", "md5", "file_size", "is_directory").where("NOT is_directory AND md5 IS NOT NULL")


@R.query(KNOWN + " SELECT id, product, md5, size, rel_path, required FROM kf")
def pip09_reference_database(c: Catalogue) -> DataFrame:
    """Reference database generated from the catalogue."""
    return reference(c)


@R.query(KNOWN + " SELECT f.id AS file_id, min(kf.id) AS known_id FROM f JOIN kf ON kf.md5 = f.md5 AND (kf.size IS NULL OR f.file_size IS NULL OR kf.size = f.file_size) WHERE NOT f.is_directory GROUP BY f.id")
def joi05_known_links(c: Catalogue) -> DataFrame:
    """Lowest known file of equal hash and lenient size of every file."""
    return known.link(contents(c).select(F.col("id").alias("file_id"), "md5", F.col("file_size").alias("size")), reference(c))


@R.query(KNOWN + " SELECT md5, product, min(id) AS known_id FROM kf WHERE md5 IN (SELECT md5 FROM f WHERE NOT is_directory) GROUP BY md5, product")
def joi06_all_matches(c: Catalogue) -> DataFrame:
    """Products that know each content."""
    return known.matches(contents(c), reference(c))


@R.query(KNOWN + r""", pf AS (SELECT DISTINCT partition_id, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '/' END AS folder, md5 FROM f WHERE NOT is_directory AND md5 IS NOT NULL),
tot AS (SELECT product, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE NOT required) AS n_optional_total FROM kf GROUP BY product),
m AS (SELECT pf.partition_id, pf.folder, kf.product, count(*) FILTER (WHERE kf.required) AS mr, count(*) FILTER (WHERE NOT kf.required) AS n_optional FROM kf JOIN pf ON pf.md5 = kf.md5 GROUP BY ALL)
SELECT m.partition_id, m.folder, m.product, t.n_required, m.n_optional, t.n_optional_total FROM m JOIN tot t USING (product) WHERE t.n_required > 0 AND m.mr = t.n_required""")
def joi08_recognised_products(c: Catalogue) -> DataFrame:
    """Folders that hold all required files of a product."""
    files = contents(c).select("partition_id", F.when(F.col("path").contains("/"), paths.parent("path")).otherwise("/").alias("folder"), "md5")
    return known.recognise(files, reference(c))


@R.query(KNOWN + " SELECT product, count(*) AS n_files, count(*) FILTER (WHERE required) AS n_required FROM kf GROUP BY product")
def agg27_files_per_product(c: Catalogue) -> DataFrame:
    """Known and required files of every product."""
    return reference(c).groupBy("product").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("required").alias("n_required"))


@R.query(KNOWN + " SELECT product FROM kf GROUP BY product HAVING count(*) FILTER (WHERE required) = 0")
def agg27_without_required(c: Catalogue) -> DataFrame:
    """Products without any required file."""
    return agg27_files_per_product(c).where("n_required = 0").select("product")


@R.query(KNOWN + " SELECT kf.id AS known_id, count(f.id) AS n_matches FROM kf LEFT JOIN f ON f.md5 = kf.md5 AND NOT f.is_directory GROUP BY kf.id")
def agg28_matches_per_known(c: Catalogue) -> DataFrame:
    """Files of equal content of every known file, counted per content before the join."""
    counted = contents(c).groupBy("md5").agg(F.count(F.lit(1)).alias("n_matches"))
    return reference(c).select(F.col("id").alias("known_id"), "md5").join(counted, "md5", "left").select("known_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@R.query(KNOWN + " SELECT md5, count(DISTINCT (partition_id, app)) AS n_places, count(DISTINCT (partition_id, app)) = 1 AS is_unique FROM rel GROUP BY md5")
def agg34_uniqueness(c: Catalogue) -> DataFrame:
    """In how many applications each content occurs."""
    return known.uniqueness(_apps(c), "md5", ["partition_id", "app"])


@R.query(KNOWN + ", e AS (SELECT DISTINCT product, partition_id, app, rel_path || '=' || md5 AS e FROM rel) SELECT product, partition_id, app, count(*) AS n_files, md5(count(e) || ':' || bit_xor(('0x' || substr(md5(e), 1, 15))::BIGINT) || ':' || sum(('0x' || substr(md5(e), 16, 15))::BIGINT)::HUGEINT) AS fingerprint FROM e GROUP BY ALL")
def agg35_app_fingerprints(c: Catalogue) -> DataFrame:
    """Fingerprint of every copy of an application."""
    return known.fingerprint(_apps(c), ["product", "partition_id", "app"], F.concat_ws("=", "rel_path", "md5"))


@R.query(KNOWN + """, e AS (SELECT DISTINCT product, partition_id, app, rel_path || '=' || md5 AS e FROM rel), fp AS (SELECT product, partition_id, app, md5(string_agg(e, ',' ORDER BY e)) AS fp FROM e GROUP BY ALL)
SELECT product, count(*) AS n_copies, count(DISTINCT fp) AS n_versions FROM fp GROUP BY product HAVING count(*) >= 2 AND count(DISTINCT fp) >= 2""")
def agg36_canonical_candidates(c: Catalogue) -> DataFrame:
    """Applications with several copies that differ."""
    prints = known.fingerprint(_apps(c), ["product", "partition_id", "app"], F.concat_ws("=", "rel_path", "md5"))
    return prints.groupBy("product").agg(F.count(F.lit(1)).alias("n_copies"), F.count_distinct("fingerprint").alias("n_versions")).where("n_copies >= 2 AND n_versions >= 2")


@R.query(KNOWN + ", s AS (SELECT lower(product) AS key, product AS spelling, count(*) AS n FROM rel GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, spelling) = 1")
def agg36_spellings(c: Catalogue) -> DataFrame:
    """Most frequent spelling of every application's name."""
    return known.spelling(_apps(c), F.lower("product"), "product")


@R.query(r""", x AS (SELECT id, lower(original_filename) AS name FROM a WHERE original_filename IS NOT NULL), y AS (SELECT id, name, regexp_extract(name, '^(.*?)(?:\.[a-z0-9]+)?$', 1) AS base, CASE regexp_extract(name, '\.([a-z0-9]+)$', 1) WHEN 'zip' THEN 0 WHEN 'gz' THEN 1 WHEN 'zst' THEN 1 ELSE 2 END AS form FROM x)
SELECT base, id AS artefact_id, name FROM y QUALIFY row_number() OVER (PARTITION BY base ORDER BY form, id) = 1""")
def agg37_best_form(c: Catalogue) -> DataFrame:
    """Of several forms of one image the archive, else the compressed, else the raw one."""
    name = F.lower("original_filename")
    suffix = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    form = F.when(suffix == "zip", 0).when(suffix.isin("gz", "zst"), 1).otherwise(2)
    rows = c.artefacts.where("original_filename IS NOT NULL").select(F.regexp_extract(name, r"^(.*?)(?:\.[a-z0-9]+)?$", 1).alias("base"), F.struct(form.alias("form"), "id", name.alias("name")).alias("at"))
    return rows.groupBy("base").agg(F.min("at").alias("at")).select("base", F.col("at.id").alias("artefact_id"), F.col("at.name").alias("name"))


@R.query(" SELECT DISTINCT storage_path FROM b WHERE storage_path IS NOT NULL AND storage_path NOT IN (SELECT storage_path FROM so WHERE storage_path IS NOT NULL)")
def snk01_insert_ignore(c: Catalogue) -> DataFrame:
    """Blob paths that would be added to the listing of the store."""
    return sinks.insert_ignore(c.stored, c.blobs.select("storage_path"), ["storage_path"])


@R.query(" , n AS (SELECT partition_id AS id, count(*) AS total FROM f WHERE partition_id IS NOT NULL GROUP BY 1), o AS (SELECT id, total_files AS total FROM p) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.total IS NOT DISTINCT FROM n.total THEN 'keep' ELSE 'update' END AS op, n.total FROM o FULL JOIN n ON o.id = n.id")
def snk03_reconcile_totals(c: Catalogue) -> DataFrame:
    """What brings the stored file totals of partitions up to date."""
    counted = c.files_of("partition_id").where("partition_id IS NOT NULL").groupBy(F.col("partition_id").alias("id")).agg(F.count(F.lit(1)).alias("total"))
    return sinks.reconcile(c.partitions.select("id", F.col("total_files").cast("long").alias("total")), counted, ["id"])


@R.query(" SELECT f.id AS file_id FROM f WHERE coalesce(f.partition_id, -1) NOT IN (SELECT p.id FROM p WHERE p.filesystem = 'NTFS')")
def snk07_cascade_delete(c: Catalogue) -> DataFrame:
    """Files left when the partitions of a file system go."""
    doomed = c.partitions.where("filesystem = 'NTFS'")
    return sinks.delete_cascade(c.files_of("partition_id"), doomed, "id", "partition_id").select(F.col("id").alias("file_id"))


@R.query()
def snk10_json_export(c: Catalogue) -> DataFrame:
    """The reference database as one JSON text per product."""
    return sinks.nested_json(reference(c))


@R.query(" SELECT user_id AS key, max(ts) AS last_seen, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def str03_last_seen(c: Catalogue) -> DataFrame:
    """Newest event of every worker."""
    return jobs.last_seen(c.raw("events"), "user_id", "ts")


@R.query(" SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR ts - prev >= INTERVAL 3600 SECONDS")
def str12_spaced_beats(c: Catalogue) -> DataFrame:
    """Events that come an hour or more after the one before of the same worker."""
    return jobs.spaced(c.raw("events"), "user_id", "ts", 3600).select("user_id", "event_id")


@R.query(" SELECT artefact_id, analysis_type, min(id) AS id FROM an WHERE status IN ('PENDING', 'RUNNING') GROUP BY ALL")
def str07_open_jobs_once(c: Catalogue) -> DataFrame:
    """One open analysis per artefact and type."""
    return jobs.open_once(c.analyses, ["artefact_id", "analysis_type"])


@R.query(" SELECT id AS analysis_id FROM an WHERE status = 'RUNNING' AND started_at < (SELECT max(loaded_at) FROM an) - INTERVAL 86400 SECONDS")
def str04_stale_jobs(c: Catalogue) -> DataFrame:
    """Running analyses that began more than a day before the newest arrival."""
    now = c.raw("analyses").agg(F.max("loaded_at")).first()[0]
    return jobs.stale(c.analyses, "started_at", F.lit(now), 86_400).select(F.col("id").alias("analysis_id"))


VALID = """, dj AS (SELECT id, CASE WHEN json_valid(details) THEN CASE WHEN json_type(details) = 'VARCHAR' THEN CASE WHEN json_valid(details ->> '$') THEN (details ->> '$')::JSON END ELSE details::JSON END END AS j FROM an WHERE details IS NOT NULL)"""


def _top(label: str) -> str:
    return VALID + f""", ar AS (SELECT id, CASE json_type(j -> '{label}') WHEN 'ARRAY' THEN from_json(j -> '{label}', '["JSON"]') WHEN 'OBJECT' THEN [j -> '{label}'] END AS arr FROM dj WHERE j IS NOT NULL),
el AS (SELECT id, k - 1 AS ordinal, arr[k] AS e FROM ar, unnest(range(1, len(arr) + 1)) AS t(k) WHERE arr IS NOT NULL)"""


def _index(name: str, label: str, fields: dict[str, str]) -> None:
    from discatlas.operators import nested

    def run(c: Catalogue) -> DataFrame:
        adjacency = nested.shred(c.analyses.select("id", "details"), "id", "details")
        return nested.entities(adjacency, label, fields).where("parent_path = '$'").select(F.col("key").alias("analysis_id"), "ordinal", *fields)

    run.__doc__ = f"Index rows of the {label} in all analyses."
    picked = ", ".join(f"CASE WHEN json_type(e -> '{f}') IN ('OBJECT', 'ARRAY') THEN NULL ELSE {'TRY_CAST(e ->> ' + repr(f) + ' AS BIGINT)' if t == 'long' else 'e ->> ' + repr(f)} END AS {f}" for f, t in fields.items())
    R.query(_top(label) + f" SELECT id AS analysis_id, ordinal, {picked} FROM el WHERE json_type(e) = 'OBJECT'", name)(run)


_index("src09_index_modules", "modules", {"title_string": "string", "file_path": "string", "hash": "string", "version": "string"})
_index("src09_index_movies", "movies", {"file_path": "string", "title": "string", "frame_rate": "string"})
_index("src09_index_media", "transcoded", {"file_path": "string", "media_kind": "string"})
_index("src09_index_protection", "indicators", {"type": "string", "track": "long", "sector_id": "string"})
_index("src09_index_outputs", "outputs", {"filename": "string", "size": "long"})
_index("src09_index_partitions", "partitions", {"index": "long", "filesystem": "string"})
