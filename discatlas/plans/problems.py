"""Queries of the general data-processing problems (names pN_...)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discatlas.operators import instants, nested, orphans, skewagg
from discatlas.runtime import shared_dir, stored
from discatlas.tables import distinct_delivery, first_delivery, load

TIME_FIELDS = ("created_time", "modified_time", "accessed_time")


def _details(spark: SparkSession, folder: str) -> DataFrame:
    return first_delivery(load(spark, folder, "analyses").select("id", "details", "loaded_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON object that is an array element, with its path and its parent's."""
    found = nested.objects(nested.shred(_details(spark, folder), "id", "details", scalars=False))
    return found.select(F.col("key").alias("analysis_id"), F.col("path").alias("node_path"), F.col("owner").alias("parent_path"))


def _entities(label: str, fields: dict[str, str]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        adjacency = stored(nested.shred(_details(spark, folder), "id", "details", only=label, fields=tuple(fields)), "adjacency")
        return nested.entities(adjacency, label, fields).withColumnRenamed("key", "analysis_id")

    query.__doc__ = f"Flat table of the {label} of all analyses, with parent links."
    return query


def p3_found(spark: SparkSession, folder: str, kept: str | None = None) -> DataFrame:
    """Every time field that isn't in the canonical form, as a UTC instant.

    kept is the folder of the dictionary. The next run over the same tables finds
    it there, below the shared folder if nothing else is said, and parses new
    texts only.
    """
    files = load(spark, folder, "extracted_files").select("id", "partition_id", *TIME_FIELDS)
    melted = files.unpivot(["id", "partition_id"], list(TIME_FIELDS), "field_name", "raw")
    wanted = distinct_delivery(melted.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(instants.CANONICAL)), "id", "field_name")
    zones = first_delivery(load(spark, folder, "disc_partitions").select("id", "source_tz", "loaded_at"))
    rows = wanted.join(zones.select(F.col("id").alias("partition_id"), "source_tz"), "partition_id", "left")
    dictionary = instants.InstantDictionary(spark, kept or f"{shared_dir(spark)}/instants/{hashlib.sha256(folder.encode()).hexdigest()[:16]}")
    found = instants.normalise(rows, "raw", "source_tz", dictionary, "field_name")
    return found.where("utc_us IS NOT NULL").select(F.col("id").alias("file_id"), "field_name", "utc_us")


def _refs(df: DataFrame, key: str) -> DataFrame:
    rows = first_delivery(df.select("id", key, "created_at", "loaded_at"))
    return rows.select(F.col("id").alias("row_id"), F.col(key).alias("key"), F.date_format("created_at", "yyyy-MM").alias("period"), F.col("loaded_at").alias("arrived"))


def _targets(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("loaded_at").alias("arrived"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """API keys and upload blobs whose user or stored object is missing, deleted or late."""
    users = first_delivery(load(spark, folder, "users").select("id", "deleted_at", "loaded_at"))
    stored = load(spark, folder, "stored_objects").where("storage_directory = 'UPLOADS'")
    stored = first_delivery(stored.select("object_id", "storage_path", "deleted_at", "loaded_at"), "object_id")
    keys = orphans.orphans(_refs(load(spark, folder, "api_keys"), "user_id"), _targets(users, "id"))
    blobs = orphans.orphans(_refs(load(spark, folder, "upload_blobs"), "storage_path"), _targets(stored, "storage_path"))
    return keys.withColumn("table_name", F.lit("api_keys")).unionByName(blobs.withColumn("table_name", F.lit("upload_blobs"))).select("table_name", "row_id", "period", "state")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, month and state."""
    return p4_found(spark, folder).groupBy("table_name", "period", "state").agg(F.count(F.lit(1)).alias("n_refs"))


def _profiles(spark: SparkSession, folder: str) -> list[tuple[str, str, DataFrame, DataFrame]]:
    files, blobs = load(spark, folder, "extracted_files"), load(spark, folder, "upload_blobs")
    return [
        ("extracted_files", "filename", files, skewagg.key_profile(files, "filename", "file_size", "partition_id")),
        ("upload_blobs", "md5", blobs, skewagg.key_profile(blobs, "md5", "file_size", "file_size")),
    ]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """File names and md5 values that hold at least 1 % of the rows of their table."""
    parts = [skewagg.heavy_keys(profile, df.count()).select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "key_value") for table, field, df, profile in _profiles(spark, folder)]
    return parts[0].unionByName(parts[1])


def p5_key_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, bytes and distinct partitions or sizes of every file name and md5 value."""
    parts = [profile.select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "key_value", "n_rows", "n_bytes", "n_members") for table, field, _, profile in _profiles(spark, folder)]
    return parts[0].unionByName(parts[1])


#: Flat tables that are made of the analyses' details, with their fields.
ENTITIES = {
    "partitions": {"index": "int", "filesystem": "string", "label": "string"},
    "entries": {"name": "string", "size": "long"},
    "modules": {"title_string": "string", "file_path": "string", "hash": "string", "version": "string"},
    "indicators": {"type": "string", "track": "int", "sector_id": "string"},
    "chunks": {"offset": "long", "bytes": "long"},
}
#: Flat tables of every level with all scalar fields; those of an object standing in the element are named by both keys.
FLAT = {
    "analyses": {"path_prefix": "string", "file.file_type": "string", "summary.score": "double"},
    "partitions": {"index": "int", "filesystem": "string", "label": "string", "geometry.heads": "int", "geometry.tracks": "int", "geometry.sector_size": "int"},
    "directories": {"path": "string"},
    "entries": {"name": "string", "size": "long", "attrs.load": "string", "attrs.exec": "string", "attrs.access": "string"},
    "forks": {"kind": "string", "len": "long"},
    "modules": {"title_string": "string", "file_path": "string", "hash": "string", "version": "string"},
    "commands": {"name": "string", "min_args": "int"},
    "arguments": {"pos": "int", "type": "string"},
    "indicators": {"type": "string", "track": "int", "side": "int", "sector_id": "string"},
    "evidence": {"sector": "int"},
    "reads": {"rev": "int", "crc": "string"},
    "movies": {"file_path": "string", "title": "string", "width": "int", "height": "int", "frame_rate": "string", "audio.rate": "int"},
    "tracks": {"channels": "int", "lang": "string"},
    "chunks": {"offset": "long", "bytes": "long"},
    "transcoded": {"file_path": "string", "media_kind": "string"},
    "streams": {"codec": "string", "tags.title": "string", "tags.year": "int"},
    "outputs": {"filename": "string", "size": "long", "path": "string", "probe.ok": "boolean"},
    "segments": {"from": "long", "crc": "string"},
    "failed_conversions": {"source": "string", "error.code": "int", "error.text": "string"},
}


def _flat(label: str, fields: dict[str, str]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = nested.flat(_details(spark, folder), "id", "details", None if label == "analyses" else label, fields)
        return found.withColumnRenamed("key", "analysis_id")

    query.__doc__ = f"Flat table of the {label} of all analyses with every field, and parent links to the table above."
    return query


def p2_flat_values(spark: SparkSession, folder: str) -> DataFrame:
    """Scalars in arrays of all levels, with the row that holds the array."""
    return nested.values(nested.shred(_details(spark, folder), "id", "details")).withColumnRenamed("key", "analysis_id")


QUERIES = {
    "p2_found": p2_found,
    **{f"p2_{label}": _entities(label, fields) for label, fields in ENTITIES.items()},
    **{f"p2_flat_{label}": _flat(label, fields) for label, fields in FLAT.items()},
    "p2_flat_values": p2_flat_values,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_key_profile": p5_key_profile,
}

_FIRST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY {1} ORDER BY loaded_at) = 1"
_P4 = f"""
WITH keys AS ({_FIRST.format("api_keys", "id")}), blobs AS ({_FIRST.format("upload_blobs", "id")}),
people AS ({_FIRST.format("users", "id")}),
objects AS (SELECT * FROM (SELECT * FROM stored_objects WHERE storage_directory = 'UPLOADS') QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY loaded_at) = 1),
refs AS (
  SELECT 'api_keys' AS table_name, id, CAST(user_id AS VARCHAR) AS k, created_at, loaded_at FROM keys WHERE user_id IS NOT NULL
  UNION ALL SELECT 'upload_blobs', id, storage_path, created_at, loaded_at FROM blobs WHERE storage_path IS NOT NULL),
targets AS (
  SELECT 'api_keys' AS table_name, CAST(id AS VARCHAR) AS k, deleted_at, loaded_at FROM people
  UNION ALL SELECT 'upload_blobs', storage_path, deleted_at, loaded_at FROM objects),
grouped AS (SELECT table_name, k, count(*) AS n, min(CASE WHEN deleted_at IS NULL THEN loaded_at END) AS since,
  count(*) FILTER (WHERE deleted_at IS NULL) AS live FROM targets GROUP BY ALL),
judged AS (SELECT r.table_name, r.id AS row_id, strftime(r.created_at, '%Y-%m') AS period,
  CASE WHEN g.n IS NULL THEN 'missing' WHEN g.live = 0 THEN 'deleted' WHEN g.since > r.loaded_at THEN 'late' END AS state
  FROM refs r LEFT JOIN grouped g ON g.table_name = r.table_name AND g.k = r.k)
"""
_P5 = """
WITH profile AS (
  SELECT 'extracted_files' AS table_name, 'filename' AS field_name, filename AS key_value, count(*) AS n_rows,
    CAST(sum(file_size) AS BIGINT) AS n_bytes, count(DISTINCT partition_id) AS n_members FROM extracted_files GROUP BY filename
  UNION ALL
  SELECT 'upload_blobs', 'md5', md5, count(*), CAST(sum(file_size) AS BIGINT), count(DISTINCT file_size) FROM upload_blobs GROUP BY md5)
"""
_LONE = ", ".join(f"'{k}'" for k in nested.LONE_KEYS)
_P2 = f"""
WITH RECURSIVE an AS ({_FIRST.format("analyses", "id")}),
d AS (SELECT id AS aid, CASE WHEN json_valid(details) THEN CASE WHEN json_type(details) = 'VARCHAR' THEN CASE WHEN json_valid(details ->> '$') THEN (details ->> '$')::JSON END ELSE details::JSON END END AS j FROM an WHERE details IS NOT NULL),
t AS (SELECT d.aid, jt.id AS nid, jt.parent, jt.key, jt.type, jt.atom FROM d, json_tree(d.j) AS jt WHERE d.j IS NOT NULL),
r(aid, nid, type, path, owner, element, label, ordinal) AS (
  SELECT aid, nid, type, '$', '$', false, '$', NULL::INTEGER FROM t WHERE parent IS NULL
  UNION ALL
  SELECT c.aid, c.nid, c.type,
    p.path || CASE WHEN p.type = 'ARRAY' THEN '[' || c.key || ']' ELSE '.' || c.key || CASE WHEN c.type = 'OBJECT' AND c.key IN ({_LONE}) THEN '[0]' ELSE '' END END,
    CASE WHEN p.element THEN p.path ELSE p.owner END,
    p.type = 'ARRAY' OR (c.type = 'OBJECT' AND c.key IN ({_LONE})),
    CASE WHEN p.type = 'ARRAY' THEN p.label ELSE c.key END,
    CASE WHEN p.type = 'ARRAY' THEN c.key::INTEGER WHEN c.type = 'OBJECT' AND c.key IN ({_LONE}) THEN 0 END
  FROM r p JOIN t c ON c.aid = p.aid AND c.parent = p.nid)
"""


def _entity_sql(label: str, fields: dict[str, str]) -> str:
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT"}
    picked = ", ".join(f"TRY_CAST(max(CASE WHEN c.key = '{f}' AND c.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN c.atom ->> '$' END) AS {kinds[k]}) AS {f}" for f, k in fields.items())
    return _P2 + f"SELECT r.aid AS analysis_id, r.path AS node_path, r.owner AS parent_path, r.ordinal, {picked} FROM r LEFT JOIN t c ON c.aid = r.aid AND c.parent = r.nid WHERE r.element AND r.type = 'OBJECT' AND r.label = '{label}' GROUP BY ALL"


def _flat_sql(label: str, fields: dict[str, str]) -> str:
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    picks = []
    for name, kind in fields.items():
        *outer, last = name.split(".")
        here, where = ("d", f"c.key = '{outer[0]}' AND c.type = 'OBJECT' AND d.key = '{last}'") if outer else ("c", f"c.key = '{last}'")
        picks.append(f"TRY_CAST(max(CASE WHEN {where} AND {here}.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {here}.atom ->> '$' END) AS {kinds[kind]}) AS {name.replace('.', '_')}")
    rows = f"SELECT *, owner AS above FROM r WHERE element AND type = 'OBJECT' AND label = '{label}'"
    if label == "analyses":
        rows = "SELECT *, NULL::VARCHAR AS above FROM r WHERE path = '$' AND label = '$' AND NOT element AND type IN ('OBJECT', 'ARRAY')"
    return _P2 + f", e AS ({rows}) SELECT e.aid AS analysis_id, e.path AS node_path, e.above AS parent_path, e.ordinal, {', '.join(picks)} FROM e LEFT JOIN t c ON c.aid = e.aid AND c.parent = e.nid LEFT JOIN t d ON d.aid = c.aid AND d.parent = c.nid AND c.key NOT IN ({_LONE}) GROUP BY e.aid, e.nid, e.path, e.above, e.ordinal"


ORACLE = {
    "p2_found": _P2 + "SELECT aid AS analysis_id, path AS node_path, owner AS parent_path FROM r WHERE element AND type = 'OBJECT'",
    **{f"p2_{label}": _entity_sql(label, fields) for label, fields in ENTITIES.items()},
    **{f"p2_flat_{label}": _flat_sql(label, fields) for label, fields in FLAT.items()},
    "p2_flat_values": _P2 + """SELECT c.aid AS analysis_id, CASE WHEN r.element THEN r.path ELSE r.owner END AS parent_path, r.label AS field, c.key::INTEGER AS ordinal, c.atom ->> '$' AS value
      FROM r JOIN t c ON c.aid = r.aid AND c.parent = r.nid WHERE r.type = 'ARRAY' AND c.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p4_found": _P4 + "SELECT table_name, row_id, period, state FROM judged WHERE state IS NOT NULL",
    "p4_report": _P4 + "SELECT table_name, period, state, count(*) AS n_refs FROM judged WHERE state IS NOT NULL GROUP BY ALL",
    "p5_found": _P5 + """SELECT table_name, field_name, key_value FROM profile WHERE key_value IS NOT NULL
      AND n_rows >= 0.01 * CASE table_name WHEN 'upload_blobs' THEN (SELECT count(*) FROM upload_blobs) ELSE (SELECT count(*) FROM extracted_files) END""",
    "p5_key_profile": _P5 + "SELECT * FROM profile",
}
