"""Queries in the search language over the whole catalogue: every family of keys, totals and pages of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.operators import buckets, nested, search
from discatlas.plans.known import VALID
from discatlas.runtime import stored

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def modules(c: Catalogue) -> DataFrame:
    """Module index: artefact_id, file_path, title_string, commands and swi_names of the modules in all analyses."""
    analyses = c.analyses.select("id", "artefact_id", "details").where("artefact_id IS NOT NULL")
    adjacency = stored(nested.shred(analyses.where("details LIKE '%modules%'"), "id", "details"), "adjacency")
    found = nested.entities(adjacency, "modules", {"file_path": "string", "title_string": "string"}).where("parent_path = '$'")
    commands = nested.entities(adjacency, "commands", {"name": "string"}).groupBy("key", F.col("parent_path").alias("node_path")).agg(F.collect_list("name").alias("commands"))
    calls = nested.values(adjacency).where("field = 'swi_names'").groupBy("key", F.col("parent_path").alias("node_path")).agg(F.collect_list("value").alias("swi_names"))
    whole = found.join(commands, ["key", "node_path"], "left").join(calls, ["key", "node_path"], "left")
    return whole.join(analyses.select(F.col("id").alias("key"), "artefact_id"), "key")


def _index(c: Catalogue, label: str, fields: dict[str, str]) -> DataFrame:
    analyses = c.analyses.select("id", "artefact_id", "details").where("artefact_id IS NOT NULL")
    found = nested.flat(analyses.where(F.col("details").contains(label)), "id", "details", label, fields).where("parent_path = '$'")
    return found.join(analyses.select(F.col("id").alias("key"), "artefact_id"), "key")


def tables(c: Catalogue) -> buckets.Tables:
    """The catalogue as tables of a search. Hashes of an artefact are those of its blob, tags the sources of its documents."""

    def artefacts() -> DataFrame:
        blobs = c.blobs.select(F.col("id").alias("upload_blob_id"), F.lower("md5").alias("md5"), F.lower("sha256").alias("sha256"))
        return c.artefacts.join(blobs, "upload_blob_id", "left")

    return buckets.Tables({
        "files": lambda: c.files_of("partition_id", "path", "filename", "extension", "file_size", "md5", "risc_os_filetype", "is_directory", "extraction_depth"),
        "partitions": lambda: c.partitions,
        "artefacts": artefacts,
        "items": lambda: c.items,
        "modules": lambda: modules(c),
        "movies": lambda: _index(c, "movies", {"file_path": "string", "title": "string", "width": "long", "height": "long", "frame_rate": "double"}),
        "protections": lambda: _index(c, "indicators", {"type": "string"}).withColumnRenamed("type", "kind"),
        "tags": lambda: c.documents.select("artefact_id", F.col("source").alias("tag")).where("tag IS NOT NULL AND artefact_id IS NOT NULL").distinct(),
    })


def _found(c: Catalogue, query: str, dedupe: bool = False) -> DataFrame:
    out = None
    for df in buckets.found(query, tables(c), dedupe):
        df = df.select("bucket", "kind", "row_id", "artefact_id", "item_id", "detail")
        out = df if out is None else out.unionByName(df)
    return out


_TOP = VALID + """, di AS (SELECT dj.id, an.artefact_id, dj.j FROM dj JOIN an ON an.id = dj.id WHERE dj.j IS NOT NULL AND an.artefact_id IS NOT NULL)"""


def _list(source: str, key: str) -> str:
    return f"CASE json_type({source} -> '{key}') WHEN 'ARRAY' THEN from_json({source} -> '{key}', '[\"JSON\"]') WHEN 'OBJECT' THEN [{source} -> '{key}'] ELSE [] END"


def _scalar(source: str, key: str) -> str:
    return f"CASE WHEN json_type({source} -> '{key}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {source} ->> '{key}' END"


_MODULES = _TOP + f""", mo AS (SELECT id, artefact_id, unnest({_list("j", "modules")}) AS m FROM di),
md AS (SELECT artefact_id, {_scalar("m", "file_path")} AS file_path, {_scalar("m", "title_string")} AS title,
  list_transform(list_filter({_list("m", "commands")}, lambda x: json_type(x) = 'OBJECT'), lambda x: lower(x ->> 'name')) AS commands,
  CASE json_type(m -> 'swi_names') WHEN 'ARRAY' THEN list_transform(from_json(m -> 'swi_names', '["JSON"]'), lambda x: lower(x ->> '$')) ELSE [] END AS swis FROM mo WHERE json_type(m) = 'OBJECT')"""
_MOVIES = _TOP + f""", mv AS (SELECT artefact_id, unnest({_list("j", "movies")}) AS m FROM di),
me AS (SELECT artefact_id, {_scalar("m", "file_path")} AS file_path, TRY_CAST({_scalar("m", "width")} AS BIGINT) AS width, TRY_CAST({_scalar("m", "frame_rate")} AS DOUBLE) AS rate FROM mv WHERE json_type(m) = 'OBJECT')"""
_KINDS = _TOP + f""", ki AS (SELECT artefact_id, unnest({_list("j", "indicators")}) AS m FROM di),
pr AS (SELECT artefact_id, {_scalar("m", "type")} AS kind FROM ki WHERE json_type(m) = 'OBJECT')"""
_PLACE = " JOIN p ON p.id = f.partition_id JOIN a ON a.id = p.artefact_id JOIN i ON i.id = a.item_id"


def _rows(name: str, table: str, builders: dict, negations: str, query: str, sql: str, doc: str) -> None:
    """Rows of a metadata table that a query finds; files of theirs are what `buckets.found` joins them to, which no row of the test tables has."""

    def run(c: Catalogue) -> DataFrame:
        rows = getattr(tables(c), table)
        return rows.where(buckets.family(search.parse(query), builders, negations)).select("artefact_id", "file_path")

    run.__doc__ = f"{doc}: {query}"
    R.query(sql, name)(run)


_MD, _ME = _MODULES + " SELECT artefact_id, file_path FROM md WHERE ", _MOVIES + " SELECT artefact_id, file_path FROM me WHERE "
_rows("flt11_module_title", "modules", buckets.MODULE, "key", "module:*a* !module:*e*", _MD + "title ILIKE '%a%' AND NOT coalesce(title ILIKE '%e%', false)", "Modules by title")
_rows("flt11_module_command", "modules", buckets.MODULE, "key", "command:Database command:*let* !swi:Swi8", _MD + "(list_contains(commands, 'database') OR len(list_filter(commands, lambda y: y LIKE '%let%')) > 0)", "Modules by commands; a negated key of its own kind only has an effect")
_rows("flt11_module_calls", "modules", buckets.MODULE, "key", "swi:*swi* command:* !swi:Swi8", _MD + "len(list_filter(swis, lambda y: y LIKE '%swi%')) > 0 AND len(commands) > 0 AND NOT list_contains(swis, 'swi8')", "Modules by calls and commands")
_rows("flt12_movies_found", "movies", buckets.REPLAY, "none", "replaywidth:160 replaywidth:>=320 replayframerate:10..25 !replaywidth:320", _ME + "(width = 160 OR width >= 320) AND rate BETWEEN 10 AND 25", "Movies by width and rate, whose negations have no effect")
_rows("flt12_movies_by_title", "movies", buckets.REPLAY, "none", "replaytitle:a replayframerate:<20", _MOVIES.replace("AS rate", "AS rate, " + _scalar("m", "title") + " AS title") + " SELECT artefact_id, file_path FROM me WHERE title ILIKE '%a%' AND rate < 20", "Movies by title and rate")


@R.query(_KINDS + " SELECT pr.artefact_id, a.item_id, min(pr.kind) AS kind FROM pr JOIN a ON a.id = pr.artefact_id JOIN i ON i.id = a.item_id WHERE lower(pr.kind) IN ('odd_sector', 'weak_bits') AND NOT coalesce(lower(pr.kind) = 'weak_bits', false) GROUP BY ALL")
def pip05_protected_artefacts(c: Catalogue) -> DataFrame:
    """Artefacts by kind of copy protection, with a negation."""
    return _found(c, "protection:Odd_Sector prot:weak_bits !protection:weak_bits").select("artefact_id", "item_id", F.col("detail").alias("kind"))


@R.query(" SELECT DISTINCT a.id AS artefact_id, a.item_id, d.source AS tag FROM documents d JOIN a ON a.id = d.artefact_id JOIN i ON i.id = a.item_id WHERE d.source ILIKE '%a%' AND NOT d.source ILIKE '%r%'")
def pip05_tagged_artefacts(c: Catalogue) -> DataFrame:
    """Artefacts by tags."""
    return _found(c, "tag:a !tag:r").select("artefact_id", "item_id", F.col("detail").alias("tag"))


@R.query(" SELECT p.id AS partition_id, a.id AS artefact_id, a.item_id, p.label FROM p JOIN a ON a.id = p.artefact_id JOIN i ON i.id = a.item_id WHERE p.label ILIKE '%a%' AND lower(p.filesystem) IN ('adfs', 'fat12') AND NOT coalesce(p.label ILIKE '%o%', false)")
def pip05_partitions(c: Catalogue) -> DataFrame:
    """Partitions by label and file system, with a negation."""
    return _found(c, "disc:a fs:ADFS filesystem:fat12 !label:o").select(F.col("row_id").alias("partition_id"), "artefact_id", "item_id", F.col("detail").alias("label"))


@R.query(" SELECT 'artefacts' AS bucket, a.id AS row_id, a.item_id FROM a JOIN b ON b.id = a.upload_blob_id JOIN i ON i.id = a.item_id WHERE lower(b.sha256) LIKE '0%' OR lower(b.md5) LIKE '1%' UNION ALL SELECT 'files', f.id, i.id FROM f" + _PLACE + " WHERE NOT f.is_directory AND f.md5 ILIKE '1%' AND false")
def pip05_artefact_hashes(c: Catalogue) -> DataFrame:
    """Artefacts and files by the beginning of a hash; files here have no sha256, so none meets both keys."""
    return _found(c, "sha256:0 md5:1").select("bucket", "row_id", "item_id")


@R.query(" SELECT 'items' AS bucket, id AS row_id, NULL::BIGINT AS artefact_id FROM i WHERE name ILIKE '%a%' AND name ILIKE '%e%' UNION ALL SELECT 'artefacts', a.id, a.id FROM a JOIN i ON i.id = a.item_id WHERE a.label ILIKE '%a%' AND a.label ILIKE '%e%'")
def pip05_words(c: Catalogue) -> DataFrame:
    """Items and artefacts in which every word occurs."""
    return _found(c, "a e").select("bucket", "row_id", "artefact_id")


@R.query(_KINDS + ", m(bucket) AS (VALUES ('files'), ('artefacts'), ('items')), r AS (SELECT 'files' AS bucket, f.id FROM f" + _PLACE + " WHERE NOT f.is_directory AND f.path ILIKE '%a%' UNION ALL SELECT 'artefacts', artefact_id FROM (SELECT DISTINCT pr.artefact_id FROM pr JOIN a ON a.id = pr.artefact_id JOIN i ON i.id = a.item_id WHERE lower(kind) = 'odd_sector') UNION ALL SELECT 'artefacts', p.id FROM p JOIN a ON a.id = p.artefact_id JOIN i ON i.id = a.item_id WHERE lower(p.filesystem) = 'adfs') SELECT bucket, count(id) AS n FROM m LEFT JOIN r USING (bucket) GROUP BY bucket")
def set05_totals_of_buckets(c: Catalogue) -> DataFrame:
    """Totals of the three buckets of one search."""
    return buckets.totals(buckets.found("path:a protection:odd_sector fs:adfs", tables(c)), c.spark)


@R.query(", r AS (SELECT 'file' AS kind, f.id AS row_id, lower(i.name) AS x, lower(a.label) AS y, lower(f.path) AS z FROM f" + _PLACE + " WHERE NOT f.is_directory AND f.path ILIKE '%a%' UNION ALL SELECT 'partition', p.id, lower(i.name), lower(a.label), lpad(p.partition_index::VARCHAR, 10, '0') FROM p JOIN a ON a.id = p.artefact_id JOIN i ON i.id = a.item_id WHERE lower(p.filesystem) = 'adfs'), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY x NULLS LAST, y NULLS LAST, z NULLS LAST, row_id) AS nth, count(*) OVER (PARTITION BY kind) AS total FROM r) SELECT kind, row_id, total > 100 AS has_more FROM n WHERE nth > 50 AND nth <= 100")
def set05_page_of_buckets(c: Catalogue) -> DataFrame:
    """Second page of every kind of one search, and whether the kind goes on."""
    return buckets.page(buckets.found("path:a fs:adfs", tables(c)), 2, 50).select("kind", "row_id", "has_more")


@R.query(", r AS (SELECT coalesce(f.md5, 'id:' || f.id) AS content, f.id, (lower(i.name) IS NULL, lower(i.name), lower(a.label) IS NULL, lower(a.label), lower(f.path), f.id) AS k FROM f" + _PLACE + " WHERE NOT f.is_directory AND f.path ILIKE '%e%' AND f.path IS NOT NULL) SELECT content, count(*)::VARCHAR AS copies FROM r GROUP BY 1")
def pip04_search_of_contents(c: Catalogue) -> DataFrame:
    """One row per content of a search with its number of copies."""
    found = _found(c, "path:e", dedupe=True)
    md5 = c.files_of("md5").select(F.col("id").alias("row_id"), F.coalesce("md5", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("content"))
    return found.join(md5, "row_id").select("content", F.col("detail").alias("copies"))
