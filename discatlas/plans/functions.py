"""Queries over text formats, parsers and the reading and writing of reference databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import formats, paths, scripts, text
from discatlas.operators import buckets, known, search, sinks
from discatlas.plans.known import KNOWN, reference
from discatlas.runtime import scratch
from discatlas.sources import files as sources

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_IN = ", ".join


def _quoted(values) -> str:
    return _IN(f"'{v}'" for v in values)


@R.query(r""", n AS (SELECT id, CASE WHEN filename LIKE '% %' THEN '"' || filename || '"' ELSE filename END AS shown, filename, lower(risc_os_filetype) AS t, file_size FROM f WHERE regexp_full_match(filename, '[A-Za-z0-9!._ ]+') AND filename = trim(filename) AND regexp_full_match(risc_os_filetype, '[0-9A-Fa-f]{3}') AND file_size IS NOT NULL)
SELECT id AS file_id, filename AS name, 'fff' || t || '40' AS load, lpad(lower(to_hex(id)), 8, '0') AS exec, file_size AS length, 'WR/r' AS access, t AS filetype, make_timestamp((64::BIGINT * 4294967296 + id) * 10000 - 2208988800000000) AS modified FROM n""")
def fun09_inf_lines(c: Catalogue) -> DataFrame:
    """INF lines of all files, written and read again: name, addresses, length, access, type and time."""
    files = c.files_of("filename", "risc_os_filetype", "file_size").where(r"filename RLIKE '^[A-Za-z0-9!._ ]+$' AND filename = trim(filename) AND risc_os_filetype RLIKE '^[0-9A-Fa-f]{3}$' AND file_size IS NOT NULL")
    name = F.when(F.col("filename").contains(" "), F.concat(F.lit('"'), "filename", F.lit('"'))).otherwise(F.col("filename"))
    line = F.concat_ws(" ", name, F.concat(F.lit("FFF"), "risc_os_filetype", F.lit("40")), F.hex("id"), F.hex("file_size"), F.lit("WR/r"))
    return files.select(F.col("id").alias("file_id"), scripts.inf_columns(line).alias("f")).select("file_id", "f.*")


@R.query(r""", n AS (SELECT id, regexp_extract(path, '^.*![^/]+/(.*)$', 1) AS rest FROM f WHERE NOT is_directory AND path LIKE '%!%')
SELECT id AS file_id, lower(replace(rest, '.', '/')) AS target FROM n WHERE regexp_full_match(rest, '[A-Za-z0-9!./]+') AND rest NOT LIKE '.%'""")
def gen01_launched_files(c: Catalogue) -> DataFrame:
    """What a launch script written for every file of an application starts, with the variable set by its boot script."""
    rest = F.regexp_extract("path", r"^.*![^/]+/(.*)$", 1)
    files = c.files_of("path", "is_directory").where("NOT is_directory AND path LIKE '%!%'").select(F.col("id").alias("file_id"), rest.alias("rest")).where("rest RLIKE '^[A-Za-z0-9!./]+$' AND NOT startswith(rest, '.')")
    dotted = F.replace("rest", F.lit("/"), F.lit("."))
    run = F.concat(F.lit("| starts\nSet Lib$Dir <App$Dir>\nRMEnsure Lib 1.0 Run <Other$Dir>.x\n*Run <Lib$Dir>."), dotted, F.lit(" %*0\n"))
    started = scripts.launched_column(run, F.lit("Set App$Dir <Obey$Dir>"))
    return files.select("file_id", started.alias("targets")).select("file_id", F.explode("targets").alias("target"))


@R.query(rf""", n AS (SELECT id, original_filename AS path, lower(original_filename) AS low, regexp_replace(lower(original_filename), '\.({"|".join(formats.COMPRESSORS)})$', '') AS bare FROM a WHERE original_filename IS NOT NULL),
e AS (SELECT *, regexp_extract(bare, '\.([a-z0-9]+)$', 1) AS ext FROM n)
SELECT path, ext AS raw_type, CASE WHEN ext IN ({_quoted(k for k, v in formats.IMAGE_TYPES.items() if v == "ARCHIVE")}) THEN 0 WHEN low <> bare THEN 1 ELSE 2 END AS form, count(*) AS n FROM e WHERE ext IN ({_quoted(formats.IMAGE_TYPES)}) GROUP BY ALL""")
def src06_importable_files(c: Catalogue) -> DataFrame:
    """Images and archives among the names of uploads, with their form."""
    names = c.artefacts.where("original_filename IS NOT NULL").select(F.col("original_filename").alias("path"))
    return sources.importable(names).groupBy("path", "raw_type", "form").agg(F.count(F.lit(1)).alias("n"))


def _database(c: Catalogue) -> DataFrame:
    return reference(c).select("product", F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), "md5", "size", "rel_path", "required")


_DB = KNOWN + " SELECT product, 'f' || id AS filename, lower(trim(md5)) AS md5, size AS file_size, rel_path AS relative_path, required AS is_required FROM kf WHERE trim(product) <> ''"


@R.query(_DB)
def src07_database_json(c: Catalogue) -> DataFrame:
    """The catalogue's reference database written as JSON documents, one per product, and read again."""
    file = F.struct("filename", "md5", F.col("size").alias("file_size"), F.col("rel_path").alias("relative_path"), F.col("required").alias("is_required"))
    products = _database(c).groupBy("product").agg(F.collect_list(file).alias("files"))
    path = scratch(c.spark, "database-json")
    products.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("db").alias("name"), F.array(F.struct(F.col("product").alias("title"), "files")).alias("products")))).write.text(path)
    read = c.spark.read.schema(sources.DATABASE).json(path)
    return sources.database_files(read).select("product", "filename", "md5", "file_size", "relative_path", "is_required")


@R.query(_DB)
def src08_database_csv(c: Catalogue) -> DataFrame:
    """The catalogue's reference database written as CSV and read again."""
    path = scratch(c.spark, "database-csv")
    none = F.lit(None).cast("string")
    rows = _database(c).select(F.col("product").alias("product_title"), "filename", "md5", none.alias("sha1"), none.alias("sha256"), F.col("size").alias("file_size"), F.col("rel_path").alias("relative_path"), F.col("required").cast("int").alias("is_required"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    read = sources.database_csv(c.spark, path, "db")
    return read.select("product", "filename", "md5", "file_size", "relative_path", "is_required")


@R.query(KNOWN + ", tg AS (SELECT * FROM kf WHERE id % 2 = 0), ks AS (SELECT DISTINCT product, lower(md5) AS md5 FROM kf) SELECT ks.product, ks.md5 FROM ks WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.product = ks.product AND tg.md5 = ks.md5)")
def lnk06_new_known_files(c: Catalogue) -> DataFrame:
    """Rows of an import that a database of half the files lacks, once per product and hash."""
    rows = reference(c).select("product", F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), "md5", F.lit(None).cast("string").alias("sha1"), "id")
    return sources.import_new(rows.where("id % 2 = 0"), rows).select("product", "md5")


@R.query(" SELECT platform, CASE WHEN id % 3 = 0 THEN name || '!' ELSE name END AS name FROM i WHERE platform IN (SELECT platform FROM i WHERE id % 3 = 0) OR (platform IS NOT NULL AND id % 3 <> 0)")
def snk02_replaced_partitions(c: Catalogue) -> DataFrame:
    """A table by platform in which the platforms of some rows are written anew, all others kept."""
    path = scratch(c.spark, "items")
    items = c.items.where("platform IS NOT NULL").select("id", "name", "platform")
    items.write.partitionBy("platform").parquet(path)
    touched = items.where("id % 3 = 0").select("platform").distinct()
    anew = items.join(touched, "platform", "left_semi").withColumn("name", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    sinks.replace_scope(anew.select("id", "name", "platform"), path, ["platform"])
    return c.spark.read.schema("id long, name string, platform string").parquet(path).select("platform", "name")


#: Queries with what is to be said of them.
WARNED = {
    "filename:a !type:Text": 0, "!type:Text": 2, "type:Nonsense": 1, "md5:xyz sha1:0": 1, "sha256:*": 1, "nokey:1 name:a": 1,
    "tag:a !label:b": 1, "disc:a !fs:adfs": 0, "module:a !swi:b": 1, "words !text:more": 0, "replaywidth:>=3 !replaytitle:x": 0,
}


@R.query(" SELECT * FROM (VALUES " + _IN(f"('{q}', {n})" for q, n in WARNED.items()) + ") AS t(query, n_warnings)")
def flt15_query_warnings(c: Catalogue) -> DataFrame:
    """Number of warnings about each of some queries."""
    return c.spark.createDataFrame([(q, len(buckets.problems(search.parse(q)))) for q in WARNED], "query string, n_warnings int")


@R.query(" SELECT 'ext:txt' AS query, count(*) AS n FROM f WHERE NOT is_directory AND lower(extension) = 'txt' UNION ALL SELECT '!ext:txt', 0 UNION ALL SELECT 'words only', 0 UNION ALL SELECT '', 0 UNION ALL SELECT 'filename:* !ext:txt !type:Text !size:>100', count(*) FROM f WHERE NOT is_directory AND filename IS NOT NULL AND coalesce(lower(extension) <> 'txt', true) AND coalesce(lower(risc_os_filetype) <> 'fff', true) AND coalesce(file_size <= 100, true)")
def flt16_negative_only(c: Catalogue) -> DataFrame:
    """Files that queries find which are all negative, empty, words only, or have several negations."""
    from discatlas.plans.search import found

    asked = ("ext:txt", "!ext:txt", "words only", "", "filename:* !ext:txt !type:Text !size:>100")
    return reduce(lambda a, b: a.unionByName(b), (found(c, q).agg(F.count(F.lit(1)).alias("n")).select(F.lit(q).alias("query"), "n") for q in asked))


_LITERALS = ("_", "%", "a%", "\\", "/!", "50%")


@R.query(" SELECT v, count(*) FILTER (WHERE contains(d.text, v)) AS n FROM documents d, (VALUES " + _IN(f"('{v}')" for v in _LITERALS) + ") AS t(v) GROUP BY v")
def fun04_literal_patterns(c: Catalogue) -> DataFrame:
    """Documents that hold a text with wildcards in it, by escaped patterns in one pass."""
    counts = c.documents.agg(*(F.count_if(F.col("text").like(f"%{text.like_literal(v)}%")).alias(str(i)) for i, v in enumerate(_LITERALS)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(f"`{i}`").alias("n")) for i, v in enumerate(_LITERALS)))).alias("r")).select("r.*")


@R.query(" SELECT id AS file_id, filename AS name, lower(risc_os_filetype) AS kind FROM f WHERE filename IS NOT NULL AND regexp_full_match(risc_os_filetype, '[0-9A-Fa-f]{3}')")
def fun06_suffixed_names(c: Catalogue) -> DataFrame:
    """Names written with their type as a suffix, taken apart again."""
    files = c.files_of("filename", "risc_os_filetype").where("filename IS NOT NULL AND risc_os_filetype RLIKE '^[0-9A-Fa-f]{3}$'")
    name, kind = paths.suffix_type(F.concat_ws(",", "filename", "risc_os_filetype"))
    return files.select(F.col("id").alias("file_id"), name.alias("name"), kind.alias("kind"))


@R.query(" SELECT id AS file_id, CASE WHEN file_size % 2 = 0 THEN file_size * 1024 ELSE file_size * 3 * 524288 END AS n_bytes FROM f WHERE file_size < 1000000")
def fun18_parsed_sizes(c: Catalogue) -> DataFrame:
    """Sizes written with units, whole and with a fraction, read again."""
    files = c.files_of("file_size").where("file_size < 1000000")
    shown = F.when(F.col("file_size") % 2 == 0, F.concat(F.col("file_size").cast("string"), F.lit(" KB"))).otherwise(F.concat((F.col("file_size") * 3 / 2).cast("decimal(20,1)").cast("string"), F.lit("m")))
    return files.select(F.col("id").alias("file_id"), text.parse_size(shown).alias("n_bytes"))


@R.query(" SELECT id AS file_id, least(greatest(file_size % 300 - 100, 0), 100)::BIGINT AS percent FROM f WHERE file_size IS NOT NULL")
def fun19_clamped_percent(c: Catalogue) -> DataFrame:
    """Numbers brought between 0 and 100."""
    return c.files_of("file_size").where("file_size IS NOT NULL").select(F.col("id").alias("file_id"), text.clamp_percent(F.col("file_size") % 300 - 100).cast("long").alias("percent"))


_RULES = [(".* set", "set"), ("[a-m].*", "first half"), (".*k", "ends in k")]


@R.query(" SELECT id AS item_id, CASE " + " ".join(f"WHEN regexp_full_match(name, '(?i){p}') THEN '{v}'" for p, v in _RULES) + " END AS source FROM i WHERE name IS NOT NULL")
def fun26_canonical_sources(c: Catalogue) -> DataFrame:
    """Items by the first rule that their name fits."""
    return known.canonical_source(c.items.where("name IS NOT NULL").select(F.col("id").alias("item_id"), "name"), "name", _RULES).select("item_id", "source")


@R.query(r""", t AS (SELECT id, label || ', ' || coalesce(artefact_type, '') || ',,  x ,' AS tags FROM a WHERE label IS NOT NULL), s AS (SELECT id, list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM t) SELECT id AS artefact_id, len(l) AS n, array_to_string(l, '|') AS tags FROM s""")
def fun38_tag_lists(c: Catalogue) -> DataFrame:
    """Comma-separated tags of every artefact."""
    tags = text.tag_list(F.concat("label", F.lit(", "), F.coalesce("artefact_type", F.lit("")), F.lit(",,  x ,")))
    return c.artefacts.where("label IS NOT NULL").select(F.col("id").alias("artefact_id"), F.size(tags).cast("long").alias("n"), F.array_join(tags, "|").alias("tags"))


@R.query(" SELECT id AS analysis_id, CASE id % 25 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in formats.CODECS.items()) + " ELSE 'codec ' || (id % 25) END AS codec FROM an")
def fun40_codec_names(c: Catalogue) -> DataFrame:
    """Names of codec numbers."""
    return c.analyses.select(F.col("id").alias("analysis_id"), formats.codec_name(F.col("id") % 25).alias("codec"))


_C1 = {chr(0x80 + i): t for i, t in enumerate(bytes(range(0x80, 0xA0)).decode("cp1252", "replace")) if t != "�"}


@R.query(" SELECT id AS file_id, filename || chr(8217) || chr(8364) || 'x' AS name FROM f WHERE filename IS NOT NULL AND NOT regexp_matches(filename, '[\\x{80}-\\x{9f}]')")
def fun43_control_characters(c: Catalogue) -> DataFrame:
    """Names in which characters of a code page were left as control characters, repaired."""
    files = c.files_of("filename").where(r"filename IS NOT NULL AND NOT filename RLIKE '[\\x{80}-\\x{9f}]'")
    return files.select(F.col("id").alias("file_id"), text.latin1_repair(F.concat("filename", F.lit("\x92\x80x"))).alias("name"))


@R.query(r""", m AS (SELECT id, partition_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM f WHERE NOT is_directory AND path IS NOT NULL), im AS (SELECT *, lower(regexp_replace(name, '\.[A-Za-z0-9]+$', '')) AS base FROM m)
SELECT DISTINCT im.path AS image, s.path AS sidecar FROM im JOIN m s ON s.folder = im.folder WHERE im.path <> s.path AND starts_with(lower(s.name), im.base) AND regexp_matches(lower(s.name), '\.(txt|nfo|md|jpg|jpeg|png|log)$')""")
def fun33_sidecar_names(c: Catalogue) -> DataFrame:
    """Text and picture files beside a file whose name they begin with."""
    files = c.files_of("path", "is_directory").where("NOT is_directory AND path IS NOT NULL").select("path").distinct()
    images = files.withColumn("base", F.regexp_replace(paths.basename("path"), r"\.[A-Za-z0-9]+$", ""))
    return sources.sidecars(images, files)
