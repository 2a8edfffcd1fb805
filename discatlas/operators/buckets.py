"""Search over the whole catalogue: every family of keys, results in three buckets with totals and pages.

Files: keys of the file, of a module in it and of a movie in it describe one
file, so they refine each other. Artefacts: partitions, protection, mastering,
tags, hashes and words are searches of their own whose results lie side by side;
catalogue items are found by words. Values of one key are alternatives. A
negated key counts only where its family has a wanted key, movies have none; a
negation keeps rows without a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discatlas.functions import hashes, text
from discatlas.operators import search
from discatlas.operators.search import Query, null_safe_not, numeric

Builder = Callable[[str], Column]


def _element(column: str) -> Builder:
    """An element of an array equals a value; one with a wildcard is sought anywhere in it."""

    def build(value: str) -> Column:
        pattern = text.like_exact(value)
        pattern = f"%{pattern.strip('%')}%" if "%" in pattern else pattern
        return F.exists(column, lambda x: F.coalesce(x.ilike(pattern), F.lit(False)))

    return build


def _substring(column: str) -> Builder:
    return lambda v: F.col(column).ilike(text.like_search(v))


def _number(column: str) -> Builder:
    return lambda v: numeric(F.col(column), v)


def _file_system(value: str) -> Column:
    return F.lower("filesystem") == value.lower() if value.lower() in FILE_SYSTEMS else F.col("container_format").ilike(text.like_search(value))


def _words(*columns: str) -> Builder:
    return lambda v: reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{v}%"), F.lit(False)) for c in columns))


# File systems that fs: names; other values are sought in the container's format.
FILE_SYSTEMS = ("fat12", "fat16", "fat32", "ntfs", "hpfs", "hfs", "hfs_plus", "adfs", "dfs", "amiga_ofs", "amiga_ffs", "iso9660", "cdfs", "cpm", "archive", "unknown", "other")

FILE = {key: build for key, (table, build) in search.BUILDERS.items() if table == "file"}
MODULE: dict[str, Builder] = {
    "module": lambda v: F.col("title_string").ilike(text.like_exact(v)) | F.coalesce(F.col("help_title").ilike(text.like_exact(v)), F.lit(False)),
    "command": _element("commands"),
    "swi": _element("swi_names"),
}
REPLAY: dict[str, Builder] = {
    "replay_title": _substring("title"),
    "replay_author": _substring("author"),
    "replay_copyright": _substring("copyright"),
    "replay_vformat": _number("video_format"),
    "replay_sformat": _number("sound_format"),
    "replay_width": _number("width"),
    "replay_height": _number("height"),
    "replay_framerate": _number("frame_rate"),
    "replay_duration": _number("duration_seconds"),
}
DISC: dict[str, Builder] = {"label": _substring("partition_label"), "ident": _substring("gnu_file_type"), "fs": _file_system}
HASH: dict[str, Builder] = {"md5": lambda v: hashes.hash_matches("artefact_md5", v, 32), "sha256": lambda v: hashes.hash_matches("artefact_sha256", v, 64)}
KEYS = {*FILE, *MODULE, *REPLAY, *DISC, *HASH, "protection", "mastering", "tag", "text"}

#: Keys whose wanted terms admit each other's negations.
FAMILIES = (set(FILE), set(DISC), set(HASH), set(REPLAY), {"protection"}, {"mastering"}, {"module"}, {"command"}, {"swi"}, {"tag"}, {"text"})

#: Columns of each table that a search may read; those that a table lacks are null.
COLUMNS = {
    "files": {"id": "long", "partition_id": "long", "path": "string", "filename": "string", "extension": "string", "file_size": "long", "md5": "string", "sha1": "string", "sha256": "string", "risc_os_filetype": "string", "is_directory": "boolean", "extraction_depth": "int"},
    "partitions": {"id": "long", "artefact_id": "long", "partition_index": "int", "label": "string", "filesystem": "string", "gnu_file_type": "string", "container_format": "string"},
    "artefacts": {"id": "long", "item_id": "long", "label": "string", "description": "string", "md5": "string", "sha256": "string"},
    "items": {"id": "long", "name": "string", "description": "string"},
    "modules": {"artefact_id": "long", "file_path": "string", "title_string": "string", "help_title": "string", "commands": "array<string>", "swi_names": "array<string>"},
    "movies": {"artefact_id": "long", "file_path": "string", "title": "string", "author": "string", "copyright": "string", "video_format": "long", "sound_format": "long", "width": "long", "height": "long", "frame_rate": "double", "duration_seconds": "double"},
    "protections": {"artefact_id": "long", "kind": "string"},
    "masterings": {"artefact_id": "long", "kind": "string"},
    "tags": {"artefact_id": "long", "tag": "string"},
}


@dataclass
class Tables:
    """Tables of a catalogue by name, each made only if a search needs it."""

    make: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in COLUMNS:
            raise AttributeError(name)
        df = self.make[name]()
        return df.select(*((F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c)) for c, kind in COLUMNS[name].items()))


def family(query: Query, builders: dict[str, Builder], negations: str = "family", any_key: bool = False) -> Column | None:
    """The predicate of one family of keys, None without a wanted key.

    negations: "family" lets any wanted key of the family admit its negations,
    "key" only the same key, "none" ignores them.
    """
    wanted = [k for k in builders if query.wanted.get(k)]
    if not wanted:
        return None
    parts = [reduce(lambda a, b: a | b, (builders[k](v) for v in query.wanted[k])) for k in wanted]
    if any_key:
        parts = [reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), parts)]
    against = {"family": list(builders), "key": wanted, "none": []}[negations]
    parts += [null_safe_not(builders[k](v)) for k in against for v in query.unwanted.get(k, [])]
    return reduce(lambda a, b: a & b, parts)


def problems(query: Query) -> list[str]:
    """Warnings about a query: what `search.problems` finds, and negations without effect."""
    out = search.problems(query, KEYS | set(search.BUILDERS))
    wanted = {k for k, values in query.wanted.items() if values} | ({"text"} if query.words else set())
    idle = [k for k in query.unwanted if k in KEYS and not any(k in keys and keys & wanted for keys in FAMILIES)]
    return out + [f"!{k} has no effect without a term of its kind" for k in sorted(idle)]


def _places(t: Tables) -> DataFrame:
    """artefact_id, item_id, label and the names by which results are ordered."""
    items = t.items.select(F.col("id").alias("item_id"), F.lower("name").alias("order_item"))
    artefacts = t.artefacts.select(F.col("id").alias("artefact_id"), "item_id", F.lower("label").alias("order_artefact"), F.col("label").alias("artefact_label"), F.col("description").alias("artefact_description"), F.col("md5").alias("artefact_md5"), F.col("sha256").alias("artefact_sha256"))
    return artefacts.join(items, "item_id")


def _result(df: DataFrame, bucket: str, kind: str, row: str, detail: Column, order: Column) -> DataFrame:
    return df.select(F.lit(bucket).alias("bucket"), F.lit(kind).alias("kind"), F.col(row).cast("long").alias("row_id"), "artefact_id", "item_id", detail.cast("string").alias("detail"), "order_item", "order_artefact", order.cast("string").alias("order_last"))


def _files(query: Query, t: Tables, dedupe: bool) -> DataFrame | None:
    own, module, movie = family(query, FILE), family(query, MODULE, "key"), family(query, REPLAY, "none")
    if own is None and module is None and movie is None:
        return None
    rows = t.files.where("is_directory IS NULL OR NOT is_directory")
    rows = rows if own is None else rows.where(own)
    rows = rows.select(F.col("id").alias("file_id"), "partition_id", "path", "md5", "sha1", "sha256")
    rows = rows.join(t.partitions.select(F.col("id").alias("partition_id"), "artefact_id"), "partition_id").join(_places(t).select("artefact_id", "item_id", "order_item", "order_artefact"), "artefact_id")
    for table, found in (("modules", module), ("movies", movie)):
        if found is not None:
            held = getattr(t, table).where(found).select("artefact_id", F.col("file_path").alias("path")).distinct()
            rows = rows.join(held, ["artefact_id", "path"], "left_semi")
    if dedupe:
        at = F.struct("order_item", "order_artefact", F.lower("path").alias("order_path"), "file_id", "artefact_id", "item_id", "path")
        rows = rows.groupBy(F.coalesce("sha256", "sha1", "md5", F.concat(F.lit("id:"), F.col("file_id").cast("string"))).alias("content")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("copies"))
        rows = rows.select("first.*", "copies")
        return _result(rows, "files", "file", "file_id", F.col("copies"), F.lower("path"))
    return _result(rows, "files", "file", "file_id", F.lit(None), F.lower("path"))


def _of_artefacts(query: Query, t: Tables, key: str, table: str, column: str, kind: str) -> DataFrame | None:
    """One row per artefact with a value of a list of its own."""
    found = family(query, {key: lambda v: F.lower(column) == v.lower()})
    if found is None:
        return None
    held = getattr(t, table).where(found).groupBy("artefact_id").agg(F.min(column).alias("detail"))
    return _result(held.join(_places(t), "artefact_id"), "artefacts", kind, "artefact_id", F.col("detail"), F.col("detail"))


def found(text_query: str, t: Tables, dedupe: bool = False) -> list[DataFrame]:
    """The results of every kind that a query asks for: bucket, kind, row_id, artefact_id, item_id, detail and order columns.

    row_id is the file, partition, artefact or item; with dedupe files of equal
    content are one row whose detail is the number of copies. A query without
    wanted keys or words finds nothing.
    """
    query = search.parse(text_query)
    words = Query({"text": query.words} if query.words else {}, query.unwanted, [])
    out = [_files(query, t, dedupe)]
    if (disc := family(query, DISC)) is not None:
        rows = t.partitions.withColumnRenamed("label", "partition_label").where(disc).select(F.col("id").alias("partition_id"), "artefact_id", "partition_index", "partition_label")
        out.append(_result(rows.join(_places(t), "artefact_id"), "artefacts", "partition", "partition_id", F.col("partition_label"), F.lpad(F.col("partition_index").cast("string"), 10, "0")))
    out.append(_of_artefacts(query, t, "protection", "protections", "kind", "protection"))
    out.append(_of_artefacts(query, t, "mastering", "masterings", "kind", "mastering"))
    if (tag := family(query, {"tag": _substring("tag")})) is not None:
        out.append(_result(t.tags.where(tag).join(_places(t), "artefact_id"), "artefacts", "tag", "artefact_id", F.col("tag"), F.col("tag")))
    if (held := family(query, HASH, any_key=True)) is not None:
        out.append(_result(_places(t).where(held), "artefacts", "hash", "artefact_id", F.lit(None), F.lit(None)))
    for bucket, kind, columns in (("items", "item", ("name", "description")), ("artefacts", "text", ("artefact_label", "artefact_description"))):
        if words.wanted:
            build = _words(*columns)
            every = reduce(lambda a, b: a & b, [*map(build, query.words), *(null_safe_not(build(v)) for v in query.unwanted.get("text", []))])
            if bucket == "items":
                rows = t.items.where(every).select(F.col("id").alias("item_id"), F.lit(None).cast("long").alias("artefact_id"), F.lower("name").alias("order_item"), F.lit(None).cast("string").alias("order_artefact"))
                out.append(_result(rows, bucket, kind, "item_id", F.lit(None), F.lit(None)))
            else:
                out.append(_result(_places(t).where(every), bucket, kind, "artefact_id", F.lit(None), F.lit(None)))
    return [df for df in out if df is not None]


def totals(results: list[DataFrame], spark) -> DataFrame:
    """Rows per bucket, all three: bucket, n. Kinds that find the same artefact are both counted."""
    none = spark.createDataFrame([(b,) for b in ("files", "artefacts", "items")], "bucket string").withColumn("n", F.lit(0).cast("long"))
    counted = reduce(lambda a, b: a.unionByName(b), (df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")) for df in results), none)
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def page(results: list[DataFrame], number: int, size: int = 50) -> DataFrame | None:
    """One page of every kind, from 1, and in has_more whether the kind goes on; None without results.

    Each kind is ordered by item, artefact and its last order column, and one row
    more than the page is asked for; that many rows meet in one task, no more.
    """
    parts = []
    for df in results:
        order = [F.col(c).asc_nulls_last() for c in ("order_item", "order_artefact", "order_last", "row_id", "detail")]
        asked = df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size + 1)
        listed = asked.groupBy().agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
        shown = listed.select(F.explode(F.slice("rows", 1, size)).alias("row"), (F.size("rows") > size).alias("has_more"))
        parts.append(shown.select("row.*", "has_more"))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None
