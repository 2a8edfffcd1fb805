"""The search language: terms to predicates, predicates to plans.

A query is a list of terms: `key:value`, `key:"quoted value"`, `!key:value` for
"not", and bare words. Values of one key are alternatives, different keys must
all hold. `*` is a wildcard. Only the tables that the keys need are joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discatlas.functions import formats, hashes, text

# Other names of keys.
ALIASES = {
    "name": "filename", "file": "filename", "type": "filetype", "extension": "ext", "filesystem": "fs", "disc": "label", "gnu": "ident", "gnufile": "ident", "prot": "protection",
    "replaytitle": "replay_title", "replayauthor": "replay_author", "replaycopyright": "replay_copyright",
    "replayvideoformat": "replay_vformat", "replayvideocodec": "replay_vformat", "replaycodec": "replay_vformat", "replaysoundformat": "replay_sformat",
    "replaywidth": "replay_width", "replayheight": "replay_height", "replayframerate": "replay_framerate", "replayduration": "replay_duration",
}
_TERM = re.compile(r'(!?)(\w+):(?:"([^"]*)"|(\S+))|"([^"]*)"|(\S+)')


@dataclass
class Query:
    """A parsed query: wanted and unwanted values per key, and bare words."""

    wanted: dict[str, list[str]] = field(default_factory=dict)
    unwanted: dict[str, list[str]] = field(default_factory=dict)
    words: list[str] = field(default_factory=list)

    @property
    def keys(self) -> set[str]:
        return {*self.wanted, *self.unwanted}


def parse(query: str) -> Query:
    """Terms of a query; an exclamation mark negates keyed terms only and belongs to a bare word."""
    out = Query()
    for negated, key, quoted, bare, phrase, word in _TERM.findall(query or ""):
        if key:
            value = quoted or bare
            if value:
                name = ALIASES.get(key.lower(), key.lower())
                (out.unwanted if negated else out.wanted).setdefault(name, []).append(value)
        elif phrase or word:
            out.words.append(phrase or word)
    return out


def numeric(c: Column, value: str) -> Column:
    """Comparisons n, >n, >=n, <n, <=n, a..b, a.. and ..b; false for anything else."""
    value = value.strip()
    number = r"(-?\d+(?:\.\d+)?)"
    if found := re.fullmatch(rf"{number}?\.\.{number}?", value):
        low, high = found.groups()
        if low is None and high is None:
            return F.lit(False)
        parts = ([c >= float(low)] if low else []) + ([c <= float(high)] if high else [])
        return reduce(lambda a, b: a & b, parts)
    if found := re.fullmatch(rf"(>=|<=|>|<)?\s*{number}", value):
        op, n = found.group(1), float(found.group(2))
        return {">=": c >= n, "<=": c <= n, ">": c > n, "<": c < n, None: c == n}[op]
    return F.lit(False)


def _filetype(value: str) -> Column:
    codes = formats.filetype_codes(value)
    return F.lower("risc_os_filetype").isin(codes) if codes else F.lit(False)


#: Key -> (table it needs, predicate of a value).
BUILDERS: dict[str, tuple[str, Callable[[str], Column]]] = {
    "filename": ("file", lambda v: F.col("filename").ilike(text.like_exact(v))),
    "path": ("file", lambda v: F.col("path").ilike(text.like_search(v))),
    "ext": ("file", lambda v: F.lower("extension") == v.lower().lstrip(".")),
    "filetype": ("file", _filetype),
    "md5": ("file", lambda v: hashes.hash_matches("md5", v, 32)),
    "sha1": ("file", lambda v: hashes.hash_matches("sha1", v, 40)),
    "sha256": ("file", lambda v: hashes.hash_matches("sha256", v, 64)),
    "size": ("file", lambda v: numeric(F.col("file_size"), v)),
    "depth": ("file", lambda v: numeric(F.col("extraction_depth"), v)),
    "fs": ("partition", lambda v: F.upper("filesystem") == v.upper()),
    "volume": ("partition", lambda v: F.col("partition_label").ilike(text.like_search(v))),
    "label": ("artefact", lambda v: F.col("label").ilike(text.like_search(v))),
    "artefact": ("artefact", lambda v: F.upper("artefact_type") == v.upper()),
    "item": ("item", lambda v: F.col("item_name").ilike(text.like_search(v))),
    "platform": ("item", lambda v: F.lower("platform") == v.lower()),
}
TABLES = ("file", "partition", "artefact", "item")


def null_safe_not(condition: Column) -> Column:
    """True where the condition is false or null: rows without a value aren't lost by negation."""
    return ~F.coalesce(condition, F.lit(False))


def clause(query: Query, tables: tuple[str, ...] = TABLES) -> Column | None:
    """The predicate of the keys of some tables; None if no key of them is wanted."""
    wanted = [reduce(lambda a, b: a | b, (BUILDERS[k][1](v) for v in values)) for k, values in query.wanted.items() if k in BUILDERS and BUILDERS[k][0] in tables]
    if not wanted:
        return None
    unwanted = [null_safe_not(BUILDERS[k][1](v)) for k, values in query.unwanted.items() if k in BUILDERS and BUILDERS[k][0] in tables for v in values]
    return reduce(lambda a, b: a & b, wanted + unwanted)


#: Hexadecimal digits of a whole hash.
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}


def problems(query: Query, known: set[str] | None = None) -> list[str]:
    """Warnings about a query: unknown keys, negation only, odd hashes and file types."""
    out = [f"unknown key {k}" for k in sorted(query.keys - (known or set(BUILDERS)))]
    if query.unwanted and not query.wanted and not query.words:
        out.append("a query needs a term that isn't negated")
    for key, values in [*query.wanted.items(), *query.unwanted.items()]:
        for value in values:
            if key in HASH_LENGTHS and (len(value) > HASH_LENGTHS[key] or not re.fullmatch(r"[0-9a-fA-F]+", value)):
                out.append(f"{value} is no {key}")
            if key == "filetype" and not formats.filetype_codes(value):
                out.append(f"{value} is no file type")
    return out


def star(query: Query, files: DataFrame, partitions: DataFrame, artefacts: DataFrame, items: DataFrame) -> DataFrame:
    """Files joined with as many of their partition, artefact and item as the query's keys need."""
    needed = {BUILDERS[k][0] for k in query.keys if k in BUILDERS}
    out = files.where("is_directory IS NULL OR NOT is_directory")
    out = out.select("*", *(F.lit(None).cast("string").alias(c) for c in ("sha1", "sha256") if c not in out.columns))
    if needed & {"partition", "artefact", "item"}:
        out = out.join(partitions.select(F.col("id").alias("partition_id"), "artefact_id", "filesystem", F.col("label").alias("partition_label")), "partition_id")
    if needed & {"artefact", "item"}:
        out = out.join(artefacts.select(F.col("id").alias("artefact_id"), "item_id", "label", "artefact_type"), "artefact_id")
    if "item" in needed:
        out = out.join(items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), "platform"), "item_id")
    return out


def search_files(text_query: str, files: DataFrame, partitions: DataFrame, artefacts: DataFrame, items: DataFrame) -> DataFrame:
    """Files that a query finds; a query without wanted keys finds none."""
    query = parse(text_query)
    found = clause(query)
    return star(query, files, partitions, artefacts, items).where(F.lit(False) if found is None else found)


def fold(found: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row per content: hkey, id of the first row in the order, n copies. Rows are reduced by partial aggregation, not in a window."""
    at = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))))
    return found.select(key.alias("hkey"), at.alias("at")).groupBy("hkey").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).select("hkey", F.col(f"at.{order[-1]}").alias("id"), "n")


def search_words(words: list[str], rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every word occurs in one of the columns, ignoring case; * is an ordinary character here."""
    for word in words:
        pattern = f"%{text.like_literal(word)}%"
        rows = rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns)))
    return rows
