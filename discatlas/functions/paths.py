"""Paths as text: parents, base names, ancestors, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parent(path: Column | str) -> Column:
    """What is before the last slash; empty at the top."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def depth(path: Column | str) -> Column:
    """Number of segments; 0 for the empty path."""
    return F.when(_col(path) == "", 0).otherwise(F.size(F.split(_col(path), "/")))


def ancestors(path: Column | str, most: int | None = None) -> Column:
    """All directories above a path, shallowest first, at most `most` of them."""
    parts = F.split(_col(path), "/")
    count = F.size(parts) - 1
    count = F.least(count, F.lit(most)) if most else count
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def breadcrumb(path: Column | str) -> Column:
    """(name, path) of every segment from the top to the path itself."""
    parts = F.filter(F.split(_col(path), "/"), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.element_at(parts, n).alias("name"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path")))).otherwise(F.array().cast("array<struct<name:string,path:string>>"))


def child_segment(path: Column | str, folder: str) -> Column:
    """The segment right below a folder ('' is the top), null if the path is not below it."""
    prefix = f"{folder}/" if folder else ""
    rest = F.substring(_col(path), F.lit(len(prefix) + 1), F.length(_col(path)))
    return F.when(_col(path).startswith(prefix), F.nullif(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit("")))


def app_folder(path: Column | str) -> Column:
    """The path down to the first segment that begins with '!', which marks an application; null if there is none."""
    return F.nullif(F.regexp_extract(_col(path), r"^((?:[^/]*/)*?![^/]+)(?:/|$)", 1), F.lit(""))


def app_directory(path: Column | str) -> Column:
    """The shallowest directory above a path whose own name begins with '!'; null if there is none."""
    parts = F.split(_col(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    nth = F.array_position(F.transform(folders, lambda s: F.startswith(s, F.lit("!"))), F.lit(True))
    return F.when(nth > 0, F.array_join(F.slice(folders, F.lit(1), nth.cast("int")), "/"))


def is_child_of(path: Column | str, folder: Column | str) -> Column:
    """Whether the path lies directly in the folder; the root folder is '/'."""
    return F.when(parent(path) == "", F.lit("/")).otherwise(parent(path)) == _col(folder)


def suffix_type(name: Column | str) -> tuple[Column, Column]:
    """(name, file type) of names written as name,xxx with three hexadecimal digits."""
    c = _col(name)
    kind = F.nullif(F.lower(F.regexp_extract(c, r",([0-9A-Fa-f]{3})$", 1)), F.lit(""))
    return F.when(kind.isNotNull(), F.substring(c, F.lit(1), F.length(c) - 4)).otherwise(c), kind


def translate_name(name: Column | str, to_dos: bool = True) -> Column:
    """Characters that the BBC and DOS file systems write differently, exchanged."""
    bbc, dos = "#$^&%@?/.", "?<>+;=#./"
    return F.translate(_col(name), bbc if to_dos else dos, dos if to_dos else bbc)


def glob(pattern: str) -> str:
    """A regular expression for a shell pattern, anchored, ignoring case; without wildcards it searches anywhere."""
    import re

    if not set(pattern) & set("*?"):
        pattern = f"*{pattern}*"
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
