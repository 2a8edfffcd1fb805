"""Small text formats of the Acorn world: INF side files, by built-in expressions, and launch scripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from discatlas.functions import formats


def inf_columns(line: Column | str) -> Column:
    """INF lines as struct<name, load, exec, length, access, filetype, modified>; null where the line is none.

    A line is a name, in quotes if it has spaces, load and exec address in
    hexadecimal, then length and access as far as they are there. A hexadecimal
    number that stands alone after the addresses is the length; anything else is
    the access. Addresses are widened to eight digits; file type and time are
    those of dated files.
    """
    text = F.btrim(F.regexp_replace(line if isinstance(line, Column) else F.col(line), r"\s+", " "))
    quoted = text.startswith('"')
    rest = F.when(quoted, F.regexp_extract(text, r'^"[^"]*" ?(.*)$', 1)).otherwise(F.regexp_extract(text, r"^\S+ (.*)$", 1))
    fields = F.split(rest, " ")

    def field(i: int) -> Column:
        return F.coalesce(F.get(fields, F.lit(i)), F.lit(""))

    def is_hex(c: Column) -> Column:
        return c.rlike("^(?i:0x)?[0-9A-Fa-f]{1,15}$")

    def digits(c: Column) -> Column:
        return F.regexp_replace(c, "^0[xX]", "")

    def address(i: int) -> Column:
        bare = F.lower(F.conv(digits(field(i)), 16, 16))
        return F.when(F.length(bare) < 8, F.lpad(bare, 8, "0")).otherwise(bare)

    length = F.when(is_hex(field(2)), F.conv(digits(field(2)), 16, 10).try_cast("long"))
    access = F.nullif(F.when(is_hex(field(2)), field(3)).otherwise(field(2)), F.lit(""))
    parts = [
        F.when(quoted, F.regexp_extract(text, '^"([^"]*)"', 1)).otherwise(F.regexp_extract(text, r"^(\S+)", 1)).alias("name"),
        address(0).alias("load"),
        address(1).alias("exec"),
        length.alias("length"),
        access.alias("access"),
        formats.filetype_of_load(address(0)).alias("filetype"),
        F.timestamp_micros(formats.stamp_of_load(address(0), address(1))).cast("timestamp_ntz").alias("modified"),
    ]
    return F.when((~quoted | text.rlike('^"[^"]*"')) & is_hex(field(0)) & is_hex(field(1)), F.struct(*parts))


# The variables that name the script's own folder, and where a command's target stands.
OWN_FOLDER = ("obey$dir", "obey$path")
_WORD = r'("[^"]*"|\S+)'
TARGETS = {
    "run": _WORD,
    "rmrun": _WORD,
    "rmload": _WORD,
    "rmensure": rf"(?:.*?\s)??(?:rmload|rmrun)\s+{_WORD}",
    "basic": rf"(?:(?:.*?\s)??-(?:quit|load)\s+|(?:-\S+\s+)*){_WORD}",
}
_TARGETS = {command: re.compile(pattern, re.IGNORECASE) for command, pattern in TARGETS.items()}
_COMMAND = re.compile(r"^[\s*]*([^\s|*]+)[ \t]*(.*?)\s*$", re.MULTILINE)
_PIECE = re.compile(r"<([^<>\s]+)>")

#: A text with its variables filled in: whether it lies below the script's folder, and the text, from there on if so.
Place = tuple[bool, str]


def _fill(text: str, known: dict[str, Place]) -> Place:
    """text with the variables known; what stands before the script's folder is dropped, unknown names stay."""
    inside, out = False, ""
    for number, piece in enumerate(_PIECE.split(text)):
        below, filled = known.get(piece.lower(), (False, f"<{piece}>")) if number % 2 else (False, piece)
        inside, out = (True, filled) if below and not inside else (inside, out + filled)
    return inside, out


def places(assignments: dict[str, str]) -> dict[str, Place]:
    """The variables of a script, resolved in the order in which they depend on each other.

    A variable that names itself leaves that name standing; what depends on a
    circle of several is left out.
    """
    known: dict[str, Place] = dict.fromkeys(OWN_FOLDER, (True, ""))
    open_names = {name: {v.lower() for v in _PIECE.findall(value)} - {name} for name, value in assignments.items() if name not in known}
    while ready := [name for name, needs in open_names.items() if not needs & open_names.keys()]:
        known |= {name: _fill(assignments[name], known) for name in ready}
        for name in ready:
            del open_names[name]
    return known


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def assigned(script: str | None) -> dict[str, str]:
    """The variables that a script sets, in lower case, with their last values."""
    found = (rest.split(None, 1) for command, rest in _COMMAND.findall(script or "") if command.lower() in ("set", "setmacro", "seteval"))
    return {pair[0].lower(): _bare(pair[1]) for pair in found if len(pair) == 2}


def launched(script: str | None, seed: dict[str, str] | None = None) -> list[str]:
    """Paths, below the script's folder and in lower case, of the files that a launch script starts, once each in order.

    The script's folder is <Obey$Dir> or <Obey$Path>. seed holds variables set
    elsewhere, such as by a boot script; the script's own win, wherever in it
    they are set. A target without a variable lies below the folder; options,
    arguments and targets of other places are left out.
    """
    known = places({name.lower(): value for name, value in (seed or {}).items()} | assigned(script))
    out: dict[str, None] = {}
    for command, rest in _COMMAND.findall(script or ""):
        pattern = _TARGETS.get(command.lower())
        found = pattern.match(rest) if pattern else None
        target = _bare(found[1]) if found else ""
        if target and target[0] not in "-%":
            inside, path = _fill(target, known)
            if inside or "<" not in target:
                out[path.lstrip("." if inside else "").replace(".", "/").lower()] = None
    out.pop("", None)
    return list(out)


def launched_column(script: Column | str, boot: Column | str | None = None) -> Column:
    """Paths that launch scripts start, as array<string>; boot is the text of the boot script that runs before."""

    def run(scripts: pd.Series) -> pd.Series:
        return scripts.map(launched)

    def run_after(scripts: pd.Series, boots: pd.Series) -> pd.Series:
        return pd.Series([launched(s, assigned(b)) for s, b in zip(scripts, boots, strict=True)])

    if boot is None:
        return F.pandas_udf(run, "array<string>")(script)
    return F.pandas_udf(run_after, "array<string>")(script, boot)
