"""Text helpers: slugs, sizes, labels, keys for natural order, LIKE patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(name: Column | str, longest: int = 200) -> Column:
    """Lower case, separators to single hyphens, other characters dropped; 'untitled' if nothing is left."""
    c = F.regexp_replace(F.lower(_col(name)), r"[\s_/]+", "-")
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9-]", ""), "-+", "-")
    c = F.regexp_replace(F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, longest), "-+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("untitled"))


def url_id(uuid: Column | str, name: Column | str) -> Column:
    """First eight characters of the uuid and the slug, if there is a name."""
    return F.concat_ws("-", F.substring(_col(uuid), 1, 8), F.when(F.trim(_col(name)) != "", slug(name)))


def human_size(size: Column | str) -> Column:
    """Bytes with the unit that leaves a number below 1024, to one decimal half up, at most TB; all in whole numbers."""
    c = _col(size).cast("long")
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        half = 1 << (10 * power - 1)
        whole, rest = F.shiftright(c, 10 * power), c.bitwiseAND((1 << 10 * power) - 1)
        tenths = whole * 10 + F.shiftright(rest * 10 + half, 10 * power)
        shown = F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when((c < 1 << 10 * (power + 1)) if unit != "TB" else c.isNotNull(), shown)
    return out


def parse_size(text: Column | str) -> Column:
    """Bytes of text such as '12', '1.5 MB' or '3g'; null if it is none."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?\s*$"
    low = F.lower(_col(text))
    factor = F.when(F.regexp_extract(low, pattern, 2) == "k", F.lit(1 << 10)).when(F.regexp_extract(low, pattern, 2) == "m", F.lit(1 << 20)).when(F.regexp_extract(low, pattern, 2) == "g", F.lit(1 << 30)).when(F.regexp_extract(low, pattern, 2) == "t", F.lit(1 << 40)).otherwise(F.lit(1))
    return F.when(low.rlike(pattern), F.floor(F.regexp_extract(low, pattern, 1).try_cast("double") * factor.cast("double")).cast("long"))


def clamp_percent(value: Column | str) -> Column:
    """Between 0 and 100; null stays null."""
    return F.when(_col(value).isNotNull(), F.least(F.greatest(_col(value), F.lit(0)), F.lit(100)))


def disc_number(label: Column | str) -> tuple[Column, Column]:
    """(n, m) of labels such as 'disc 2 of 5'; m is null if it is not given."""
    pattern = r"(?i)\b(?:disc|disk|cd)\s*([0-9]+)(?:\s*(?:of|/)\s*([0-9]+))?"
    c = _col(label)
    return F.regexp_extract(c, pattern, 1).try_cast("int"), F.regexp_extract(c, pattern, 2).try_cast("int")


def version_of(label: Column | str) -> Column:
    """Version such as '1.20' or 'v3.1b', null if there is none."""
    return F.nullif(F.regexp_extract(_col(label), r"(?i)\bv?([0-9]+\.[0-9]+[a-z]?)\b", 1), F.lit(""))


def clean_label(label: Column | str) -> Column:
    """A label without its disc number, version and bracketed remarks."""
    c = F.regexp_replace(_col(label), r"\([^()]*\)|\[[^\[\]]*\]", " ")
    c = F.regexp_replace(c, r"(?i)\b(?:disc|disk|cd)\s*[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?", " ")
    c = F.regexp_replace(c, r"(?i)\bv?[0-9]+\.[0-9]+[a-z]?\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tag_list(text: Column | str) -> Column:
    """Comma-separated names, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def csv_guard(c: Column | str) -> Column:
    """Text that a spreadsheet would take for a formula, made harmless."""
    return F.when(_col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), _col(c))).otherwise(_col(c))


def natural_key(c: Column | str) -> Column:
    """Sort key that orders digit runs by value and ignores case: every run is padded to 20 digits."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r)), "")


def like_literal(value: str) -> str:
    """A value with LIKE's wildcards escaped by a backslash."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_search(value: str) -> str:
    """Pattern of a search term: * is a wildcard, a term without any is sought anywhere; % and _ are live."""
    pattern = value.replace("*", "%")
    return pattern if "%" in pattern else f"%{pattern}%"


def like_exact(value: str) -> str:
    """Pattern of a path term: exact unless it has a wildcard."""
    return value.replace("*", "%")


def strip_brackets(c: Column | str) -> Column:
    """Text without bracketed remarks at its end, unless nothing else is left."""
    return F.when(_col(c).rlike(r"^\s*[\[(]"), _col(c)).otherwise(F.trim(F.regexp_replace(_col(c), r"(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]))+\s*$", "")))


def path_label(path: Column | str) -> Column:
    """Label of a path: its last segment without extension, after its folder where the segment is a plain number or 'disc n'."""
    parts = F.filter(F.split(_col(path), "/"), lambda s: s != "")
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]{1,4}$", "")
    vague = base.rlike(r"(?i)^(?:(?:disc|disk|cd|side)\s*)?[0-9]+$") & (F.size(parts) > 1)
    return F.when(F.size(parts) > 0, F.when(vague, F.concat_ws(" ", F.get(parts, F.size(parts) - 2), base)).otherwise(base))


def storage_key(sha256: Column | str, name: Column | str, most_bytes: int = 120) -> Column:
    """Content-addressed key aa/bb/<hash>-<name>, of characters that every store takes, at most so many bytes of name."""
    digest = F.lower(_col(sha256))
    safe = F.substring(F.regexp_replace(F.coalesce(_col(name), F.lit("")), "[^A-Za-z0-9._-]", "_"), 1, most_bytes)
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat_ws("-", digest, F.nullif(safe, F.lit("")))))


# Media types by extension, for keys of a store.
MIME = {"txt": "text/plain", "html": "text/html", "json": "application/json", "png": "image/png", "gif": "image/gif", "jpg": "image/jpeg", "wav": "audio/wav", "mp4": "video/mp4", "zip": "application/zip"}


def mime_type(key: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(_col(key), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair)), ext), F.lit("application/octet-stream"))


def valid_key(key: Column | str) -> Column:
    """Whether a storage key is safe: relative, without empty, '.' or '..' segments, control characters or backslashes."""
    c = _col(key)
    return F.coalesce((c != "") & ~c.rlike(r"(?:^|/)(?:\.{0,2})(?:/|$)") & ~c.rlike(r"[\x00-\x1f\\\\]"), F.lit(False))


def latin1_repair(c: Column | str) -> Column:
    """Text whose characters 0x80-0x9F were left as control characters, read as the code page that has letters there."""
    table = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
    keep = [(chr(0x80 + i), t) for i, t in enumerate(table) if t != "\ufffd"]
    return F.translate(_col(c), "".join(a for a, _ in keep), "".join(b for _, b in keep))
