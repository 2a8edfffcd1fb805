"""Content keys. Five different keys identify content for five purposes; they must not be mixed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """The value, or null if it is the empty string."""
    return F.nullif(_col(c), F.lit(""))


def normalise_hash(c: Column | str) -> Column:
    """Trimmed, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(_col(c))), F.lit(""))


def similarity_key(sha256: Column | str, md5: Column | str) -> Column:
    return F.coalesce(_col(sha256), _col(md5))


def dedupe_key(sha256: Column | str, sha1: Column | str, md5: Column | str, row_id: Column | str) -> Column:
    """Key under which search results fold together; a file without hashes stays by itself."""
    return F.coalesce(_col(sha256), _col(sha1), _col(md5), F.concat(F.lit("id:"), _col(row_id).cast("string")))


def recognition_key(sha256: Column | str, sha1: Column | str, md5: Column | str) -> tuple[Column, Column]:
    """(kind, value) of the first hash that is not empty, in lower case."""
    pairs = [("sha256", sha256), ("sha1", sha1), ("md5", md5)]
    kind = F.coalesce(*(F.when(filled(c).isNotNull(), F.lit(name)) for name, c in pairs))
    return kind, F.lower(F.coalesce(*(filled(c) for _, c in pairs)))


def fingerprint_key(md5: Column | str, sha1: Column | str, sha256: Column | str) -> Column:
    return F.coalesce(filled(md5), filled(sha1), filled(sha256))


def dedupable(size: Column | str, sha256: Column | str) -> Column:
    """Whether content counts in storage deduplication: a size above 0 and a hash."""
    return F.coalesce((_col(size) > 0) & _col(sha256).isNotNull(), F.lit(False))


def hash_matches(c: Column | str, value: str, length: int) -> Column:
    """Equality with a whole hash, prefix search with a shorter one; % and _ in the value are live."""
    value = value.strip().lower()
    return _col(c) == value if len(value) >= length else _col(c).ilike(f"{value}%")


def set_fingerprint(entry: Column | str) -> Column:
    """Aggregate: digest of a set of distinct texts, whatever their order; nulls count for nothing.

    Made of their number, the exclusive or of one half and the sum of the other
    half of their md5 (60 bits each), so its state is three numbers and a set of
    any size is combined by partial aggregation.
    """
    digest = F.md5(_col(entry))
    one, two = (F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))
    return F.md5(F.concat_ws(":", F.count(_col(entry)), F.bit_xor(one), F.sum(two.cast("decimal(20,0)")).cast("string")))
