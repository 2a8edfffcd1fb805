"""File formats: types by extension, file types by code, categories, stamps of the Acorn file systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of common file types by their hexadecimal code.
FILETYPES = {
    "fff": "Text", "ffd": "Data", "ffe": "Command", "ffb": "BASIC", "ffa": "Module", "ff9": "Sprite", "ff8": "Absolute", "ff7": "BBC font",
    "ff6": "Font", "ff5": "PostScript", "ff4": "Printout", "ff0": "TIFF", "fec": "Template", "feb": "Obey", "fea": "Desktop",
    "fd7": "TaskObey", "faf": "HTML", "fae": "Resource", "f95": "Code", "f89": "GZip", "ddc": "Archive", "bc5": "Impulse",
    "aff": "DrawFile", "af8": "ARMovie", "ae7": "ARMovie", "adf": "PDF", "a91": "Zip", "c85": "JPEG", "695": "GIF", "b60": "PNG", "1ad": "Amiga IFF",
}
# What an image or archive is by its extension.
IMAGE_TYPES = {
    "adf": "SECTOR_IMAGE", "ads": "SECTOR_IMAGE", "adl": "SECTOR_IMAGE", "ssd": "SECTOR_IMAGE", "dsd": "SECTOR_IMAGE", "img": "SECTOR_IMAGE", "ima": "SECTOR_IMAGE",
    "hfe": "FLUX", "scp": "FLUX", "ipf": "FLUX", "a2r": "FLUX", "imd": "SECTOR_IMAGE", "iso": "CD_IMAGE", "bin": "CD_IMAGE", "cue": "CD_IMAGE", "hdf": "HARD_DISC_IMAGE", "hda": "HARD_DISC_IMAGE",
    "zip": "ARCHIVE", "arc": "ARCHIVE", "lha": "ARCHIVE", "lzh": "ARCHIVE", "7z": "ARCHIVE", "tar": "ARCHIVE", "rar": "ARCHIVE",
}
COMPRESSORS = ("gz", "bz2", "xz", "zst", "z")
ARCHIVE_FILETYPES = ("ddc", "a91", "f89", "3fb", "68e")
CATEGORIES = {
    "text": ({"fff", "faf"}, {"txt", "doc", "htm", "html", "md"}),
    "program": ({"ffb", "ff8", "ffa", "feb"}, {"bas", "asm", "c", "exe"}),
    "image": ({"ff9", "aff", "c85", "695", "b60", "ff0"}, {"bmp", "gif", "jpg", "jpeg", "png", "tif"}),
    "audio": ({"fb1", "cb6"}, {"wav", "mp3", "mod", "ogg"}),
    "video": ({"ae7", "af8"}, {"avi", "mov", "mpg", "mp4", "rpl"}),
    "archive": (set(ARCHIVE_FILETYPES), {"zip", "arc", "lha", "7z", "tar", "rar", "gz"}),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a small table, null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def extension(name: Column | str) -> Column:
    """Extension in lower case without a compressor's, null if there is none."""
    bare = F.regexp_replace(F.lower(_col(name)), rf"\.(?:{'|'.join(COMPRESSORS)})$", "")
    return F.nullif(F.regexp_extract(bare, r"\.([a-z0-9]+)$", 1), F.lit(""))


def artefact_type(name: Column | str) -> Column:
    return F.coalesce(lookup(IMAGE_TYPES, extension(name)), F.lit("UNKNOWN"))


def filetype_name(code: Column | str) -> Column:
    """'Text (&FFF)', or only the code where the name is not known; null without a code."""
    low = F.lower(_col(code))
    shown = F.concat(F.lit("&"), F.upper(low))
    return F.when(low.isNotNull(), F.coalesce(F.concat(lookup(FILETYPES, low), F.lit(" ("), shown, F.lit(")")), shown))


def filetype_codes(value: str) -> list[str]:
    """Codes meant by a name or hexadecimal code; empty if there are none."""
    low = value.strip().lower().lstrip("&")
    named = [code for code, name in FILETYPES.items() if name.lower() == low]
    if named:
        return named
    return [low.zfill(3)] if len(low) <= 3 and low and all(c in "0123456789abcdef" for c in low) else []


def categories(filetype: Column | str, ext: Column | str) -> Column:
    """Content categories of a file, in the order of the table; several may hold."""
    code, low = F.lower(_col(filetype)), F.lower(_col(ext))
    flags = [F.when(F.coalesce(code.isin(*sorted(codes)), F.lit(False)) | F.coalesce(low.isin(*sorted(exts)), F.lit(False)), F.lit(name)) for name, (codes, exts) in CATEGORIES.items()]
    return F.array_compact(F.array(*flags))


def is_archive(filetype: Column | str, ext: Column | str) -> Column:
    return F.coalesce(F.lower(_col(filetype)).isin(*ARCHIVE_FILETYPES), F.lit(False)) | F.coalesce(F.lower(_col(ext)).isin(*sorted(CATEGORIES["archive"][1])), F.lit(False))


def filetype_of_load(load: Column | str) -> Column:
    """File type in a 32-bit load address given in hexadecimal, where its top 12 bits are set; else null."""
    number = F.conv(_col(load), 16, 10).try_cast("long")
    return F.when(F.shiftright(number, 20) == 0xFFF, F.lower(F.lpad(F.hex(F.shiftright(number, 8).bitwiseAND(0xFFF)), 3, "0")))


def stamp_of_load(load: Column | str, execute: Column | str) -> Column:
    """Microseconds since 1970 of the 40-bit count of hundredths of seconds since 1900 in load and exec address; null if the load address holds no type."""
    low, high = F.conv(_col(execute), 16, 10).try_cast("long"), F.conv(_col(load), 16, 10).try_cast("long")
    ticks = F.shiftleft(high.bitwiseAND(0xFF), 32) + low
    return F.when(F.shiftright(high, 20) == 0xFFF, ticks * 10_000 - 2_208_988_800_000_000)


# Media kinds by extension, and those that browsers play.
MEDIA = {"wav": "audio", "mp3": "audio", "ogg": "audio", "flac": "audio", "mod": "audio", "avi": "video", "mov": "video", "mpg": "video", "mp4": "video", "webm": "video", "rpl": "video", "bmp": "image", "png": "image", "gif": "image", "jpg": "image", "jpeg": "image"}
PLAYABLE = ("wav", "mp3", "ogg", "mp4", "webm", "png", "gif", "jpg", "jpeg")
# Numbers of the best-known moving-picture codecs of ARMovie files.
CODECS = {"1": "Moving Lines", "7": "Moving Blocks", "17": "Moving Blocks HQ", "19": "Super Moving Blocks"}


def media_kind(ext: Column | str) -> Column:
    return lookup(MEDIA, F.lower(_col(ext)))


def is_playable(ext: Column | str) -> Column:
    return F.coalesce(F.lower(_col(ext)).isin(*PLAYABLE), F.lit(False))


def codec_name(number: Column | str) -> Column:
    return F.coalesce(lookup(CODECS, _col(number).cast("string")), F.concat(F.lit("codec "), _col(number).cast("string")))
