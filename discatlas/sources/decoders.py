"""Readers of binary formats: what a file is, and what it lists, from its bytes.

Each decoder takes bytes and gives a list of dicts, an empty list where the bytes
are not of its format or are cut off. `decode` runs them over a binaryFile scan.
All layouts are those of the published format descriptions.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Bytes at the beginning (offset, bytes) by which a format is known.
MAGIC = {
    "zip": (0, b"PK\x03\x04"), "gzip": (0, b"\x1f\x8b"), "bzip2": (0, b"BZh"), "xz": (0, b"\xfd7zXZ\x00"), "zstd": (0, b"\x28\xb5\x2f\xfd"),
    "7z": (0, b"7z\xbc\xaf\x27\x1c"), "rar": (0, b"Rar!\x1a\x07"), "tar": (257, b"ustar"), "spark": (0, b"Archive\x00"), "squash": (0, b"SQSH"),
    "hfe": (0, b"HXCPICFE"), "hfe3": (0, b"HXCHFEV3"), "scp": (0, b"SCP"), "imd": (0, b"IMD "), "iso9660": (0x8001, b"CD001"), "armovie": (0, b"ARMovie"),
    "draw": (0, b"Draw"), "png": (0, b"\x89PNG\r\n\x1a\n"), "gif": (0, b"GIF8"), "jpeg": (0, b"\xff\xd8\xff"), "pdf": (0, b"%PDF"),
}
# Partition types of the PC partition table.
PC_TYPES = {0x01: "FAT12", 0x04: "FAT16", 0x06: "FAT16", 0x07: "NTFS", 0x0B: "FAT32", 0x0C: "FAT32", 0x0E: "FAT16", 0x82: "LINUX_SWAP", 0x83: "LINUX"}


def sniff(data: bytes) -> str | None:
    """The format whose magic bytes the data has."""
    for name, (offset, magic) in MAGIC.items():
        if data[offset : offset + len(magic)] == magic:
            return name
    return None


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").rstrip()


def zip_entries(data: bytes) -> list[dict]:
    """Entries of a ZIP's central directory, with the archive's comment as an entry without a name."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if at < 0 or at + 22 > len(data):
        return []
    count, _, start, comment = struct.unpack_from("<HIIH", data, at + 10)
    out = [{"name": None, "size": None, "info": data[at + 22 : at + 22 + comment].decode("latin-1")}] if comment else []
    for _ in range(count):
        if data[start : start + 4] != b"PK\x01\x02" or start + 46 > len(data):
            break
        flags, size, name, extra, note = struct.unpack_from("<H", data, start + 8)[0], *struct.unpack_from("<IHHH", data, start + 24)
        raw = data[start + 46 : start + 46 + name]
        out.append({"name": raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), "size": size, "info": _riscos_extra(data[start + 46 + name : start + 46 + name + extra])})
        start += 46 + name + extra + note
    return out


def _riscos_extra(extra: bytes) -> str | None:
    """Load and exec address in the extra field that RISC OS archivers write."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 0x4341 and extra[at + 4 : at + 8] == b"ARC0" and size >= 12:
            return "{:08x},{:08x}".format(*struct.unpack_from("<II", extra, at + 8))
        at += 4 + size
    return None


def iso_volume(data: bytes) -> list[dict]:
    """Primary volume descriptor of an ISO 9660 image."""
    at = 0x8000
    while data[at + 1 : at + 6] == b"CD001" and data[at] != 255:
        if data[at] == 1 and len(data) >= at + 132:
            blocks, size = struct.unpack_from("<I", data, at + 80)[0], struct.unpack_from("<H", data, at + 128)[0]
            return [{"name": _text(data[at + 40 : at + 72]), "size": blocks * size, "info": _text(data[at + 8 : at + 40])}]
        at += 2048
    return []


def pc_partitions(data: bytes) -> list[dict]:
    """Primary partitions of a PC partition table."""
    if data[510:512] != b"\x55\xaa" or data[54:59] in (b"FAT12", b"FAT16") or data[82:87] == b"FAT32":
        return []
    out = []
    for i in range(4):
        kind, start, count = struct.unpack_from("<4xB3xII", data, 446 + 16 * i)
        if kind and count:
            out.append({"name": f"partition {i}", "size": count * 512, "info": f"{PC_TYPES.get(kind, f'0x{kind:02X}')} at {start * 512}"})
    return out


def fat_volume(data: bytes) -> list[dict]:
    """Label and size of a FAT file system by its boot sector."""
    if len(data) < 512 or data[510:512] != b"\x55\xaa":
        return []
    sector, small, large = struct.unpack_from("<H", data, 11)[0], struct.unpack_from("<H", data, 19)[0], struct.unpack_from("<I", data, 32)[0]
    for kind, label in ((54, 43), (82, 71)):
        if data[kind : kind + 3] == b"FAT" and sector in (512, 1024, 2048, 4096):
            return [{"name": data[label : label + 11].decode("cp437").rstrip(), "size": (small or large) * sector, "info": _text(data[kind : kind + 8])}]
    return []


def adfs_boot(data: bytes) -> list[dict]:
    """Disc record in the boot block of an ADFS hard disc or large floppy, if its checksum holds."""
    block = data[0xC00:0xE00]
    if len(block) < 512:
        return []
    total = 0
    for byte in reversed(block[:511]):
        total = (total & 0xFF) + (total >> 8) + byte
    if total & 0xFF != block[511]:
        return []
    record = block[0x1C0:]
    shift, sectors, heads = record[0], record[1], record[2]
    size = struct.unpack_from("<I", record, 16)[0]
    if not 8 <= shift <= 12 or not size or not heads:
        return []
    return [{"name": _text(record[22:32]), "size": size, "info": f"{1 << shift} bytes a sector, {sectors} sectors, {heads} heads"}]


def hfe_header(data: bytes) -> list[dict]:
    """Tracks, sides and bit rate of an HFE flux image."""
    if data[:8] not in (b"HXCPICFE", b"HXCHFEV3") or len(data) < 20:
        return []
    tracks, sides, encoding, rate = struct.unpack_from("<BBBH", data, 9)
    return [{"name": _text(data[:8]), "size": len(data), "info": f"{tracks} tracks, {sides} sides, encoding {encoding}, {rate} kbit/s"}]


def scp_header(data: bytes) -> list[dict]:
    """Range of tracks and revolutions of an SCP flux image."""
    if data[:3] != b"SCP" or len(data) < 16:
        return []
    return [{"name": f"type 0x{data[4]:02x}", "size": len(data), "info": f"tracks {data[6]} to {data[7]}, {data[5]} revolutions"}]


def imd_tracks(data: bytes) -> list[dict]:
    """Tracks of an ImageDisk file with the bytes of their sectors."""
    if data[:4] != b"IMD " or (at := data.find(b"\x1a")) < 0:
        return []
    at, out = at + 1, []
    while at + 5 <= len(data):
        _, cylinder, head, count, code = data[at : at + 5]
        if code > 6:
            break
        size, at = 128 << code, at + 5 + count * (1 + bool(head & 0x80) + bool(head & 0x40))
        kinds = []
        for _ in range(count):
            if at >= len(data):
                return out
            kind = data[at]
            kinds.append(kind)
            at += 1 + (0 if kind == 0 else size if kind % 2 else 1)
        out.append({"name": f"{cylinder}/{head & 1}", "size": size * count, "info": f"{sum(k >= 5 for k in kinds)} bad, {sum(k == 0 for k in kinds)} unreadable"})
    return out


def riscos_module(data: bytes) -> list[dict]:
    """Title, help text and commands of a RISC OS relocatable module."""
    if len(data) < 44:
        return []
    words = struct.unpack_from("<11I", data)
    title, text, table = words[4], words[5], words[6]
    if not (0 < title < len(data) and 0 <= text < len(data)) or words[3] & 0xFF000000:
        return []
    name = data[title:].split(b"\0")[0]
    if not 0 < len(name) <= 64 or any(c < 33 or c > 126 for c in name):
        return []
    out = [{"name": name.decode("ascii"), "size": len(data), "info": _text(data[text:]).replace("\t", " ") if text else None}]
    at = table
    while 0 < at < len(data) and data[at]:
        command = data[at:].split(b"\0")[0]
        if any(c < 33 or c > 126 for c in command):
            break
        out.append({"name": f"*{command.decode('ascii')}", "size": None, "info": None})
        at = (at + len(command) + 4) // 4 * 4 + 16
    return out


def sprite_names(data: bytes) -> list[dict]:
    """Sprites of a sprite file with their size."""
    if len(data) < 12:
        return []
    count, first, _ = struct.unpack_from("<3I", data)
    at, out = first - 4, []
    for _ in range(min(count, len(data) // 44)):
        if at < 12 or at + 44 > len(data):
            return []
        size = struct.unpack_from("<I", data, at)[0]
        if size < 44 or at + size > len(data):
            return []
        out.append({"name": _text(data[at + 4 : at + 16]), "size": size, "info": None})
        at += size
    return out


def armovie_header(data: bytes) -> list[dict]:
    """Title and picture of an ARMovie: the lines of text it begins with."""
    lines = data[:4096].split(b"\n")
    if lines[0] != b"ARMovie" or len(lines) < 10:
        return []

    def first(line: bytes) -> str:
        return (line.split() or [b""])[0].decode("latin-1")

    return [{"name": lines[1].decode("latin-1").strip(), "size": len(data), "info": f"codec {first(lines[4])}, {first(lines[5])}x{first(lines[6])}, {first(lines[8])} frames/s"}]


DECODERS: dict[str, Callable[[bytes], list[dict]]] = {
    "zip": zip_entries, "iso9660": iso_volume, "pc_partitions": pc_partitions, "fat": fat_volume, "adfs": adfs_boot, "hfe": hfe_header, "scp": scp_header,
    "imd": imd_tracks, "riscos_module": riscos_module, "sprite": sprite_names, "armovie": armovie_header,
}


def decode(files: DataFrame) -> DataFrame:
    """Run all decoders over a binaryFile scan (path, content): path, format, decoder, ordinal, name, size, info.

    Every file gives at least one row; one that no decoder knows has a null
    decoder. Null content counts as empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content) if content is not None else b""
                known = sniff(data)
                found = [(name, i, e) for name, decoder in DECODERS.items() for i, e in enumerate(decoder(data))]
                rows += [(path, known, name, i, e["name"], e["size"], e["info"]) for name, i, e in found] or [(path, known, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "format", "decoder", "ordinal", "name", "size", "info"]).astype({"ordinal": "Int64", "size": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, format string, decoder string, ordinal long, name string, size long, info string")
