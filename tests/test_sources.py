import gzip
import io
import json
import random
import struct
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from discatlas.functions import scripts
from discatlas.operators import fuzzy, sinks
from discatlas.sources import decoders, files


def module_bytes():
    title, text = b"TestMod\0", b"Test Module\t1.23 (01 Jan 2000)\0\0"
    commands = b"Hello\0" + b"\0" * 2 + b"\0" * 16 + b"World\0" + b"\0" * 2 + b"\0" * 16 + b"\0" * 4
    head = 44
    return struct.pack("<11I", 0, 0, 0, 0, head, head + len(title), head + len(title) + len(text), 0, 0, 0, 0) + title + text + commands


def sprite_bytes():
    one = struct.pack("<I12s", 48, b"icon") + b"\0" * 32
    return struct.pack("<3I", 1, 16, 16 + len(one)) + one


def iso_bytes():
    data = bytearray(0x8000 + 4096)
    data[0x8000:0x8008] = b"\x01CD001\x01\0"
    data[0x8028:0x8048] = b"MY_DISC".ljust(32)
    struct.pack_into("<I", data, 0x8050, 300)
    struct.pack_into("<H", data, 0x8080, 2048)
    return bytes(data)


def pc_bytes():
    data = bytearray(512)
    data[510:] = b"\x55\xaa"
    struct.pack_into("<B3xB3xII", data, 446, 0x80, 6, 63, 1000)
    return bytes(data)


def fat_bytes():
    data = bytearray(512)
    struct.pack_into("<H", data, 11, 512)
    struct.pack_into("<H", data, 19, 1440)
    data[43:54], data[54:62], data[510:] = b"GAMES      ", b"FAT12   ", b"\x55\xaa"
    return bytes(data)


def adfs_bytes():
    data = bytearray(0xE00)
    record = 0xC00 + 0x1C0
    data[record : record + 3] = bytes([9, 17, 4])
    struct.pack_into("<I", data, record + 16, 20_000_000)
    data[record + 22 : record + 32] = b"HardDisc4\0"
    total = 0
    for byte in reversed(data[0xC00 : 0xC00 + 511]):
        total = (total & 0xFF) + (total >> 8) + byte
    data[0xDFF] = total & 0xFF
    return bytes(data)


def zip_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/größe.txt", "hello")
        info = zipfile.ZipInfo("b")
        info.extra = struct.pack("<HH4sIII", 0x4341, 20, b"ARC0", 0xFFFFFF00, 0x12345678, 3) + b"\0" * 4
        z.writestr(info, "x")
        z.comment = b"note"
    return out.getvalue()


def imd_bytes():
    return b"IMD 1.18\r\ncomment\x1a" + bytes([5, 0, 0, 2, 1, 1, 2]) + b"\x01" + b"z" * 256 + b"\x00"


CASES = {
    "zip": (zip_bytes(), [(None, None, "note"), ("a/größe.txt", 5, None), ("b", 1, "ffffff00,12345678")]),
    "iso9660": (iso_bytes(), [("MY_DISC", 614_400, "")]),
    "pc_partitions": (pc_bytes(), [("partition 0", 512_000, "FAT16 at 32256")]),
    "fat": (fat_bytes(), [("GAMES", 737_280, "FAT12")]),
    "adfs": (adfs_bytes(), [("HardDisc4", 20_000_000, "512 bytes a sector, 17 sectors, 4 heads")]),
    "hfe": (b"HXCPICFE\0" + bytes([80, 2, 0]) + struct.pack("<H", 250) + b"\0" * 10, [("HXCPICFE", 24, "80 tracks, 2 sides, encoding 0, 250 kbit/s")]),
    "scp": (b"SCP\x19\x08\x03\x00\x9f" + b"\0" * 8, [("type 0x08", 16, "tracks 0 to 159, 3 revolutions")]),
    "imd": (imd_bytes(), [("0/0", 512, "0 bad, 1 unreadable")]),
    "riscos_module": (module_bytes(), [("TestMod", len(module_bytes()), "Test Module 1.23 (01 Jan 2000)"), ("*Hello", None, None), ("*World", None, None)]),
    "sprite": (sprite_bytes(), [("icon", 48, None)]),
    "armovie": (b"ARMovie\nA film\n(c)\nme\n1 moving\n160 pixels\n128 pixels\n16 bits\n12.5 frames\n1\n", [("A film", 75, "codec 1, 160x128, 12.5 frames/s")]),
}


@pytest.mark.parametrize("name", CASES)
def test_decoder(name):
    data, expected = CASES[name]
    got = [(e["name"], e["size"], e["info"]) for e in decoders.DECODERS[name](data)]
    assert got == expected


def test_decoders_take_any_bytes():
    rng = random.Random(1)
    for name, decoder in decoders.DECODERS.items():
        base = CASES[name][0]
        for _ in range(200):
            cut = bytearray(base[: rng.randint(0, len(base))])
            for _ in range(rng.randint(0, 8)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.randrange(256)
            decoder(bytes(cut))
        assert decoder(b"") == []


def test_directory_scan_and_decode(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, (data, _) in CASES.items():
        (tmp_path / "in" / "sub" / f"{name},ffd").write_bytes(data)
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    (tmp_path / "in" / "plain.txt").write_bytes(b"x")
    (tmp_path / "in" / "disc.adf.gz").write_bytes(gzip.compress(b"x"))
    listed = files.directory(spark, f"file://{tmp_path}/in", content=True)
    rows = {r["path"]: r for r in listed.collect()}
    assert rows["sub/zip,ffd"]["filename"] == "zip" and rows["sub/zip,ffd"]["risc_os_filetype"] == "ffd"
    assert "empty.txt" not in rows and rows["plain.txt"]["file_size"] == 1 and rows["plain.txt"]["md5"] == "9dd4e461268c8034f5c8564e155c67a6"
    decoded = decoders.decode(listed).where("decoder IS NOT NULL").select("path", "decoder").distinct().collect()
    assert {(r["path"], r["decoder"]) for r in decoded} >= {(f"sub/{n},ffd", n) for n in CASES}
    assert decoders.decode(spark.createDataFrame([("x", None)], "path string, content binary")).collect()[0]["decoder"] is None
    found = files.importable(listed).collect()
    assert [(r["group"], r["base"], r["raw_type"], r["form"]) for r in found] == [("", "disc", "adf", 1)]


def test_sidecars(spark):
    listing = spark.createDataFrame([("d/a.zip",), ("d/a.txt",), ("d/A cover.jpg",), ("e/a.txt",), ("d/b.txt",)], "path string")
    assert sorted(r["sidecar"] for r in files.sidecars(files.importable(listing), listing).collect()) == ["d/A cover.jpg", "d/a.txt"]


def test_reference_databases(spark, tmp_path):
    database = {"schema_version": 1, "name": "db", "products": [{"title": " Game ", "files": [{"filename": "!Run", "md5": "AB ", "file_size": 5}, {"filename": "x", "is_required": False}, {"filename": ""}]}, {"title": "", "files": [{"filename": "y"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(database))
    (tmp_path / "b.json").write_text(json.dumps(database | {"schema_version": 2}))
    got = sorted(map(tuple, files.database_json(spark, str(tmp_path / "*.json")).collect()), key=str)
    assert got == [("db", "Game", "!Run", "ab", None, None, 5, None, True), ("db", "Game", "x", None, None, None, None, None, False)]
    (tmp_path / "c.csv").write_text("product_title,filename,md5,sha1,sha256,file_size,relative_path,is_required\nGame,a,AA,,,x,r/a,\n,b,,,,,,\nGame,c,BB,,,7,,0\n")
    rows = files.database_csv(spark, str(tmp_path / "c.csv"), "csv")
    assert sorted(map(tuple, rows.collect()), key=str) == [("csv", "Game", "a", "aa", None, None, None, "r/a", True), ("csv", "Game", "c", "bb", None, None, 7, None, False)]
    assert [r["md5"] for r in files.import_new(rows.where("md5 = 'aa'"), rows.union(rows)).collect()] == ["bb"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "id int, v string")
    assert {(r["id"], r["op"]) for r in sinks.reconcile(old, new.where("id != 3"), ["id"]).collect()} == {(1, "keep"), (2, "update"), (3, "delete"), (4, "insert")}
    assert {(r["id"], r["op"]) for r in sinks.reconcile(old, new, ["id"]).collect()} == {(1, "keep"), (2, "update"), (3, "keep"), (4, "insert")}
    assert [r["id"] for r in sinks.insert_ignore(old, new.union(new), ["id"]).collect()] == [4]
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.partitionBy("k").parquet(path)
    sinks.replace_scope(spark.createDataFrame([(9, "b")], "v int, k string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [("a", 1), ("b", 9)]
    sinks.write_csv(spark.createDataFrame([("=1+1", 1), ("ok", 2), (None, 3)], "t string, n int"), str(tmp_path / "csv"))
    assert {r["t"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=1+1", "ok", None}


def test_inf_lines(spark):
    cases = {
        "MYFILE FFFFFD00 FFFFFF00": ("MYFILE", "fffffd00", "ffffff00", None, None, "ffd"),
        "F FFFFFD00 0 100 WR/r": ("F", "fffffd00", "00000000", 256, "WR/r", "ffd"),
        "F FFFFFD00 0 100 33": ("F", "fffffd00", "00000000", 256, "33", "ffd"),
        "F FFFFFD00 0 100": ("F", "fffffd00", "00000000", 256, None, "ffd"),
        "F 1900 8023 L": ("F", "00001900", "00008023", None, "L", None),
        '  "MY FILE" FFFFFF00\t1 2 WR ': ("MY FILE", "ffffff00", "00000001", 2, "WR", "fff"),
        "#.BOOT 1 2": ("#.BOOT", "00000001", "00000002", None, None, None),
        "!Boot FFF00100 2": ("!Boot", "fff00100", "00000002", None, None, "001"),
    }
    none = ["", "   ", "ONLYONE", "TWO FIELDS", "FILE NOTAHEX FFFFFF00", '"UNTERMINATED FFFFFD00 FFFFFF00', None]
    df = spark.createDataFrame([(x,) for x in [*cases, *none]], "line string").select("line", scripts.inf_columns("line").alias("f"))
    got = {r["line"]: r["f"] for r in df.collect()}
    for line, expected in cases.items():
        assert tuple(got[line])[:6] == expected, line
    assert all(got[line] is None for line in none)
    assert got["F 1900 8023 L"]["modified"] is None
    stamp = spark.range(1).select(scripts.inf_columns(F.lit("F FFFFFD33 6E996A00")).alias("f")).first()["f"]["modified"]
    assert stamp == datetime(1900, 1, 1) + timedelta(milliseconds=10 * 0x336E996A00)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("| !Run\nSet MyApp$Dir <Obey$Dir>\nWimpSlot -min 320k -max 320k\nRun <MyApp$Dir>.!RunImage %*0\n", ["!runimage"]),
        ("*BASIC -quit <Obey$Dir>.Sources.Main\n", ["sources/main"]),
        ("BASIC -chain <Obey$Dir>.x -quit <Obey$Dir>.y\nbasic <Obey$Path>.z", ["y", "z"]),
        ("RMEnsure Util 0.00 RMLoad <Obey$Dir>.Modules.MyMod\nRun <Obey$Dir>.!RunImage\nRMRun <Obey$Dir>.m\nRUN <Obey$Dir>.!RunImage", ["modules/mymod", "!runimage", "m"]),
        ("RMEnsure Util 0.00 Error Needs Util 0.00 or later", []),
        ("Run <B$Dir>.prog\nSet B$Dir <A$Dir>.sub\nSetMacro A$Dir <Obey$Dir>.Bin", ["bin/sub/prog"]),
        ("SetEval A$Dir <Obey$Dir>\nRun <A$Dir>.x", ["x"]),
        ("RMLoad <System$Dir>.Modules.Foo\nRun <Foo$Dir>.x\nSet App$Dir Resources:$.Apps.Foo\nRun <App$Dir>.y\nRun loader.main", ["loader/main"]),
        ("Set A <B>\nSet B <A>\nRun <A>.x", []),
        ("Set A$Path <A$Path>,<Obey$Dir>.\nRun <Obey$Dir>.ok", ["ok"]),
        ('Run "<Obey$Dir>.!RunImage" %0\nRun -x\nRun %0\nRun\nRun <Obey$Dir>', ["!runimage"]),
        ("| comment\n\n   \n|Run <Obey$Dir>.no", []),
        (None, []),
    ],
)
def test_launch_scripts(text, expected):
    assert scripts.launched(text) == expected


def test_launch_scripts_after_a_boot_script(spark):
    rows = [("Run <Foo$Dir>.!RunImage", "Set Foo$Dir <Obey$Dir>"), ("Run <Foo$Dir>.a", None), (None, ""), ("Set Foo$Dir <Obey$Dir>.own\nRun <Foo$Dir>.a", "Set Foo$Dir <Obey$Dir>")]
    df = spark.createDataFrame(rows, "s string, b string")
    got = df.select(scripts.launched_column("s").alias("n"), scripts.launched_column("s", "b").alias("m")).collect()
    assert [(r["n"], r["m"]) for r in got] == [([], ["!runimage"]), ([], []), ([], []), (["own/a"], ["own/a"])]


def test_fuzzy_neighbours(spark):
    rng = random.Random(1)
    base = bytes(rng.randrange(256) for _ in range(35))
    near = bytearray(base)
    near[20] ^= 1
    far = bytes(rng.randrange(256) for _ in range(35))
    rows = spark.createDataFrame([(1, base.hex()), (2, "T1" + bytes(near).hex()), (3, far.hex()), (4, None), (5, "zz"), (6, base.hex())], "id long, digest string")
    got = {(r["query_id"], r["id"]): r["distance"] for r in fuzzy.neighbours(rows.where("id IN (1, 4)"), rows).collect()}
    assert got == {(1, 2): 1, (1, 6): 0}
    whole = fuzzy.neighbours(rows, rows, block=2).where(F.col("query_id") < F.col("id")).count()
    assert whole == 3
