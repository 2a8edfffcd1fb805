import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from discatlas.functions import formats, hashes, paths, text
from discatlas.operators import buckets, dedup, hierarchy, jobs, known, listings, search

KNOWN = "id long, product string, md5 string, size long, required boolean"


def test_links_are_lenient_on_size_and_take_the_lowest_id(spark):
    rng = random.Random(1)
    files = [(i, rng.choice([None, "", "a", "b", "c"]), rng.choice([None, 1, 2])) for i in range(60)]
    ref = [(100 + i, "p", rng.choice([None, "", "a", "b"]), rng.choice([None, 1, 2, 3]), True) for i in range(8)]
    got = {r["file_id"]: r["known_id"] for r in known.link(spark.createDataFrame(files, "file_id long, md5 string, size long"), spark.createDataFrame(ref, KNOWN)).collect()}
    expected = {}
    for f, md5, size in files:
        hits = [k for k, _, m, s, _ in ref if md5 and m == md5 and (size is None or s is None or size == s)]
        if hits:
            expected[f] = min(hits)
    assert got == expected and expected


def test_recognition_against_brute_force(spark):
    rng = random.Random(2)
    hs = [f"h{i}" for i in range(8)]
    files = [(rng.randint(1, 6), rng.choice(["/", "A", "A/B"]), rng.choice([*hs, None])) for _ in range(70)]
    ref = [(i, f"p{rng.randint(0, 11)}", rng.choice([*hs, "absent"]), None, rng.random() < 0.6) for i in range(40)]
    got = {tuple(r) for r in known.recognise(spark.createDataFrame(files, "partition_id long, folder string, md5 string"), spark.createDataFrame(ref, KNOWN)).collect()}
    expected = set()
    places = {}
    for p, d, h in files:
        places.setdefault((p, d), set()).add(h)
    for product in {r[1] for r in ref}:
        need = [r[2] for r in ref if r[1] == product and r[4]]
        more = [r[2] for r in ref if r[1] == product and not r[4]]
        for (p, d), held in places.items():
            if need and all(h in held for h in need):
                expected.add((p, d, product, len(need), sum(h in held for h in more), len(more)))
    assert got == expected and expected


def test_equal_required_contents_each_count(spark):
    files = spark.createDataFrame([(1, "/", "a")], "partition_id long, folder string, md5 string")
    ref = spark.createDataFrame([(1, "p", "a", None, True), (2, "p", "a", None, True), (3, "q", "a", None, False)], KNOWN)
    assert [tuple(r) for r in known.recognise(files, ref).collect()] == [(1, "/", "p", 2, 0, 0)]


def test_fingerprints_and_spelling(spark):
    rows = spark.createDataFrame([("A", "x", "1"), ("A", "y", "2"), ("B", "y", "2"), ("B", "x", "1"), ("B", "x", "1"), ("C", "x", None)], "k string, p string, h string")
    got = {r["k"]: (r["n_files"], r["fingerprint"]) for r in known.fingerprint(rows, ["k"], F.concat("p", "h")).collect()}
    assert got["A"] == got["B"] and "C" not in got
    names = spark.createDataFrame([("Elite",), ("elite",), ("ELITE",), ("elite",)], "n string")
    assert [r["spelling"] for r in known.spelling(names, F.lower("n"), "n").collect()] == ["elite"]


def test_query_parser():
    q = search.parse('name:foo* !type:Text "two words" path:"a b/c" !bare fs: key:1')
    assert q.wanted == {"filename": ["foo*"], "path": ["a b/c"], "key": ["1"]}
    assert q.unwanted == {"filetype": ["Text"]} and q.words[:2] == ["two words", "!bare"]
    assert search.problems(q) == ["unknown key key"]
    assert search.problems(search.parse("!name:x")) == ["a query needs a term that isn't negated"]
    assert len(search.problems(search.parse("md5:xyz type:nonsense"))) == 2
    assert search.parse("").keys == set() and search.clause(search.parse("words only")) is None


@pytest.mark.parametrize(("value", "hits"), [("15..25", [15, 20, 25]), ("15..", [15, 20, 25, 30]), ("..15", [10, 15]), ("..", []), (">=25", [25, 30]), (">25", [30]), ("<15", [10]), ("<=10", [10]), ("20", [20]), ("", []), ("abc", []), ("1e3", [])])
def test_numeric_terms(spark, value, hits):
    df = spark.createDataFrame([(10,), (15,), (20,), (25,), (30,), (None,)], "n int")
    assert [r["n"] for r in df.where(search.numeric(F.col("n"), value)).orderBy("n").collect()] == hits


def test_search_joins_only_what_it_needs(spark):
    files = spark.createDataFrame([(1, 1, "d/a.txt", "a.txt", "txt", 5, "h", "fff", False, 0), (2, 1, "b", "b", None, None, None, None, False, 0), (3, None, "c", "c", None, 1, None, None, True, 0), (4, 9, "d", "x%y", None, 1, None, None, None, 0)], "id long, partition_id long, path string, filename string, extension string, file_size long, md5 string, risc_os_filetype string, is_directory boolean, extraction_depth int")
    partitions = spark.createDataFrame([(1, 1, "ADFS", None)], "id long, artefact_id long, filesystem string, label string")
    artefacts = spark.createDataFrame([(1, 1, "L", "FLUX")], "id long, item_id long, label string, artefact_type string")
    items = spark.createDataFrame([(1, "Item", "amiga")], "id long, name string, platform string")

    def ids(q):
        df = search.search_files(q, files, partitions, artefacts, items)
        return sorted(r["id"] for r in df.collect()), df._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert ids("filename:*") == ([1, 2, 4], 0)
    assert ids("filename:* !type:Text") == ([2, 4], 0)
    assert ids("fs:adfs filename:a*") == ([1], 1) and ids("fs:adfs filename:a")[0] == [] and ids("path:/a")[0] == [1]
    assert ids("platform:AMIGA") == ([1, 2], 3)
    assert ids("!filename:a")[0] == [] and ids("")[0] == []
    assert ids("filename:x%y")[0] == [4] and ids("size:..5")[0] == [1, 4]


def test_buckets_of_a_search(spark):
    make = {
        "files": "SELECT * FROM VALUES (1, 1, 'd/Mod', 'Mod', 'aa', 'ffa', false), (2, 1, 'Film', 'Film', 'bb', 'ae7', false), (3, 2, 'd/Mod', 'Mod', 'aa', 'ffa', false), (4, 2, 'x', 'x', NULL, NULL, NULL), (5, 2, 'd', 'd', NULL, NULL, true) AS t(id, partition_id, path, filename, md5, risc_os_filetype, is_directory)",
        "partitions": "SELECT * FROM VALUES (1, 10, 'Work', 'adfs', NULL), (2, 20, NULL, 'other', 'PC raw') AS t(id, artefact_id, label, filesystem, container_format)",
        "artefacts": "SELECT * FROM VALUES (10, 100, 'Red disc', 'aa', NULL), (20, 100, 'Blue', NULL, 'ff') AS t(id, item_id, label, md5, sha256)",
        "items": "SELECT 100L AS id, 'Elite disc' AS name, 'a trading game' AS description",
        "modules": "SELECT * FROM VALUES (10, 'd/Mod', 'FileCore', array('Desktop_Run', NULL), array('FC_Op')), (10, 'd/Mod', 'FileCore', array('Desktop_Run'), NULL), (20, 'd/Mod', 'Other', NULL, array('FC_Op2')) AS t(artefact_id, file_path, title_string, commands, swi_names)",
        "movies": "SELECT 10 AS artefact_id, 'Film' AS file_path, 'Intro' AS title, 160L AS width, 12.5D AS frame_rate",
        "protections": "SELECT * FROM VALUES (10, 'weak_bits'), (10, 'long_track'), (20, 'long_track') AS t(artefact_id, kind)",
        "masterings": "SELECT 20 AS artefact_id, 'tracker' AS kind",
        "tags": "SELECT * FROM VALUES (10, 'Games'), (20, 'gamma') AS t(artefact_id, tag)",
    }
    t = buckets.Tables({name: lambda sql=sql: spark.sql(sql) for name, sql in make.items()})

    def ids(query, dedupe=False):
        return sorted((r["kind"], r["row_id"]) for df in buckets.found(query, t, dedupe) for r in df.collect())

    assert ids("module:FileCore") == [("file", 1)] and ids("module:File") == []  # two rows of one file are one result
    assert ids("module:* command:desktop_run") == [("file", 1)] and ids("command:desktop") == [] and ids("command:Desktop*") == [("file", 1)]
    assert ids("swi:fc_op") == [("file", 1)] and ids("swi:fc*") == [("file", 1), ("file", 3)] and ids("swi:fc* !swi:fc_op2") == [("file", 1)]
    assert ids("swi:fc* !module:Other") == [("file", 1), ("file", 3)] and ids("swi:fc* path:d/m !type:ffb") == [("file", 1), ("file", 3)]
    assert ids("type:Module swi:FC_Op2") == [("file", 3)] and ids("type:Obey swi:fc*") == []
    assert ids("replaywidth:100..200 replaytitle:int !replaytitle:int") == [("file", 2)] and ids("replayframerate:12.5 ext:x") == []
    assert ids("protection:long_track") == [("protection", 10), ("protection", 20)] and ids("prot:Weak_Bits") == [("protection", 10)]
    assert ids("mastering:tracker") == [("mastering", 20)] and ids("tag:gam !tag:games") == [("tag", 20)]
    assert ids("fs:adfs") == [("partition", 1)] and ids("fs:pc") == [("partition", 2)] and ids("label:* !fs:adfs") == []
    assert ids("md5:a sha256:f") == [("hash", 10), ("hash", 20)] and ids("md5:aa") == [("file", 1), ("file", 3), ("hash", 10)]
    assert ids("disc") == [("item", 100), ("text", 10)] and ids('disc trading') == [("item", 100)] and ids("disc !text:elite") == [("text", 10)]
    assert ids("!md5:aa") == [] and ids("") == []
    folded = buckets.found("path:d/", t, dedupe=True)[0].collect()
    assert [(r["row_id"], r["detail"]) for r in folded] == [(3, "2")]
    assert {r["bucket"]: r["n"] for r in buckets.totals(buckets.found("md5:aa disc", t), spark).collect()} == {"files": 2, "artefacts": 2, "items": 1}
    pages = [[(r["row_id"], r["has_more"]) for r in buckets.page(buckets.found("path:*", t), n, 2).collect()] for n in (1, 2, 3)]
    assert pages == [[(3, True), (4, True)], [(1, False), (2, False)], []]
    assert buckets.page([], 1) is None
    q = search.parse("!prot:x tag:a !tag:b nokey:1 !disc:q sha1:zz")
    assert buckets.problems(q) == ["unknown key nokey", "zz is no sha1", "!label has no effect without a term of its kind", "!protection has no effect without a term of its kind"]


def test_closure_cycles_and_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    deep = hierarchy.closure(spark.createDataFrame(chain, "id long, parent_id long"))
    assert deep.count() == 300 * 299 // 2 and deep.agg(F.max("distance")).first()[0] == 299
    odd = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 99), (5, None), (None, 1), (6, 1)], "id long, parent_id long")
    got = {(r["node"], r["ancestor"]) for r in hierarchy.closure(odd).collect()}
    assert got == {(1, 2), (2, 1), (1, 1), (2, 2), (4, 99), (6, 1), (6, 2)}
    assert [tuple(r) for r in hierarchy.roots(odd).collect()] == [(5, 5, 0)]
    assert hierarchy.closure(odd.where("false")).count() == 0


def test_inherited_values_and_order(spark):
    nodes = spark.createDataFrame([(1, None, "b", None, True), (2, 1, "z", "p", None), (3, 2, "a", None, False), (4, None, "A", None, None), (5, 1, "c", None, False)], "id long, parent_id long, name string, platform string, private boolean")
    assert {tuple(r) for r in hierarchy.nearest(nodes, "platform").collect()} == {(2, "p"), (3, "p")}
    assert {r["node"] for r in hierarchy.any_above(nodes, F.col("private")).where("flag").collect()} == {1, 2, 3, 5}
    order = hierarchy.depth_first(nodes, "name").orderBy("position").collect()
    assert [(r["node"], r["depth"]) for r in order] == [(4, 0), (1, 0), (5, 1), (2, 1), (3, 2)]
    statuses = spark.createDataFrame([(1, "COMPLETED"), (3, "FAILED"), (3, "FAILED"), (4, "PENDING"), (4, "ODD")], "node long, status string")
    got = {tuple(r) for r in hierarchy.worst_status(statuses, hierarchy.roots(nodes).select("node", "root"), ["RUNNING", "FAILED", "PENDING", "COMPLETED"]).collect()}
    assert got == {(1, "FAILED", 2, 3), (4, "PENDING", 1, 1)}


def test_storage_totals(spark):
    blobs = spark.createDataFrame([(1, 100, "AA"), (2, 50, "bb"), (3, 0, "cc"), (4, 100, "aa"), (5, None, "dd"), (6, 9, None)], "id long, file_size long, sha256 string")
    artefacts = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, None)], "id long, upload_blob_id long")
    (row,) = dedup.storage_report(dedup.references(artefacts, blobs)).collect()
    assert tuple(row)[:4] == (150, 250, 100, 1) and row["ratio"] == pytest.approx(250 / 150)
    assert {tuple(r) for r in dedup.canonical(blobs).collect()} == {(1, 1), (2, 2), (3, 3), (4, 1), (5, 5), (6, 6)}
    (none,) = dedup.storage_report(dedup.references(artefacts.where("false"), blobs)).collect()
    assert tuple(none) == (0, 0, 0, 0, None)


def test_cap_belongs_to_each_tree(spark):
    rows = [(tree, is_dir, i) for tree, dirs, files in ((1, 3, 1), (2, 4, 2), (3, 0, 4), (4, 3, 3)) for is_dir, n in ((True, dirs), (False, files)) for i in range(n)]
    got = listings.capped_trees(spark.createDataFrame(rows, "tree long, is_directory boolean, id long"), "tree", "is_directory", [F.col("id").asc()], 3).collect()
    kept = {(r["tree"], r["is_directory"], r["id"]) for r in got}
    assert kept == {r for r in rows if r[2] < 3} and len(got) == len(kept)
    assert {(r["tree"], r["is_truncated"]) for r in got} == {(1, False), (2, True), (3, True), (4, False)}


def test_listings(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["b1", "b2", "a", " ", None, "Éa", "9", "c"])], "id long, label string")
    assert [(r["letter"], r["n"], r["page"]) for r in listings.letter_pages(rows, "label", 2).orderBy("letter").collect()] == [("9", 1, 1), ("A", 1, 1), ("B", 2, 2), ("C", 1, 3), ("É", 1, 3)]
    many = spark.range(60)
    seen = []
    number, more = 1, True
    while more:
        part, more = listings.page(many, [F.col("id").asc()], number, 25)
        seen += [r["id"] for r in part.collect()]
        number += 1
    assert seen == list(range(60)) and number == 4
    assert [listings.clamp_page(n, 60, 25) for n in (0, 2, 9)] == [1, 2, 3] and listings.clamp_page(4, 0, 0) == 1


def test_jobs(spark):
    start = datetime(2024, 1, 1)
    beats = spark.createDataFrame([(1, start), (1, start + timedelta(seconds=30)), (1, start + timedelta(seconds=90)), (2, start), (None, start)], "w long, at timestamp_ntz")
    assert {(r["key"], r["n"]) for r in jobs.last_seen(beats, "w", "at").collect()} == {(1, 3), (2, 1)}
    assert [r["key"] for r in jobs.alive(jobs.last_seen(beats, "w", "at"), F.lit(start + timedelta(seconds=100)), 60).collect()] == [1]
    assert jobs.spaced(beats.where("w = 1"), "w", "at", 60).count() == 2
    rows = spark.createDataFrame([(1, "RUNNING", start), (2, "RUNNING", start + timedelta(hours=2)), (3, "PENDING", start)], "id long, status string, at timestamp_ntz")
    assert [r["id"] for r in jobs.stale(rows, "at", F.lit(start + timedelta(hours=2)), 3600).collect()] == [1]
    assert [r["id"] for r in jobs.open_once(rows, []).collect()] == [1]


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_text_functions(spark):
    assert one(spark, text.slug("v"), "Héllo  World_1/2", "--", None, "A" * 300) == ["hllo-world-1-2", "untitled", "untitled", "a" * 200]
    assert one(spark, text.human_size("v"), 0, 1023, 1024, 1536, 10 * 1024**2, 5 * 1024**4, 3 * 1024**5, None, schema="v long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "10.0 MB", "5.0 TB", "3072.0 TB", None]
    assert one(spark, text.parse_size("v"), "12", "1.5 MB", "3g", "2KiB", "x", "", None) == [12, 1572864, 3 << 30, 2048, None, None, None]
    assert one(spark, text.clamp_percent("v"), -1, 50, 200, None, schema="v int") == [0, 50, 100, None]
    assert one(spark, text.clean_label("v"), "Elite (1984) disc 2 of 3 v1.2 [a]", "Disk 1", None) == ["Elite", "", None]
    assert one(spark, text.disc_number("v")[1], "CD 2/5", "disc 3") == [5, None]
    assert one(spark, text.version_of("v"), "App 1.20", "App", None) == ["1.20", None, None]
    assert one(spark, text.tag_list("v"), " a, ,b ", "", None) == [["a", "b"], [], []]
    assert one(spark, text.csv_guard("v"), "=1", "a", "-x", None, "") == ["'=1", "a", "'-x", None, ""]
    assert sorted(["x10", "X2", "x2b"], key=lambda v: one(spark, text.natural_key("v"), v)[0]) == ["X2", "x2b", "x10"]
    assert text.like_literal(r"a_b%c\d") == r"a\_b\%c\\d" and text.like_search("a*") == "a%" and text.like_search("a") == "%a%"


def test_path_and_hash_functions(spark):
    assert one(spark, paths.parent("v"), "a/b/c", "a", "", None) == ["a/b", "", "", None]
    assert one(spark, paths.ancestors("v"), "a/b/c", "a", "", None) == [["a", "a/b"], [], [], []]
    assert one(spark, paths.ancestors("v", 1), "a/b/c") == [["a"]]
    assert one(spark, paths.app_folder("v"), "Apps/!X/y/!Z", "!X", "a/b", None) == ["Apps/!X", "!X", None, None]
    assert one(spark, paths.child_segment("v", "a"), "a/b/c", "ab/c", "a/", "a") == ["b", None, None, None]
    assert one(spark, F.col("v").rlike(paths.glob("!*s.txt")), "!Notes.TXT", "Notes.txt", "!s.txtx") == [True, False, False]
    assert one(spark, paths.is_child_of("v", F.lit("/")), "top", "a/b") == [True, False]
    name, kind = paths.suffix_type("v")
    assert one(spark, F.struct(name, kind), "File,FFb", "File,xyz") == [("File", "ffb"), ("File,xyz", None)]
    assert one(spark, paths.translate_name("v"), "a/b") == ["a.b"]
    assert one(spark, F.size(paths.breadcrumb("v")), "a//b", "", None) == [2, 0, 0]
    assert one(spark, hashes.normalise_hash("v"), " AB ", "", None) == ["ab", None, None]
    none = F.lit(None).cast("string")
    assert one(spark, hashes.dedupe_key(none, none, "v", F.lit(7)), "m", None) == ["m", "id:7"]
    kind, value = hashes.recognition_key(F.lit(""), none, "v")
    assert one(spark, F.struct(kind, value), "AB", "") == [("md5", "ab"), (None, None)]
    assert one(spark, hashes.hash_matches("v", "AB", 4), "abcd", "ba", None) == [True, False, None]


def test_format_functions(spark):
    assert one(spark, formats.artefact_type("v"), "a.ADF", "b.img.gz", "c.zip", "d", None) == ["SECTOR_IMAGE", "SECTOR_IMAGE", "ARCHIVE", "UNKNOWN", "UNKNOWN"]
    assert one(spark, formats.filetype_name("v"), "FFF", "123", None) == ["Text (&FFF)", "&123", None]
    assert formats.filetype_codes("text") == ["fff"] and formats.filetype_codes("&FFb") == ["ffb"] and formats.filetype_codes("zz") == []
    assert one(spark, formats.categories("v", F.lit("wav")), "fff", None) == [["text", "audio"], ["audio"]]
    assert one(spark, formats.filetype_of_load("v"), "FFFFFB12", "00001900", None, "zz") == ["ffb", None, None, None]
    assert one(spark, formats.stamp_of_load("v", F.lit("EA287F2C")), "FFFFFD53") == [int("53EA287F2C", 16) * 10_000 - 2_208_988_800_000_000]
