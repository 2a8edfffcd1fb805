import json
import random

import pytest

from discatlas.operators import nested


def brute(text):
    """Recursive reading of the rules, for documents of moderate depth."""
    try:
        value = json.loads(text, parse_constant=lambda _: 1 / 0, parse_int=lambda n: 0)
        while isinstance(value, str):
            value = json.loads(value, parse_constant=lambda _: 1 / 0, parse_int=lambda n: 0)
    except (ValueError, TypeError, ZeroDivisionError):
        return set()
    out = set()

    def walk(v, path, owner, element):
        below = path if element else owner
        if isinstance(v, dict):
            if element:
                out.add((path, owner))
            for k, c in v.items():
                lone = isinstance(c, dict) and k in nested.LONE_KEYS
                walk(c, f"{path}.{k}[0]" if lone else f"{path}.{k}", below, lone)
        elif isinstance(v, list):
            for i, c in enumerate(v):
                walk(c, f"{path}[{i}]", below, True)

    walk(value, "$", "$", False)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "id long, details string")
    out = {}
    for r in nested.objects(nested.shred(df, "id", "details")).collect():
        out.setdefault(r["key"], set()).add((r["path"], r["owner"]))
    return out


CASES = [
    '{"partitions": [{"directories": [{}, {"entries": {"name": "a"}}]}, null, 3, {"x": 1}]}',
    json.dumps('{"modules": {"commands": [{"name": "x"}]}}'),
    json.dumps(json.dumps({"a": [[{"b": []}], [1, [{}]]]})),
    '[{"a": 1}, [{"b": [{}]}]]',
    '{"a": {"b": {"c": [{"d": {"reads": {"crc": null}}}]}}}',
    '{"modules": [{}]',
    '{"modules": [{}]} x',
    '{"a": [NaN, {}]}',
    "",
    "   ",
    "null",
    '"text"',
    "12",
    '{"k.with.dots": [{"": [{}]}]}',
    '{"n": [{"big": ' + "9" * 6000 + "}]}",
    '{"a": [{"x": "\\ud800"}], "\\udfff": [{}]}',
    None,
]


def test_rules_against_recursion(spark):
    got = found(spark, list(enumerate(CASES)))
    for i, text in enumerate(CASES):
        expected = {tuple(s.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if i == 15 else s for s in p) for p in brute(text)} if text is not None else set()
        if i == 15:
            assert len(got.get(i, set())) == len(expected) == 2
        else:
            assert got.get(i, set()) == expected, text


def test_random_documents(spark):
    rng = random.Random(5)

    def make(depth):
        kind = rng.random()
        if depth > 6 or kind < 0.35:
            return rng.choice([None, True, 1.5, "x", ""])
        if kind < 0.7:
            return {rng.choice(["entries", "reads", "a", "b", "forks"]): make(depth + 1) for _ in range(rng.randint(0, 3))}
        return [make(depth + 1) for _ in range(rng.randint(0, 4))]

    rows = [(i, json.dumps(make(0))) for i in range(300)]
    got = found(spark, rows)
    for i, text in rows:
        assert got.get(i, set()) == brute(text)


def test_objects_only_is_the_same_filter(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id long, details string")
    whole = nested.objects(nested.shred(df, "id", "details")).select("key", "path", "owner").collect()
    pruned = nested.objects(nested.shred(df, "id", "details", scalars=False)).select("key", "path", "owner").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, pruned))


@pytest.mark.parametrize("depth", [3_000, 40_000])
def test_very_deep_nesting(depth):
    text = "[" * depth + '{"x": 1}' + "]" * depth
    out = tuple([] for _ in range(8))
    assert nested.nodes(nested.parse(text), frozenset(), False, out) == 1
    assert out[6] == ["$" + "[0]" * depth]
    with pytest.raises(ValueError):
        nested.parse("[" * depth)


def test_iterative_parser_agrees():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(['{', '}', '[', ']', ',', ':', '"a"', '1', '-0.5e3', 'null', 'true', ' ', '"\\n"', '01']) for _ in range(rng.randint(1, 9)))
        try:
            expected = nested._DECODER.decode(text.strip(" "))
        except ValueError:
            expected = ValueError
        try:
            got = nested._parse_deep(text)
        except ValueError:
            got = ValueError
        assert got == expected, text


def test_entities_keep_links_and_types(spark):
    text = '{"partitions": [{"index": 0, "label": null, "size": "12", "index2": {}}, {"index": "x", "directories": [{"entries": [{"name": "A", "size": 5}]}]}]}'
    df = spark.createDataFrame([(1, text, "clash"), (2, None, None), (3, "{}", "")], "id long, details string, ordinal string")
    adjacency = nested.shred(df, "id", "details")
    rows = nested.entities(adjacency, "partitions", {"index": "int", "label": "string", "size": "long", "ordinal": "string"}).orderBy("ordinal").collect()
    assert [(r["key"], r["node_path"], r["parent_path"], r["index"], r["label"], r["size"]) for r in rows] == [(1, "$.partitions[0]", "$", 0, None, 12), (1, "$.partitions[1]", "$", None, None, None)]
    entry = nested.entities(adjacency, "entries", {"name": "string", "size": "int"}).collect()
    assert [(e["parent_path"], e["name"], e["size"]) for e in entry] == [("$.partitions[1].directories[0]", "A", 5)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, details string")
    assert nested.shred(df, "id", "details").count() == 0
    assert nested.entities(nested.shred(df, "id", "details"), "x", {"a": "int"}).count() == 0


def test_flat_keeps_objects_standing_in_an_element(spark):
    text = json.dumps({"entries": [{"name": "a", "attrs": {"load": 7, "deep": {"x": "y"}}, "forks": [{"name": "no"}]}, {}], "attrs": {"load": 1}})
    df = spark.createDataFrame([(1, text), (2, "[]"), (3, "5"), (4, "{")], "id long, details string")
    fields = {"name": "string", "attrs.load": "int", "attrs.deep.x": "string"}
    rows = nested.flat(df, "id", "details", "entries", fields).collect()
    assert sorted(map(tuple, rows)) == [(1, "$.entries[0]", "$", 0, "a", 7, "y"), (1, "$.entries[1]", "$", 1, None, None, None)]
    top = nested.flat(df, "id", "details", None, {"attrs.load": "int"}).collect()
    assert sorted(map(tuple, top)) == [(1, "$", None, None, 1), (2, "$", None, None, None)]


def test_flat_tables_hold_every_element_and_parent(spark):
    import __spark_entry__ as entry

    from .conftest import DATA

    queries = entry.queries()
    held = set()
    parents = set()
    for label in ("analyses", *nested.LONE_KEYS):
        for r in queries[f"p2_flat_{label}"](spark, DATA).select("analysis_id", "node_path", "parent_path").collect():
            held.add((r["analysis_id"], r["node_path"]))
            parents.add((r["analysis_id"], r["parent_path"]))
    found = {(r["analysis_id"], r["node_path"]) for r in queries["p2_found"](spark, DATA).collect()}
    assert found and {x for x in held if x[1] != "$"} == found
    assert {x for x in parents if x[1] is not None} <= held


def test_conversion_status_reads_source_and_error(spark, tmp_path):
    import datetime

    from discatlas.catalog import Catalogue
    from discatlas.plans.derived import fun30_conversion_status

    def fail(source, code):
        return {"source": source, "error": {"code": code, "text": f"error {code}"}}

    now = datetime.datetime(2020, 1, 1)
    details = [
        (1, 7, "COMPLETED", True, {"outputs": [{"filename": "A"}, {"filename": "B"}], "failed_conversions": [fail("C", 4), fail("B", 5), fail("C", 6)]}),
        (2, 7, "COMPLETED", True, {"failed_conversions": fail("C", 1)}),
        (3, 8, "COMPLETED", True, {"failed_conversions": [{"source": "C", "error": None}, {"source": ""}]}),
        (4, 7, "FAILED", False, {"outputs": [{"filename": "D"}], "failed_conversions": [fail("E", 1)]}),
    ]
    rows = [(i, a, status, ok, json.dumps(d), now) for i, a, status, ok, d in details]
    spark.createDataFrame(rows, "id long, artefact_id long, status string, success boolean, details string, loaded_at timestamp_ntz").write.parquet(str(tmp_path / "analyses.parquet"))
    got = sorted(tuple(r) for r in fun30_conversion_status(Catalogue(spark, str(tmp_path))).collect())
    assert got == [(7, "A", True, None, None, None), (7, "B", True, 1, 5, "error 5"), (7, "C", False, 1, 4, "error 4"), (8, "C", False, 3, None, None)]


def test_a_label_is_pushed_into_the_parser(spark):
    texts = [(1, '{"entries": [{"name": "a", "size": 1, "entries": [{"name": "b", "x": [1]}]}, 5], "name": "root"}'), (2, '{"entries": {"name": null, "sub": {"name": "no"}}}'), (3, '"x"'), (4, None)]
    df = spark.createDataFrame(texts, "id long, details string")
    whole = nested.shred(df, "id", "details")
    pushed = nested.shred(df, "id", "details", only="entries", fields=("name",))
    assert {r["kind"] for r in pushed.collect()} == {"object", "string", "null"} and pushed.count() == 6
    fields = {"name": "string"}
    assert sorted(map(tuple, nested.entities(pushed, "entries", fields).collect())) == sorted(map(tuple, nested.entities(whole, "entries", fields).collect()))
