"""Deeply nested JSON text to related flat tables by adjacency-table shredding.

`shred` stores every JSON value as a node: its parent, label, ordinal and
scalar. `objects` picks the object nodes that are array elements, `entities`
joins the object nodes of one label with their scalar children and pivots them
into a flat table that keeps the document's key and the parent's path.

Cases: null, empty, incomplete or invalid text has no nodes. Text that is a
JSON string holding JSON counts as the inner JSON. Of repeated keys in one
object the last holds. Numbers keep their spelling. Nesting of any depth is
read; there is no limit on length. Extra columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys under which an object standing alone counts as the only element of an array.
LONE_KEYS = (
    "partitions", "directories", "entries", "forks", "modules", "commands", "arguments", "indicators", "evidence",
    "reads", "movies", "tracks", "chunks", "transcoded", "streams", "outputs", "segments", "failed_conversions",
)

#: Rows of one Arrow batch that a worker gives back.
BATCH_ROWS = 20_000


class Number(str):
    """A JSON number as it is written."""

    __slots__ = ()


def _reject(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_reject)
_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> object:
    """JSON without recursion, for nesting beyond what the C scanner takes."""
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]
    at, key, expect = _SPACE.match(text, 0).end(), None, "value"

    def put(value: object) -> None:
        if isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
        else:
            stack[-1][0].append(value)

    while True:
        char = text[at : at + 1]
        if expect in ("value", "value or ]") and char and char in "[{":
            value: object = [] if char == "[" else {}
            put(value)
            stack.append((value, key))
            at, expect = at + 1, "value or ]" if char == "[" else "key or }"
        elif expect in ("value", "value or ]") and char == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
            put(value)
            expect = "after"
        elif expect in ("value", "value or ]") and (found := _PLAIN.match(text, at)):
            word = found.group()
            put(_WORDS[word] if word in _WORDS else Number(word))
            at, expect = found.end(), "after"
        elif expect in ("key", "key or }") and char == '"':
            key, at = json.decoder.scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at, expect = at + 1, "value"
        elif char and len(stack) > 1 and char == ("}" if isinstance(stack[-1][0], dict) else "]") and expect in ("after", "value or ]", "key or }"):
            key = stack.pop()[1]
            at, expect = at + 1, "after"
        elif char == "," and expect == "after" and len(stack) > 1:
            at, expect = at + 1, "key" if isinstance(stack[-1][0], dict) else "value"
        else:
            raise ValueError("no JSON")
        at = _SPACE.match(text, at).end()
        if expect == "after" and len(stack) == 1:
            if at != len(text):
                raise ValueError("text goes on")
            return root[0]


def parse(text: str | None) -> object:
    """The value of complete, valid JSON text, with strings that hold JSON read again; else ValueError."""
    value: object = text
    while type(value) is str:
        text = value.strip(" \t\n\r")
        try:
            value = _DECODER.decode(text)
        except RecursionError:
            value = _parse_deep(text)
    if text is None:
        raise ValueError("null")
    return value


def _clean(text: str) -> str:
    """Text that UTF-8 can hold: escapes of half a surrogate pair become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return re.sub("[\ud800-\udfff]", "�", text)


def _kind(value: object) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if value is True or value is False:
        return "boolean", "true" if value else "false"
    return ("number", str(value)) if type(value) is Number else ("string", _clean(value))


def nodes(value: object, lone: frozenset[str], scalars: bool, out: tuple[list, ...], only: str | None = None, fields: frozenset[str] = frozenset()) -> int:
    """Append the nodes of a parsed value to the eight lists of out; give how many there were.

    only restricts them to the object elements of that label and their scalars named by fields.
    """
    whole = scalars and only is None
    ids, parents, labels, ordinals, kinds, texts, paths, owners = out
    before = len(ids)
    count = 1
    stack = [(value, 0, None, "$", None, "$", "$", False)]
    while stack:
        value, node, parent, label, ordinal, path, owner, element = stack.pop()
        below = path if element else owner
        inner = type(value) is dict
        if inner or type(value) is list:
            wanted = inner and element and (only is None or label == only)
            if whole or wanted:
                ids.append(node)
                parents.append(parent)
                labels.append(label)
                ordinals.append(ordinal)
                kinds.append("object" if inner else "array")
                texts.append(None)
                paths.append(path)
                owners.append(owner)
        elif whole:  # a document that is one scalar
            kind, text = _kind(value)
            for column, item in zip(out, (node, parent, label, ordinal, kind, text, path, owner), strict=True):
                column.append(item)
            continue
        if inner:
            for key, child in value.items():
                kind = type(child)
                if kind is dict:
                    key = _clean(key)
                    alone = key in lone
                    stack.append((child, count, node, key, 0 if alone else None, f"{path}.{key}[0]" if alone else f"{path}.{key}", below, alone))
                    count += 1
                elif kind is list:
                    key = _clean(key)
                    stack.append((child, count, node, key, None, f"{path}.{key}", below, False))
                    count += 1
                elif whole or (scalars and wanted and key in fields):
                    name, text = _kind(child)
                    ids.append(count)
                    parents.append(node)
                    labels.append(_clean(key))
                    ordinals.append(None)
                    kinds.append(name)
                    texts.append(text)
                    paths.append(None)
                    owners.append(below)
                    count += 1
        elif type(value) is list:
            for index, child in enumerate(value):
                kind = type(child)
                if kind is dict or kind is list:
                    stack.append((child, count, node, label, index, f"{path}[{index}]", below, True))
                    count += 1
                elif whole:
                    name, text = _kind(child)
                    ids.append(count)
                    parents.append(node)
                    labels.append(label)
                    ordinals.append(index)
                    kinds.append(name)
                    texts.append(text)
                    paths.append(None)
                    owners.append(below)
                    count += 1
    return len(ids) - before


def shred(df: DataFrame, key: str, column: str, lone_keys: tuple[str, ...] = LONE_KEYS, scalars: bool = True, only: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """The adjacency table of JSON text: key, node, parent, label, ordinal, kind, scalar, path, owner.

    node numbers are unique within a document, 0 is its root. An element bears
    the label of its array and its index as ordinal. path is given for objects
    and arrays; owner is the path of the nearest enclosing array element, or $.
    With scalars=False only the objects that are array elements are stored, with
    only=label those of that label and their scalars named by fields: filters of
    a reader who needs no others, pushed into the parser.
    """
    kind = df.schema[key].dataType.simpleString()
    lone, named = frozenset(lone_keys), frozenset(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        out: tuple[list, ...] = tuple([] for _ in range(8))
        held = None

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(keys, held), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]
            keys.clear()
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "node", "parent", "label", "ordinal", "kind", "scalar", "path", "owner"])

        for batch in batches:
            held = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = parse(text)
                except ValueError:
                    continue
                keys.extend([name] * nodes(value, lone, scalars, out, only, named))
                if len(keys) >= BATCH_ROWS:
                    yield flush()
        if keys:
            yield flush()

    schema = f"key {kind}, node int, parent int, label string, ordinal int, kind string, scalar string, path string, owner string"
    return df.select(key, column).where(F.col(column).isNotNull()).mapInArrow(run, schema)


def objects(adjacency: DataFrame) -> DataFrame:
    """The object nodes that are array elements, of every level."""
    return adjacency.where("kind = 'object' AND ordinal IS NOT NULL")


def entities(adjacency: DataFrame, label: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of the array elements under one label.

    One row per element: key, node_path, parent_path, ordinal and a column for
    each of fields (name -> SQL type) from its scalar children; a field that is
    absent, null, nested or not of the type is null; a field named like one of the
    first four columns comes out as field_<name>. The join is on document and
    node, so a document of any size is spread over the tasks.
    """
    rows = objects(adjacency).where(F.col("label") == label).select("key", "node", "ordinal", F.col("path").alias("node_path"), F.col("owner").alias("parent_path"))
    children = adjacency.where(F.col("scalar").isNotNull() & F.col("label").isin(list(fields)) & F.col("ordinal").isNull()).select("key", F.col("parent").alias("node"), F.col("label").alias("field"), "scalar")
    picked = children.groupBy("key", "node").agg(*(F.max(F.when(F.col("field") == name, F.col("scalar"))).alias(f"__{i}") for i, name in enumerate(fields)))
    joined = rows.join(picked, ["key", "node"], "left")
    return joined.select("key", "node_path", "parent_path", "ordinal", *(F.col(f"__{i}").try_cast(kind).alias(f"field_{name}" if name in ("key", "node_path", "parent_path", "ordinal") else name) for i, (name, kind) in enumerate(fields.items())))


def element_nodes(value: object, label: str | None, fields: dict[tuple[str, ...], int], lone: frozenset[str], out: tuple[list, ...]) -> int:
    """Append the elements under one label (None: the document) and their scalars, also those of objects standing in them, to the six lists of out; give how many."""
    elements, ordinals, paths, owners, numbers, texts = out
    before = len(elements)
    count = 0
    stack = [(value, None, None, "$", None, False, None, ())]
    while stack:
        value, name, ordinal, path, owner, element, home, prefix = stack.pop()
        below = path if element or owner is None else owner
        whole = label is None and owner is None and type(value) in (dict, list)
        if whole or (type(value) is dict and element and name == label):
            home, count = count, count + 1
            for column, item in zip(out, (home, ordinal, path, owner, None, None), strict=True):
                column.append(item)
        if type(value) is dict:
            for key, child in value.items():
                if type(child) is dict:
                    clean = _clean(key)
                    if clean in lone:
                        stack.append((child, clean, 0, f"{path}.{clean}[0]", below, True, None, ()))
                    else:
                        stack.append((child, clean, None, f"{path}.{clean}", below, False, home, (*prefix, key)))
                elif type(child) is list:
                    clean = _clean(key)
                    stack.append((child, clean, None, f"{path}.{clean}", below, False, None, ()))
                elif home is not None and child is not None and (number := fields.get((*prefix, key))) is not None:
                    elements.append(home)
                    ordinals.append(None)
                    paths.append(None)
                    owners.append(None)
                    numbers.append(number)
                    texts.append(_kind(child)[1])
        elif type(value) is list:
            for index, child in enumerate(value):
                if type(child) is dict or type(child) is list:
                    stack.append((child, name or "$", index, f"{path}[{index}]", below, True, None, ()))
    return len(elements) - before


def flat(df: DataFrame, key: str, column: str, label: str | None, fields: dict[str, str], lone_keys: tuple[str, ...] = LONE_KEYS) -> DataFrame:
    """The flat table of one level with what its elements hold down to the next level: key, node_path, parent_path, ordinal and the fields.

    A field is named by its keys below the element joined by dots (attrs.load
    is the scalar load of the object attrs) and comes out with underscores; its
    value is as in `entities`. The parser stores only the adjacency rows of the
    label. Without a label, one row for each document that is an object or an
    array, which is the parent `$`.
    """
    kind = df.schema[key].dataType.simpleString()
    lone = frozenset(lone_keys)
    numbers = {tuple(name.split(".")): i for i, name in enumerate(fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        out: tuple[list, ...] = tuple([] for _ in range(6))
        held = None

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
            arrays = [pa.array(keys, held), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]
            keys.clear()
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "element", "ordinal", "path", "owner", "field", "scalar"])

        for batch in batches:
            held = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = parse(text)
                except ValueError:
                    continue
                keys.extend([name] * element_nodes(value, label, numbers, lone, out))
                if len(keys) >= BATCH_ROWS:
                    yield flush()
        if keys:
            yield flush()

    rows = df.select(key, column).where(F.col(column).isNotNull()).mapInArrow(run, f"key {kind}, element int, ordinal int, path string, owner string, field int, scalar string")
    links = [F.max(name).alias(alias) for name, alias in (("path", "node_path"), ("owner", "parent_path"), ("ordinal", "ordinal"))]
    grouped = rows.groupBy("key", "element").agg(*links, *(F.max(F.when(F.col("field") == i, F.col("scalar"))).alias(f"__{i}") for i in range(len(fields))))
    return grouped.select("key", "node_path", "parent_path", "ordinal", *(F.col(f"__{i}").try_cast(kind).alias(name.replace(".", "_")) for i, (name, kind) in enumerate(fields.items())))


def values(adjacency: DataFrame) -> DataFrame:
    """The scalars standing in arrays: key, parent_path, field (the array's key), ordinal, value."""
    found = adjacency.where("scalar IS NOT NULL AND ordinal IS NOT NULL")
    return found.select("key", F.col("owner").alias("parent_path"), F.col("label").alias("field"), "ordinal", F.col("scalar").alias("value"))
