"""Text garbled by a wrong decoding, and its original, by mappings learned from near-twins.

1. Names are the segments between slashes that hold non-ASCII characters,
   counted once each over the whole table. A character model (hashed bigrams and
   trigrams, of fixed size) is counted over all of them.
2. Names with equal ASCII characters are near-twins: text stripped of
   non-ASCII characters is the join key. Each name meets the most plausible name
   under its key; aligning the two by their ASCII characters gives pairs of
   garbled and clean runs, and every chain of decodings that turns all garbled
   runs of a name into the clean ones gains support.
3. Chains with support are the learned mappings. They are applied to all other
   names; a result is taken if it is more plausible by a margin. Names with
   U+FFFD have lost characters.

A chain is a sequence of (read as, written as): the text was bytes in `written
as`, decoded as `read as`. What goes to the driver is the model, of fixed size,
and a counter per chain of the inventory.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discatlas.runtime import cut

# The encodings between which text may have been misread.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866")
WRITTEN_AS = ("utf-8", *READ_AS)
#: All chains that are tried: one wrong decoding, or UTF-8 misread twice or three times.
CHAINS = tuple(((r, w),) for w in WRITTEN_AS for r in READ_AS if r != w) + tuple(((a, "utf-8"), (b, "utf-8")) for a in READ_AS[:5] for b in READ_AS[:5]) + ((("cp1252", "utf-8"),) * 3, (("latin-1", "utf-8"),) * 3)

LOST = "�"
MODEL_BITS = 18
_RUN = re.compile(r"[^\x00-\x7f]+")
_JOINERS = set("’‘–-·'")
_OPENED_BY = {"”": "“", "»": "«", "“": "„", "’": "‘"}


def encode_sloppy(text: str, encoding: str) -> bytes | None:
    """Bytes of text; code points below 256 that the encoding lacks stand for their own byte, as lenient decoders give them."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for char in text:
        try:
            out += char.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(char) < 0xA0:
                return None
            out.append(ord(char))
    return bytes(out)


@functools.lru_cache(maxsize=200_000)
def unread(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """text before the wrong decodings of chain, or None if they can't have given it."""
    for read, written in chain:
        data = encode_sloppy(text, read)
        if data is None or data.isascii():
            return None
        try:
            before = data.decode(written)
        except UnicodeDecodeError:
            return None
        if before == text:
            return None
        text = before
    return text


def skeleton(text: str) -> str:
    """text without its non-ASCII characters."""
    return _RUN.sub("", text)


def _script(char: str) -> str:
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x370 <= code < 0x400:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "other"


def oddity(text: str) -> float:
    """Penalty for shapes that readable names hardly have."""
    total = 0.0
    latin = 0
    for i, char in enumerate(text):
        code = ord(char)
        if code < 0x80:
            latin = 0
            continue
        before = text[i - 1] if i else ""
        after = text[i + 1] if i + 1 < len(text) else ""
        letter = char.isalpha()
        if code < 0xA0 or 0xE000 <= code < 0xF900 or char == LOST:
            total += 8
        elif 0x2500 <= code < 0x25A0:
            total += 6
        elif not letter and char not in _JOINERS and before.isalpha() and after.isalpha() and _OPENED_BY.get(char, "\n") not in text[:i]:
            total += 4
        if letter:
            kind = _script(char)
            latin = latin + 1 if kind == "latin" else 0
            if latin > 2:
                total += 1
            if char.isupper() and before.islower() and (ord(before) >= 0x80 or kind != "latin"):
                total += 3
            elif char.isupper() and before.islower():
                total += 1.5
            if kind in ("greek", "cyrillic") and before.isalpha() and _script(before) == "latin":
                total += 5
        else:
            latin = 0
    return total


def _slots(text: str) -> Iterator[int]:
    """Model slots of the bigrams and trigrams around non-ASCII characters; ASCII letters and digits count by class where they stand apart."""
    padded = f"\x02{text}\x03"
    for i, char in enumerate(padded):
        if ord(char) < 0x80:
            continue
        before, after = padded[i - 1], padded[i + 1]
        for gram in (before + char, char + after + "\x04", before + char + after):
            yield _hash(gram)
        yield _hash("\x05" + char)


@functools.lru_cache(maxsize=200_000)
def _hash(gram: str) -> int:
    value = 0
    for char in gram:
        value = (value * 1_000_003 + ord(char) + 7) & 0xFFFFFFFFFFFF
    value ^= value >> 23
    return (value * 0x9E3779B97F4A7C15 >> 40) & ((1 << MODEL_BITS) - 1)


class Model:
    """Plausibility of names by hashed counts over all names of a table."""

    def __init__(self, counts: np.ndarray, names: int):
        self.counts, self.names = counts, max(names, 1)

    def score(self, text: str) -> float:
        """Mean log frequency of the grams around non-ASCII characters, less the oddity per such character."""
        total, slots = 0.0, 0
        for slot in _slots(text):
            total += math.log((self.counts[slot] + 0.1) / (self.names + 1.0))
            slots += 1
        if not slots:
            return 0.0
        return total / slots - oddity(text) / max(1, sum(ord(c) >= 0x80 for c in text)) ** 0.5


#: Parts into which the rows of one name are split.
SPREAD = 4
#: How much more plausible a restored name must be, and what reading valid UTF-8 in it adds: bytes hardly form it by chance.
MARGIN = 0.7
UTF8_BONUS = 4.0


class Restorer:
    """The learned chains and the model; restores names one by one."""

    def __init__(self, model: Model, chains: list[tuple[tuple[str, str], ...]]):
        self.model, self.chains = model, chains
        self.known: dict[str, str | None] = {}

    def name(self, text: str) -> str | None:
        """The original of a garbled name, "" if characters are lost, None if the name is right."""
        if text.isascii():
            return None
        if LOST in text:
            return ""
        if text not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[text] = self._restore(text)
        return self.known[text]

    def _restore(self, text: str) -> str | None:
        best = text
        for turn in range(4):
            score, found = self.model.score(best), None
            gain = MARGIN
            for chain in self.chains:
                utf8 = chain[-1][1] == "utf-8"
                if turn and not utf8:
                    continue
                before = unread(best, chain)
                if before is None:
                    continue
                now = self.model.score(before) - score + UTF8_BONUS * utf8
                if now > gain:
                    gain, found = now, before
            if found is None:
                break
            best = found
        if best == text:
            return None
        return "" if LOST in best else best

    def field(self, text: str | None) -> str | None:
        """The same for a field of several segments."""
        if text is None or text.isascii():
            return None
        if LOST in text:
            return ""
        parts = text.split("/")
        found = [self.name(p) for p in parts]
        if "" in found:
            return ""
        if all(f is None for f in found):
            return None
        return "/".join(p if f is None else f for p, f in zip(parts, found, strict=True))


def _not_ascii(column: str) -> Column:
    return F.col(column).rlike(r"[^\x00-\x7F]")


def distinct_names(df: DataFrame, fields: list[str]) -> DataFrame:
    """Each segment of the fields that holds non-ASCII characters, once: name, skeleton."""
    parts = F.concat(*(F.coalesce(F.split(f, "/"), F.array().cast("array<string>")) for f in fields))
    names = df.select(F.explode(F.array_distinct(parts)).alias("name")).where(_not_ascii("name")).distinct()
    return names.withColumn("skeleton", F.regexp_replace("name", r"[^\x00-\x7F]+", ""))


def learn_model(names: DataFrame) -> Model:
    """Counts of hashed grams over all names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << MODEL_BITS, dtype=np.int64)
        total = 0
        for batch in batches:
            for name in batch["name"]:
                if LOST in name:
                    continue
                total += 1
                for slot in _slots(name):
                    counts[slot] += 1
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": np.append(used, -1), "n": np.append(counts[used], total)})

    counts = np.zeros(1 << MODEL_BITS, dtype=np.float64)
    total = 0
    for slot, n in names.select("name").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        if slot < 0:
            total = n
        else:
            counts[slot] = n
    return Model(counts, total)


def explain(garbled: str, clean: str) -> list[int]:
    """Numbers of the chains that turn each garbled run into the clean run it is aligned with."""
    if skeleton(garbled) != skeleton(clean):
        return []
    left, right = _RUN.findall(garbled), _RUN.findall(clean)
    if len(left) != len(right) or [m.start() for m in _RUN.finditer(_RUN.sub("\x00", garbled))] != [m.start() for m in _RUN.finditer(_RUN.sub("\x00", clean))]:
        return []
    return [i for i, chain in enumerate(CHAINS) if all(unread(a, chain) == b for a, b in zip(left, right, strict=True))]


def learn_chains(names: DataFrame, model: Model, support: int = 2) -> list[tuple[tuple[str, str], ...]]:
    """The chains that at least `support` near-twins show, most supported first."""
    shared = names.sparkSession.sparkContext.broadcast(model)

    def scores(column: pd.Series) -> pd.Series:
        return column.map(shared.value.score).astype("float64")

    scored = names.where(~F.col("name").contains(LOST)).withColumn("score", F.pandas_udf(scores, "double")("name"))
    best = scored.groupBy("skeleton").agg(F.max_by("name", F.struct("score", "name")).alias("clean"))
    twins = names.where(~F.col("name").contains(LOST)).join(best, "skeleton").where("name != clean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(CHAINS), dtype=np.int64)
        for batch in batches:
            for garbled, clean in zip(batch["name"], batch["clean"], strict=True):
                for number in explain(garbled, clean):
                    counts[number] += 1
        yield pd.DataFrame({"chain": np.flatnonzero(counts).astype(np.int32), "n": counts[counts > 0]})

    found = twins.select("name", "clean").mapInPandas(run, "chain int, n long").groupBy("chain").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    return [CHAINS[chain] for chain, _ in sorted(found.collect(), key=lambda r: (-r[1], r[0]))]


def restore(df: DataFrame, key: str, fields: list[str], support: int = 2) -> DataFrame:
    """Garbled fields and their originals: key, field_name, restored.

    restored is the whole field as it was before the wrong decoding, or the
    empty string if characters are lost (U+FFFD). One row of df per key is
    expected; repeated keys come out repeatedly. Null, empty and ASCII fields
    and names that are right give no rows. Where no near-twins show a decoding,
    only lost characters are reported.
    """
    kind = df.schema[key].dataType.simpleString()
    # Few bytes, much work: without a number of its own, adaptive execution would put the names into one task.
    lanes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = cut(distinct_names(df, fields).repartition(lanes, "name"))
    model = learn_model(names)
    shared = df.sparkSession.sparkContext.broadcast(Restorer(model, learn_chains(names, model, support)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = shared.value
        for batch in batches:
            parts = []
            for i, field in enumerate(fields):
                found = batch[f"field_{i}"].map(restorer.field, na_action="ignore")
                hit = found.notna()
                parts.append(pd.DataFrame({"key": batch.loc[hit, "key"], "field_name": field, "restored": found[hit]}))
            yield pd.concat(parts)

    wanted = df.select(F.col(key).alias("key"), *(F.col(f).alias(f"field_{i}") for i, f in enumerate(fields)))
    # A worker remembers names, so rows of one name go to few workers; a name that many rows bear is spread over SPREAD.
    placed = wanted.repartition(lanes, "field_0", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
    return placed.mapInPandas(run, f"key {kind}, field_name string, restored string")
