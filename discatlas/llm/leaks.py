"""Evaluation passages inside documents, by Wu-Manber multi-pattern search over words.

A passage counts where a document and an item share at least `run` consecutive
words; words are the maximal runs of a-z and 0-9 of the lower-cased text. Each
item is cut into aligned blocks of ceil(run / 2) words: any shared run holds at
least one whole block, so the blocks are the patterns. The shift table of
two-word blocks skips positions where no pattern can end, the bucket of the last
two words selects patterns, and direct comparison of words, to both sides of the
block, confirms that `run` words agree.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9]+")
#: Bytes of item text that one pattern table may hold; more items are searched in further blocks.
BLOCK_BYTES = 16 << 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Patterns:
    """Shift table and suffix buckets of a block of items."""

    def __init__(self, items: list[tuple[object, str]], run: int = 13):
        if run < 3:
            raise ValueError("run must be at least 3 words")
        self.run, self.length = run, (run + 1) // 2
        self.items = [(name, found) for name, text in items if len(found := words(text)) >= run]
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for number, (_, found) in enumerate(self.items):
            for start in range(0, len(found) - self.length + 1, self.length):
                pattern = tuple(found[start : start + self.length])
                for end in range(1, self.length):
                    block = pattern[end - 1], pattern[end]
                    self.shift[block] = min(self.shift.get(block, self.length), self.length - 1 - end)
                self.buckets.setdefault(pattern[-2:], {}).setdefault(pattern, []).append((number, start))

    def search(self, text: str) -> set[int]:
        """Numbers of the items that share a run of words with text."""
        found = words(text)
        shift, buckets, length, default = self.shift, self.buckets, self.length, self.length - 1
        hits: set[int] = set()
        at, end = length - 1, len(found)
        while at < end:
            block = found[at - 1], found[at]
            step = shift.get(block, default)
            if step == 0:
                places = buckets.get(block)
                if places is not None:
                    for number, start in places.get(tuple(found[at - length + 1 : at + 1]), ()):
                        if number not in hits and self._agrees(found, at - length + 1, self.items[number][1], start):
                            hits.add(number)
                step = 1
            at += step
        return hits

    def _agrees(self, text: list[str], at: int, item: list[str], start: int) -> bool:
        total, back = self.length, 1
        while total < self.run and back <= min(at, start) and text[at - back] == item[start - back]:
            total, back = total + 1, back + 1
        ahead = self.length
        while total < self.run and at + ahead < len(text) and start + ahead < len(item) and text[at + ahead] == item[start + ahead]:
            total, ahead = total + 1, ahead + 1
        return total >= self.run


def leaks(documents: DataFrame, items: DataFrame, run: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (doc_id, item_id) that share at least `run` consecutive words, once.

    Items are gathered on the driver in blocks of about block_bytes, each
    searched in all documents, so what is sent to the workers is bounded. Null
    or short texts share nothing; rows repeated under one id count together;
    null ids stay as null. Texts of any length are searched whole.
    """
    known = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item")).where("item IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    context = documents.sparkSession.sparkContext
    parts = []
    for number in range(blocks):
        block = known.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == number)
        shared = context.broadcast(Patterns([tuple(r) for r in block.toLocalIterator()], run))

        def run_batches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            held = pa.array([name for name, _ in patterns.items])
            for batch in batches:
                docs, hits = [], []
                for at, value in enumerate(batch.column(1)):
                    for hit in patterns.search(value.as_py()):
                        docs.append(at)
                        hits.append(hit)
                if docs:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), held.take(pa.array(hits))], names=["doc_id", "item_id"])

        parts.append(documents.select(doc_id, text).where(F.col(text).isNotNull()).mapInArrow(run_batches, f"doc_id {kinds[0]}, item_id {kinds[1]}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
