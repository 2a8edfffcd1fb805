"""Filling containers of fixed capacity by Karmarkar-Karp multiway differencing.

Items are spread by hash over windows of about `per_window` containers. In a
window the largest differences are merged first: two partial partitions are
combined so that the large parts of one meet the small parts of the other, which
ends in near-equal containers. If one exceeds the capacity, the number of
containers rises and the window is solved again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.llm import tokens
from discatlas.runtime import cut


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Indexes of sizes in `ways` groups of near-equal sums (largest differencing method)."""
    # A partial partition: its non-empty groups as (sum, tree of indexes), largest first; the others are empty.
    heap: list[tuple[int, int, list]] = []
    serial = 0
    for index, size in enumerate(sizes):
        if size > 0:
            heap.append((-size, serial, [(size, index)]))
            serial += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= ways:
            merged = a + b
        else:
            met = len(a) + len(b) - ways  # so many groups of a and b are both non-empty
            small_a, small_b = a[-met:], b[-met:]
            merged = a[:-met] + b[:-met]
            # The smallest kept group of one meets the largest of those that must meet of the other.
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(small_a, reversed(small_b), strict=True)]
        merged.sort(key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        if len(merged) == ways and merged[-1][0]:
            floor = merged[-1][0]
            heapq.heappush(heap, (-(merged[0][0] - floor), serial, merged))
        else:
            heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    groups: list[list[int]] = [[] for _ in range(ways)]
    if heap:
        for place, (_, tree) in enumerate(heap[0][2]):
            stack = [tree]
            while stack:
                node = stack.pop()
                if type(node) is tuple:
                    stack.extend(node)
                else:
                    groups[place].append(node)
    for index, size in enumerate(sizes):
        if size <= 0:
            groups[index % ways].append(index)
    return groups


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indexes whose sizes don't exceed capacity; every size must fit."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    def attempt(ways: int) -> list[list[int]] | None:
        groups = difference(sizes, ways)
        return groups if max(sum(sizes[i] for i in g) for g in groups) <= capacity else None

    # The number rises in growing steps until it is enough, then the last step is halved down.
    short = max(1, math.ceil(sum(sizes) / capacity), sum(2 * s > capacity for s in sizes)) - 1
    step = 1
    while (found := attempt(short + step)) is None:
        short, step = short + step, step * 2
    enough = short + step
    while enough - short > 1:
        middle = (short + enough) // 2
        if (better := attempt(middle)) is None:
            short = middle
        else:
            enough, found = middle, better
    return found


def sized_pieces(documents: DataFrame, capacity: int, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """Token spans to be packed: doc_id, piece_no, token_start, n_tokens; only texts over capacity have several."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nth, start, size = [], [], [], []
            for number, value in enumerate(batch.column(1)):
                content = value.as_py() or ""
                ids = tokens.encode(content, vocabulary)
                at, count = 0, 0
                bounds: set[int] | None = None
                while True:
                    end = min(len(ids), at + capacity)
                    if end < len(ids):  # a piece ends where a character does
                        if bounds is None:
                            data, offsets = content.encode(), tokens.offsets(ids, vocabulary)
                            bounds = {i for i, o in enumerate(offsets) if o == len(data) or (data[o] & 0xC0) != 0x80}
                        while end not in bounds and end > at + 1:
                            end -= 1
                    rows.append(number)
                    nth.append(count)
                    start.append(at)
                    size.append(end - at)
                    at, count = end, count + 1
                    if at >= len(ids):
                        break
            arrays = [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, pa.int32()) for c in (nth, start, size))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece_no", "token_start", "n_tokens"])

    return documents.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece_no int, token_start int, n_tokens int")


def pack(documents: DataFrame, capacity: int = 2048, per_window: int = 512, doc_id: str = "doc_id", text: str = "text", vocabulary: str = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}") -> DataFrame:
    """Container and position of each document or piece.

    Columns: container_id, position and offset in it, doc_id, piece_no,
    token_start and n_tokens. A document within the capacity is one piece; a
    longer one is cut every `capacity` tokens, at the next whole character
    before. Blank and null texts are pieces of no tokens, which take a position
    but no room. Repeated documents are packed as often as they occur. An empty
    table gives no containers.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    sized = cut(sized_pieces(documents, capacity, doc_id, text, vocabulary))
    total, count = sized.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    windows = max(1, round((total or 0) / (capacity * per_window)), math.ceil(count / (per_window * 64)))
    # Copies are counted and numbered, so the windows don't depend on the layout of the files and a document repeated often is spread.
    alike = sized.groupBy("doc_id", "piece_no", "token_start", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    numbered = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    spread = numbered.withColumn("window", F.pmod(F.xxhash64("doc_id", "piece_no", "copy"), F.lit(windows)).cast("int"))
    spread = spread.select("window", "copy", "doc_id", "piece_no", "token_start", "n_tokens").repartitionById(windows, "window")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "copy", "piece_no"], kind="stable").reset_index(drop=True)
        rows = []
        for number, group in enumerate(fill(frame["n_tokens"].tolist(), capacity)):
            at = 0
            for place, index in enumerate(sorted(group)):
                rows.append((number, place, at, index))
                at += int(frame["n_tokens"].iat[index])
        made = pd.DataFrame(rows, columns=["number", "position", "offset", "row"])
        picked = frame.iloc[made["row"]].reset_index(drop=True)
        picked["container_id"] = picked["window"].astype("int64") * (1 << 24) + made["number"]
        picked["position"], picked["offset"] = made["position"], made["offset"]
        return picked[["container_id", "position", "offset", "doc_id", "piece_no", "token_start", "n_tokens"]]

    schema = f"container_id long, position int, offset int, doc_id {kind}, piece_no int, token_start int, n_tokens int"
    return spread.groupBy("window").applyInPandas(solve, schema)
