"""Splitting oversized texts at natural boundaries by dynamic programming.

Texts over `limit` tokens come out as ordered pieces of at most `limit`, each
after the first beginning with the last `overlap` tokens or fewer of the one
before. A dynamic program over every boundary position minimises cut penalties
(paragraph, line, sentence, word, inside a word) plus size imbalance; the result
is optimal over all boundaries between whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.llm import tokens

#: Penalty of a cut at a paragraph, line, sentence, word, and inside a word.
PENALTIES = np.array([0.0, 0.15, 0.4, 1.5, 6.0])
IMBALANCE = 1.0
#: Boundaries of one step of the dynamic program.
BLOCK = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 58, 59, 63]] = True


def classes(data: bytes, at: np.ndarray) -> np.ndarray:
    """Kind of boundary at byte offsets inside data: 0 paragraph .. 4 inside a word, 5 inside a character."""
    text = np.frombuffer(data, np.uint8)
    after, b1 = text[at], text[at - 1]
    b2 = np.where(at > 1, text[np.maximum(at - 2, 0)], 0)
    b3 = np.where(at > 2, text[np.maximum(at - 3, 0)], 0)
    line = (b1 == 10) & (after != 10) & (after != 13)
    paragraph = line & ((b2 == 10) | ((b2 == 13) & (b3 == 10)))
    sentence = (_STOP[b1] & _SPACE[after]) | (_STOP[b2] & _SPACE[b1])
    out = np.where(paragraph, 0, np.where(line, 1, np.where(sentence, 2, np.where(_SPACE[after] | _SPACE[b1], 3, 4))))
    return np.where((after & 0xC0) == 0x80, 5, out)


def _begins(kind: np.ndarray, cuts: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after each cut begins: the first word boundary of the overlap, else its first character, else the cut."""
    out = cuts.copy()
    if overlap:
        for most in (4, 3):  # the better kind is written last
            good = np.flatnonzero(kind <= most) + 1
            if len(good):
                first = good[np.minimum(np.searchsorted(good, np.maximum(1, cuts - overlap)), len(good) - 1)]
                inside = (first < cuts) & (first >= cuts - overlap)
                out[inside] = first[inside]
    return out


def cuts(kind: np.ndarray, total: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token spans (start, end) of the pieces; kind is the class of the boundary before each token 1..total-1.

    Boundaries are taken in blocks: the best way to each from those before the
    block is one matrix of costs, and the few ways inside a block are tried only
    where a piece so short could pay.
    """
    candidates = np.flatnonzero(kind <= 4) + 1
    begins = np.concatenate(([0], _begins(kind, candidates, overlap))).astype(np.float64)
    ends = np.append(candidates, total).astype(np.float64)
    count = max(2, -(-(total - overlap) // max(1, limit - overlap)))
    ideal = (total + (count - 1) * overlap) / count
    scale = IMBALANCE / ideal**2
    price = np.append(PENALTIES[kind[candidates - 1]], 0.0)
    low = np.searchsorted(begins, ends - limit)  # the first start from which a piece to this end is within the limit
    best = np.full(len(ends) + 1, np.inf)
    best[0] = 0.0
    previous = np.zeros(len(ends) + 1, dtype=np.int64)
    most = max(1.0, scale * (limit - ideal) ** 2)  # no two pieces differ by more in imbalance
    for first in range(0, len(ends), BLOCK):
        last = min(first + BLOCK, len(ends))
        lows, near = low[first:last], int(low[first])
        arrive, pick = np.full(last - first, np.inf), np.zeros(last - first, dtype=np.int64)
        if near <= first:
            # A start is of no use beside a later one that is better by what imbalance can make good.
            later = np.append(np.minimum.accumulate(best[near : first + 1][::-1])[::-1][1:], np.inf)
            starts = near + np.flatnonzero(best[near : first + 1] < later + most)
            if len(starts):
                cost = ends[first:last, None] - (begins[starts] + ideal)
                cost *= cost
                cost *= scale
                cost += best[starts]
                if starts[0] < lows[-1]:
                    cost[starts < lows[:, None]] = np.inf
                nth = cost.argmin(axis=1)
                arrive, pick = cost[np.arange(last - first), nth], starts[nth]
        # A way inside the block ends in a piece shorter than the block is wide.
        widest = min(ends[last - 1] - begins[first + 1], limit) if last > first + 1 else 0
        shortest = scale * max(0.0, ideal - widest) ** 2
        reached = arrive + price[first:last]
        if not (reached.min() + shortest >= arrive.max() and np.isfinite(arrive.max())):
            for j in range(last - first):
                since = max(int(lows[j]), first + 1)
                if since <= first + j:  # starts at the boundaries first .. first + j - 1 of this block
                    inside = scale * (ends[first + j] - begins[since : first + j + 1] - ideal) ** 2 + reached[since - first - 1 : j]
                    nth = int(inside.argmin())
                    if inside[nth] < arrive[j]:
                        arrive[j], pick[j] = inside[nth], since + nth
                reached[j] = arrive[j] + price[first + j]
        best[first + 1 : last + 1] = reached
        previous[first + 1 : last + 1] = pick
    if not np.isfinite(best[-1]):
        raise ValueError("no boundary within the limit")
    spans, at = [], len(ends)
    while at > 0:
        before = int(previous[at])
        spans.append((int(begins[before]), int(ends[at - 1])))
        at = before
    return spans[::-1]


def split(text: str, limit: int, overlap: int, path: str) -> list[tuple[int, int, str]]:
    """The pieces of a text over the limit as (overlapping tokens, tokens, text); none of a text within it."""
    data = text.encode()
    if len(data) <= limit:  # a token has at least one byte
        return []
    ids = tokens.encode(text, path)
    if len(ids) <= limit:
        return []
    at = np.array(tokens.offsets(ids, path))
    kind = classes(data, at[1:-1])
    allowed = limit
    while True:
        # A piece by itself can have more tokens than its span of the text: then spans get shorter until all fit.
        spans = cuts(kind, len(ids), allowed, overlap)
        pieces = [data[at[a] : at[b]].decode() for a, b in spans]
        sizes = [len(tokens.encode(piece, path)) for piece in pieces]
        if max(sizes) <= limit:
            break
        allowed -= max(1, min(max(sizes) - limit, (allowed - overlap) // 4))
    over = [0, *(spans[i - 1][1] - spans[i][0] for i in range(1, len(spans)))]
    return list(zip(over, sizes, pieces, strict=True))


def pieces(documents: DataFrame, limit: int = 1024, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", vocabulary: str = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}") -> DataFrame:
    """Pieces of the documents over `limit` tokens: doc_id, piece_no from 0, n_overlap, n_tokens, piece.

    Without their overlaps the pieces of a document joined in order are its
    text. Documents within the limit, null and empty texts give no rows; a
    repeated doc_id is split as often as it occurs. vocabulary is a file that
    every worker can read. limit must exceed twice the overlap and be at least 8.
    """
    if limit < 8 or overlap < 0 or limit <= 2 * overlap:
        raise ValueError("limit must be at least 8 and exceed twice the overlap")
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [])
            for number, value in enumerate(batch.column(1)):
                for nth, (over, size, piece) in enumerate(split(value.as_py(), limit, overlap, vocabulary)):
                    rows.append(number)
                    for column, item in zip(columns, (nth, over, size, piece), strict=True):
                        column.append(item)
            if rows:
                types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "piece_no", "n_overlap", "n_tokens", "piece"])

    schema = f"doc_id {kind}, piece_no int, n_overlap int, n_tokens int, piece string"
    return documents.select(doc_id, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
