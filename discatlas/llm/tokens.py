"""Tokens of a public byte-level BPE vocabulary, counted in the workers."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: Folder of the installed vocabularies and the file of the default one; both are parameters everywhere.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a vocabulary file, read once per worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space from this length are encoded apart: the pattern's search backtracks over them and gives up beyond a million.
LONG_RUN = 100_000
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@functools.lru_cache(maxsize=4)
def _long_runs(length: int) -> re.Pattern:
    return re.compile(f"{_SPACE}{{{length},}}")


def encode(text: str, path: str, long_run: int = LONG_RUN) -> list[int]:
    """Token ids of text read as ordinary text.

    Of a run of white space the pattern takes all but the last character as one
    piece, or all of it at the end of the text. Cutting there changes nothing.
    """
    enc = encoding(path)
    if len(text) < long_run or not (found := _long_runs(long_run).search(text)):
        return enc.encode_ordinary(text)
    out, at = [], 0
    while found:
        end = found.end() if found.end() == len(text) else found.end() - 1
        out += enc.encode_ordinary(text[at : found.start()])
        out += enc._encode_single_piece(text[found.start() : end])
        at = end
        found = _long_runs(long_run).search(text, end)
    return out + enc.encode_ordinary(text[at:])


@functools.lru_cache(maxsize=4)
def _lengths(path: str) -> np.ndarray:
    """Bytes of every token of a vocabulary."""
    enc = encoding(path)
    out = np.zeros(enc.max_token_value + 1, dtype=np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def offsets(ids: list[int], path: str) -> list[int]:
    """Byte offset at which each token begins, and the end."""
    return [0, *np.cumsum(_lengths(path)[np.array(ids, dtype=np.int64)]).tolist()]
