"""Token ids of whole texts by a byte-level BPE vocabulary.

Merging keeps the ranks of all adjacent pairs of a piece in a segment tree: the root gives the
leftmost pair of the lowest rank, and each merge updates three leaves in logarithmic time, so a run
of n characters costs n log n and not n squared.  Pieces repeat, so their ids are kept per worker in
a table of bounded size; a piece that isn't in it is merged anew.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.session import spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
KEPT_PIECES = 400_000
KEPT_LENGTH = 64
NO_PAIR = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a vocabulary file with base64 token and rank on each line."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class RankTree:
    """Segment tree over the ranks of adjacent pairs; the root is the leftmost lowest."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = 1
        while self.size < len(ranks):
            self.size *= 2
        self.low = [NO_PAIR] * self.size + ranks + [NO_PAIR] * (self.size - len(ranks))
        for i in range(self.size - 1, 0, -1):
            a, b = self.low[2 * i], self.low[2 * i + 1]
            self.low[i] = a if a <= b else b

    def lowest(self) -> int:
        """Position of the leftmost lowest rank, or -1 if no pair can merge."""
        low = self.low
        want, i = low[1], 1
        if want == NO_PAIR:
            return -1
        while i < self.size:
            i *= 2
            if low[i] != want:
                i += 1
        return i - self.size

    def set(self, at: int, rank: int) -> None:
        low = self.low
        i = at + self.size
        low[i] = rank
        i //= 2
        while i:
            a, b = low[2 * i], low[2 * i + 1]
            new = a if a <= b else b
            if low[i] == new:
                break
            low[i] = new
            i //= 2


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merges the leftmost pair of the lowest rank until none is in the vocabulary."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    # A part starts at each kept place and ends where the next one starts.
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    tree = RankTree([get(piece[i : i + 2], NO_PAIR) for i in range(n - 1)])
    while (at := tree.lowest()) >= 0:
        gone = after[at]
        beyond = after[gone]
        after[at] = beyond
        if beyond < n:
            before[beyond] = at
        if gone < tree.size:
            tree.set(gone, NO_PAIR)
        tree.set(at, get(piece[at : after[beyond]], NO_PAIR) if beyond < n else NO_PAIR)
        left = before[at]
        if left >= 0:
            tree.set(left, get(piece[left:beyond], NO_PAIR))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


@cache
def piece_pattern() -> re.Pattern[str]:
    """Pieces of byte-level BPE: contractions, words, numbers, other marks and blanks.

    The classes of letters and numbers come from the Unicode categories, in ranges, which the
    standard engine searches much faster than property classes.
    """

    def ranges(kind: str) -> str:
        out, start = [], None
        for code in range(sys.maxunicode + 2):
            inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == kind
            if inside and start is None:
                start = code
            elif not inside and start is not None:
                out.append((start, code - 1))
                start = None
        return "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in out)

    letter, number = ranges("L"), ranges("N")
    # Code points with the White_Space property.
    blank = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    words = f" ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{words}|[{blank}]+(?![^{blank}])|[{blank}]+")


class Encoder:
    """Ids of texts; pieces up to ``KEPT_LENGTH`` characters are remembered, at most ``KEPT_PIECES``."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.kept: dict[str, list[int]] = {}
        self.find = piece_pattern().findall

    def piece(self, piece: str) -> list[int]:
        ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens, whose strings are ordinary text; null and empty text give none."""
        if not text:
            return []
        out: list[int] = []
        add, kept, slow = out.extend, self.kept, self.piece
        for piece in self.find(text):
            ids = kept.get(piece)
            add(slow(piece) if ids is None else ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per Python worker."""
    return Encoder(read_ranks(path))


def token_ids(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids of every document; null and empty texts have an empty list.

    One pass over the two columns, without shuffle; the vocabulary is read by each worker from
    ``tokenizers``, which every machine has.
    """
    path = f"{tokenizers}/{vocabulary}"
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            # Slices bound the ids held as Python integers; texts may be very long.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = [encode(text) for text in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    return spread(documents.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {id_type}, ids array<int>")
