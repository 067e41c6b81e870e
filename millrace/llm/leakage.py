"""Held-out passages inside a corpus: which documents hold which test items.

Every window of ``WINDOW`` words of an item's passage and of a document has a SimHash fingerprint.
``WINDOW`` is the longest run that any reportable stretch must hold unchanged (14 words with at most
two changes have a run of five, 21 with three one of six), so the windows of both sides have one size and a leaked stretch
always has a window at distance zero.  Fingerprints are found by four Hamming blocks of 16 bits:
two that differ in at most three bits agree in a block, so none within the radius is missed.  Each
hit is then verified exactly: the words of document and passage are aligned along the hit's diagonal
and its neighbours, each word weighing one, and the stretch counts if it repeats at least
``LEAST_WORDS`` words in their order with at most one word in eight changed, dropped or added.

The corpus is read once per block of items, without shuffle, and every document is scanned as a
whole in vectorised slices.  The item index is broadcast; its size is checked, and a larger set of
items is worked off in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.normalise import plain_words
from millrace.session import spread

WINDOW = 5
RADIUS = 3
BLOCKS = 4
LEAST_WORDS = 14
#: Words of the passage for each edit, and edits of the alignments that are looked at: of any longer
#: stretch some piece of 14 to 27 words keeps the rule, and that has three at most.
WORDS_PER_EDIT = 7
EDITS = 3
#: Characters of item texts in one broadcast index.
INDEX_CHARS = 8_000_000
#: Words scanned at once, and words whose bits are remembered.
SLICE_WORDS = 60_000
KEPT_WORDS = 300_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def passages(items: DataFrame, id_column: str = "item_id", text_column: str = "item_text") -> DataFrame:
    """item id and words of each item's passage.

    Left out are the sentences before the passage that several items share, and a question after it;
    an item of nothing else stays whole.  Items with null id or without words give no row.
    """
    id_type = items.schema[id_column].dataType.simpleString()

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, str, bool]] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                parts = [s for s in _SENTENCE.split(text or "") if plain_words(s)]
                rows += [(row, at, " ".join(plain_words(s)), at == len(parts) - 1 and s.rstrip().endswith("?")) for at, s in enumerate(parts)]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())],
                names=["item", "at", "sentence", "question"],
            )

    sentences = items.where(F.col(id_column).isNotNull()).select(id_column, text_column).dropDuplicates()
    sentences = sentences.mapInArrow(split, f"item {id_type}, at int, sentence string, question boolean")
    shared = sentences.groupBy("sentence").agg(F.count_distinct("item").alias("holders")).where("holders > 1").select("sentence", F.lit(True).alias("shared"))
    marked = sentences.join(shared, "sentence", "left").withColumn("aside", F.coalesce("shared", F.lit(False)) | F.col("question"))
    # Shared sentences count as an instruction only while nothing of the passage has come yet.
    before = Window.partitionBy("item").orderBy("at")
    marked = marked.withColumn("begun", F.max(~F.col("aside")).over(before)).withColumn("body", F.col("begun") & ~F.col("question"))
    whole = Window.partitionBy("item")
    marked = marked.withColumn("keep", F.col("body") | ~F.max("body").over(whole))
    grouped = marked.where("keep").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("parts"))
    return grouped.select(F.col("item").alias(id_column), F.split(F.array_join(F.col("parts.sentence"), " "), " ").alias("words"))


class Signs:
    """Plus or minus one per fingerprint bit of each word, remembered for at most ``KEPT_WORDS`` words."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.bits = np.zeros((4096, 64), dtype=np.int8)

    def ids(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        out = [rows.get(w, -1) for w in words]
        if -1 in out:
            for at, word in enumerate(words):
                if out[at] < 0:
                    out[at] = self._add(word)
        return np.array(out, dtype=np.int32)

    def _add(self, word: str) -> int:
        row = self.rows.setdefault(word, len(self.rows))
        if row >= len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        digest = np.array([xxhash.xxh64_intdigest(word)], dtype=np.uint64).view(np.uint8)
        self.bits[row] = np.unpackbits(digest).astype(np.int8) * 2 - 1
        return row

    def prints(self, ids: np.ndarray) -> np.ndarray:
        """Fingerprint of the window that starts at each word; empty if there is no whole window."""
        count = len(ids) - WINDOW + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        bits = self.bits[ids]
        total = bits[:count].copy()
        for k in range(1, WINDOW):
            total += bits[k : k + count]
        return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


class ItemIndex:
    """Fingerprints of all passage windows, by the value of each 16-bit block."""

    def __init__(self, items: list[tuple[object, list[str]]]) -> None:
        self.items = items
        self.ready = False

    def prepare(self) -> None:
        """Build the tables, once per Python worker."""
        if self.ready:
            return
        self.signs = Signs()
        lists = [self.signs.ids(words) for _, words in self.items]
        self.base = len(self.signs.rows)
        self.lengths = np.array([len(x) for x in lists], dtype=np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.words = np.full((len(lists), self.longest), -2, dtype=np.int32)
        for row, ids in enumerate(lists):
            self.words[row, : len(ids)] = ids
        prints = [self.signs.prints(ids) for ids in lists]
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(lists)), [len(p) for p in prints])
        self.place = np.concatenate([np.arange(len(p)) for p in prints]) if prints else np.zeros(0, np.int64)
        self.order, self.first = [], []
        for block in range(BLOCKS):
            keys = self.block(self.prints, block)
            order = np.argsort(keys, kind="stable")
            self.order.append(order)
            self.first.append(np.searchsorted(keys[order], np.arange(65_537)))
        self.filled = [np.diff(first) > 0 for first in self.first]
        self.ready = True

    @staticmethod
    def block(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)

    def near(self, prints: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, index entry) whose fingerprints differ in at most ``RADIUS`` bits."""
        windows, entries = [], []
        for block in range(BLOCKS):
            keys = self.block(prints, block)
            at = np.nonzero(self.filled[block][keys] & valid)[0]
            first, last = self.first[block][keys[at]], self.first[block][keys[at] + 1]
            counts = last - first
            window = np.repeat(at, counts)
            offset = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
            entry = self.order[block][np.repeat(first, counts) + offset]
            close = np.bitwise_count(prints[window] ^ self.prints[entry]) <= RADIUS
            windows.append(window[close])
            entries.append(entry[close])
        return np.concatenate(windows), np.concatenate(entries)

    def aligned(self, ids: np.ndarray, owner: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether each (document, item, diagonal) has a stretch with enough words and few edits.

        ``best[e][d]`` is the most words repeated by an alignment that ends on diagonal ``d`` with ``e``
        edits; all candidates advance together, one passage word at a time.
        """
        found = np.zeros(len(doc), dtype=bool)
        span = range(-EDITS, EDITS + 1)
        best = np.zeros((EDITS + 1, len(span), len(doc)), dtype=np.int16)
        size = len(ids)
        for at in range(self.longest):
            wanted = self.words[item, at]
            before = best.copy()
            for d, offset in enumerate(span):
                place = shift + at + offset
                inside = (place >= 0) & (place < size)
                place = np.where(inside, place, 0)
                same = inside & (ids[place] == wanted) & (owner[place] == doc)
                # A word repeated, or changed while this diagonal still goes on.
                best[0, d] = np.where(same, before[0, d] + 1, 0)
                for e in range(1, EDITS + 1):
                    best[e, d] = np.where(same, before[e, d] + 1, before[e - 1, d])
            for e in range(1, EDITS + 1):
                # This word of the passage dropped, or a word of the text added behind it.
                best[e, :-1] = np.maximum(best[e, :-1], before[e - 1, 1:])
                best[e, 1:] = np.maximum(best[e, 1:], best[e - 1, :-1])
            for e in range(EDITS + 1):
                found |= best[e].max(axis=0) >= max(LEAST_WORDS, WORDS_PER_EDIT * e)
        return found

    def scan(self, texts: list[list[str]]) -> set[tuple[int, int]]:
        """Pairs of text and item rows in a slice of texts."""
        if len(self.signs.rows) > self.base + KEPT_WORDS:
            for word in list(self.signs.rows)[self.base :]:
                del self.signs.rows[word]
        words = [w for text in texts for w in text]
        if len(words) < WINDOW or not len(self.prints):
            return set()
        ids = self.signs.ids(words)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        prints = self.signs.prints(ids)
        valid = owner[: len(prints)] == owner[WINDOW - 1 :]
        windows, entries = self.near(prints, valid)
        if not len(windows):
            return set()
        windows, entries = np.divmod(np.unique(windows * len(self.prints) + entries), len(self.prints))
        doc, item, shift = owner[windows], self.item[entries], windows - self.place[entries]
        # A stretch with few enough edits has two unchanged windows at least (words less four for each of its runs).
        _, pair, hits = np.unique(doc * len(self.items) + item, return_inverse=True, return_counts=True)
        doc, item, shift = np.unique(np.stack([doc, item, shift])[:, hits[pair] >= 2], axis=1)
        kept: set[tuple[int, int]] = set()
        for start in range(0, len(doc), 20_000):
            part = slice(start, start + 20_000)
            good = self.aligned(ids, owner, doc[part], item[part], shift[part])
            kept.update(zip(doc[part][good].tolist(), item[part][good].tolist(), strict=True))
        return kept


def _scan_with(documents: DataFrame, index: ItemIndex, id_column: str, text_column: str, item_type: pa.DataType, item_name: str, item_sql: str) -> DataFrame:
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index.prepare()
        for batch in batches:
            docs: list[int] = []
            found: list[object] = []
            waiting: list[list[str]] = []
            rows: list[int] = []
            size = 0

            def flush() -> None:
                for text, item in sorted(index.scan(waiting)):
                    docs.append(rows[text])
                    found.append(index.items[item][0])
                waiting.clear()
                rows.clear()

            for row, text in enumerate(batch.column(1).to_pylist()):
                words = plain_words(text)
                if len(words) < WINDOW:
                    continue
                waiting.append(words)
                rows.append(row)
                size += len(words)
                if size >= SLICE_WORDS:
                    flush()
                    size = 0
            flush()
            ids = batch.column(0).take(pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, item_type)], names=[id_column, item_name])

    return spread(documents.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {id_type}, `{item_name}` {item_sql}")


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """doc_id, item_id of every document that holds a stretch of an item's passage, distinct.

    Null and empty texts hold nothing; a document row that occurs twice is scanned twice and reported once.
    """
    wanted = passages(items, item_column, item_text)
    chars = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // INDEX_CHARS))
    field = items.select(item_column).schema[0].dataType
    item_type = pa.int64() if field.simpleString() in ("bigint", "int", "smallint") else pa.string()
    parts = []
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64(item_column), F.lit(blocks)) == block).collect()
        index = ItemIndex(sorted(((r[item_column], list(r["words"])) for r in rows), key=lambda r: r[0]))
        parts.append(_scan_with(documents, index, id_column, text_column, item_type, item_column, "bigint" if item_type == pa.int64() else "string"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, n_documents: how many documents hold each item; items that leaked nowhere have 0, those without an id no row."""
    found = leaks(documents, items).groupBy("item_id").agg(F.count("doc_id").alias("n_documents"))
    every = items.select("item_id").where("item_id is not null").distinct()
    return every.join(found, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
