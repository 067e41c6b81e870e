"""Units, sections and chunks of texts, in Arrow batches.

Packing depends on what came before it in the text, so these run per text in Python, whole texts at
a time; the batch functions keep order and never meet other rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as rules
from millrace.functions.markup import blocks_of, looks_like_markup, markdown_of

_HEADING = re.compile(r"^#{1,6}\s+\S")


def count_words(text: str) -> int:
    return len(text.split())


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` words: at blank lines, then lines, then sentences, then words."""
    if count_words(text) <= most:
        return [text] if text.strip() else []
    for mark, joiner in (("\n\n", "\n\n"), ("\n", "\n"), (". ", ". ")):
        parts = [p for p in text.split(mark) if p.strip()]
        if len(parts) < 2:
            continue
        if mark == ". ":
            parts = [p if p.rstrip().endswith(".") or k == len(parts) - 1 else p + "." for k, p in enumerate(parts)]
            joiner = " "
        fine = [piece for part in parts for piece in split_long(part, most)]
        return pack(fine, most, joiner)
    words = text.split()
    return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]


def pack(units: Iterable[str], most: int, joiner: str = "\n\n") -> list[str]:
    """Units joined greedily while they hold at most ``most`` words together."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for unit in units:
        n = count_words(unit)
        if held and size + n > most:
            out.append(joiner.join(held))
            held, size = [], 0
        held.append(unit)
        size += n
    if held:
        out.append(joiner.join(held))
    return out


def greedy_chunks(text: str, most: int = 200) -> list[str]:
    """Paragraphs packed to ``most`` words; a longer paragraph stays whole."""
    return pack([p.strip() for p in re.split(r"\n\s*\n|\n", text) if p.strip()], most, "\n")


def chunk_units(units: Iterable[str], most: int) -> list[str]:
    """Units packed to ``most`` words; longer ones are split and packed again."""
    return pack([piece for unit in units for piece in split_long(unit, most)], most)


def sections(text: str) -> list[str]:
    """Units of a text: markup by headings or blocks, markdown by headings, other texts by blank lines."""
    if looks_like_markup(text):
        return section_blocks(blocks_of(text))
    found = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
    if any(_HEADING.match(line) for line in text.split("\n")):
        out: list[list[str]] = []
        for line in text.split("\n"):
            if _HEADING.match(line) or not out:
                out.append([])
            out[-1].append(line)
        return [unit for rows in out if (unit := "\n".join(rows).strip())]
    return found


def section_blocks(blocks: list[tuple[str, str]]) -> list[str]:
    """Blocks (tag, text) grouped under their headings, or one by one without headings."""
    if not any(tag[0] == "h" and tag[1:].isdigit() for tag, _ in blocks):
        return [text for _, text in blocks]
    out: list[list[str]] = []
    for tag, text in blocks:
        if (tag[0] == "h" and tag[1:].isdigit()) or not out:
            out.append([])
        out[-1].append(text)
    return ["\n".join(rows) for rows in out]


def overlapping_chunks(units: list[str], most: int = 250, target: int = 150, overlap: int = 30) -> list[str]:
    """Chunks for retrieval: a short text whole, otherwise packed to ``target`` words, each after the
    first beginning with the last ``overlap`` words of the one before."""
    if sum(map(count_words, units)) <= most:
        whole = "\n\n".join(u for u in units if u.strip())
        return [whole] if whole else []
    packed = pack([piece for unit in units for piece in split_long(unit, target)], target)
    out = packed[:1]
    for before, chunk in zip(packed, packed[1:]):
        out.append(" ".join(before.split()[-overlap:]) + "\n\n" + chunk if overlap else chunk)
    return out


def exploded(frame: DataFrame, cut: Callable[[str], list[str]], key: str = "doc_id", text: str = "text", name: str = "chunk") -> DataFrame:
    """key, pos (from 1), total and the pieces of each text; null and empty texts give no rows."""
    key_type = frame.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, totals, pieces = [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                found = cut(value) if value else []
                rows += [row] * len(found)
                places += range(1, len(found) + 1)
                totals += [len(found)] * len(found)
                pieces += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(totals, pa.int32()), pa.array(pieces, pa.string())],
                names=[key, "pos", "total", name],
            )

    return frame.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, pos int, total int, `{name}` string")


def chunked(frame: DataFrame, most: int = 250, target: int = 150, overlap: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Retrieval chunks of each text with their number and total."""
    return exploded(frame, lambda t: overlapping_chunks(sections(t), most, target, overlap), key, text)


def units(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Units of each text with their number and total."""
    return exploded(frame, sections, key, text, "unit")


def built_chunks(frame: DataFrame, filters: Sequence[str] = ("basic",), most: int = 1500, key: str = "doc_id", source: str = "text") -> DataFrame:
    """Chunks for a model: blobs out, markup to markdown, units filtered (never all of a text), packed to ``most`` words.

    The units of a text are collected again after filtering, so a text must fit into a task, as it did as one value.
    """
    plain = frame.where(F.col(source).isNotNull()).select(key, rules.without_blobs(source).alias("__t"))
    found = exploded(plain, lambda t: sections(markdown_of(t)), key, "__t", "unit")
    kept = rules.filter_units(found.select(key, "pos", "unit"), filters, key)
    packed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("u")).select(key, F.transform("u", lambda x: x["unit"]).alias("u"))

    @F.pandas_udf("array<string>")
    def pack_units(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: chunk_units(list(x), most))

    return packed.select(key, F.posexplode(pack_units("u")).alias("pos", "chunk"))


def chunk_offsets(whole: str, chunks: Sequence[str], head: int = 200) -> list[int]:
    """Where each chunk starts in its text, by its first ``head`` characters, looked for from the chunk before on; 0 if nowhere."""
    out, cursor = [], 0
    for chunk in chunks:
        at = whole.find(chunk[:head], cursor)
        if at < 0:
            at = whole.find(chunk[:head])
        out.append(max(at, 0))
        cursor = max(at, cursor)
    return out
