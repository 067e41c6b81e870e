"""Sources: tables of JSON records, files of many kinds, and the vector, graph and log tables."""

from __future__ import annotations

import email
import email.policy
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.markup import page_fields
from millrace.functions.scalars import moment, number, truth
from millrace.functions.text import paragraphs_html


@dataclass(frozen=True)
class Field:
    """One declared column of a data set."""

    key: str
    type: str = "text"
    name: str | None = None
    linked_dataset: int | None = None
    linked_display: str | None = None
    linked_lookup: str | None = None


@dataclass(frozen=True)
class DatasetSchema:
    """Declared columns; lenient: missing keys are null, undeclared ones may be asked for as text."""

    fields: tuple[Field, ...]
    extra: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        return [f.key for f in self.fields] + list(self.extra)


def typed_records(records: DataFrame, schema: DatasetSchema, data: str = "data", key: str = "id") -> DataFrame:
    """``_id`` and a column per declared field, each by its guarded cast; unreadable JSON gives nulls.

    All wanted keys are parsed at once as text, so only they are materialised.
    """
    plain = ", ".join(f"`{n}` string" for n in schema.names())
    parsed = records.select(F.col(key).alias("_id"), F.from_json(data, plain).alias("r"))
    casts = {"number": number, "boolean": truth, "date": moment, "datetime": moment}
    columns = [casts.get(f.type, lambda c: c)(F.col(f"r.`{f.key}`")).alias(f.key, metadata={"name": f.name or f.key}) for f in schema.fields]
    return parsed.select("_id", *columns, *(F.col(f"r.`{n}`").alias(n) for n in schema.extra))


def load_dataset(spark: SparkSession, path: str, dataset: object, schema: DatasetSchema) -> DataFrame:
    """Records of one data set of a records table; the condition on dataset_id reaches the scan."""
    records = spark.read.parquet(path).where(F.col("dataset_id") == dataset)
    if records.isEmpty():
        raise ValueError(f"data set {dataset} has no records")
    return typed_records(records, schema)


def load_datasets(spark: SparkSession, path: str, schemas: dict[object, DatasetSchema]) -> list[tuple[DatasetSchema, DataFrame]]:
    """The data sets that have records; others are left out."""
    out = []
    for dataset, schema in schemas.items():
        records = spark.read.parquet(path).where(F.col("dataset_id") == dataset)
        if not records.isEmpty():
            out.append((schema, typed_records(records, schema)))
    return out


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, csv, json, text or jdbc; a declared schema spares the pass that infers one."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


# --- files

MEDIA = ("mp3", "wav", "ogg", "flac", "m4a", "aac", "opus", "wma", "mp4", "mkv", "webm", "avi", "mov", "mpeg", "mpg", "m4v", "3gp")
FILE = "path string, kind string, title string, author string, date string, content string, error string"


def _text(data: bytes) -> str:
    for code in ("utf-8", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _paragraphs(text: str) -> str:
    return "\n".join(f"<p>{line.strip()}</p>" for line in text.splitlines() if line.strip())


def _mail(data: bytes) -> dict[str, str | None]:
    """Headers and body of a mail: markup if there is some, else text; attachments are left out."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    body = message.get_body(preferencelist=("html", "plain"))
    content = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/plain":
        content = _paragraphs(content)
    heads = [(n, str(message[n])) for n in ("From", "To", "Cc", "Date", "Subject") if message[n]]
    block = "\n".join(f"<p><strong>{n}:</strong> {v}</p>" for n, v in heads)
    return {"title": message["Subject"] and str(message["Subject"]), "author": message["From"] and str(message["From"]), "date": message["Date"] and str(message["Date"]), "content": f"{block}\n{content}".strip()}


def _archive(data: bytes) -> dict[str, str | None]:
    """Root page of a saved web page: the one named by ``start``, else the longest."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    pages = [p for p in message.walk() if p.get_content_type() == "text/html"]
    if not pages:
        return {"title": None, "author": None, "date": None, "content": ""}
    start = (message.get_param("start") or "").strip("<>")
    root = next((p for p in pages if start and start in ((p["Content-ID"] or "").strip("<>"), p["Content-Location"] or "")), None)
    root = root or max(pages, key=lambda p: len(p.get_content()))
    found = page_fields(root.get_content())
    found["title"] = found["title"] or (message["Subject"] and str(message["Subject"]))
    return found


def _open_document(data: bytes) -> dict[str, str | None]:
    """Metadata, headings, paragraphs and lists of an OpenDocument text."""
    office = {"text": "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}", "dc": "{http://purl.org/dc/elements/1.1/}"}
    with zipfile.ZipFile(BytesIO(data)) as archive:
        content = ElementTree.fromstring(archive.read("content.xml"))
        meta = ElementTree.fromstring(archive.read("meta.xml")) if "meta.xml" in archive.namelist() else None

    def named(tag: str) -> str | None:
        found = meta.find(f".//{office['dc']}{tag}") if meta is not None else None
        return found.text if found is not None else None

    rows = []
    listed = {p for item in content.iter(f"{office['text']}list-item") for p in item.iter(f"{office['text']}p")}
    for node in content.iter():
        text = "".join(node.itertext()).strip()
        if not text:
            continue
        if node.tag == f"{office['text']}h":
            level = node.get(f"{office['text']}outline-level", "1")
            rows.append(f"<h{level}>{text}</h{level}>")
        elif node.tag == f"{office['text']}p":
            rows.append(f"<li>{text}</li>" if node in listed else f"<p>{text}</p>")
    return {"title": named("title"), "author": named("creator"), "date": named("date"), "content": "\n".join(rows)}


def parse_file(path: str, data: bytes) -> dict[str, str | None]:
    """Fields of a file by its extension; what can't be read has an error and no content."""
    kind = re.sub(r"^.*\.", "", path.lower()) if "." in path.rpartition("/")[2] else ""
    out: dict[str, str | None] = {"path": path, "kind": kind, "title": None, "author": None, "date": None, "content": None, "error": None}
    try:
        if kind in ("html", "htm"):
            out |= page_fields(_text(data))
        elif kind in ("txt", "md", "csv"):
            out["content"] = _paragraphs(_text(data))
        elif kind == "eml":
            out |= _mail(data)
        elif kind in ("mht", "mhtml"):
            out |= _archive(data)
        elif kind == "odt":
            out |= _open_document(data)
        elif kind in ("pdf", "doc", "docx") or kind in MEDIA:
            out["error"] = f"no parser for {kind} here"
        else:
            out["error"] = f"unknown kind of file: {kind or 'none'}"
    except Exception as error:  # noqa: BLE001 - one bad file must not end the scan
        out["error"] = f"{type(error).__name__}: {error}"[:300]
    return out


def parse_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Parsed rows of a binary-file scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FILE.split(", ")]
        for batch in batches:
            yield pd.DataFrame([parse_file(p, bytes(d or b"")) for p, d in zip(batch[path], batch[content], strict=True)], columns=names)

    return files.select(path, content).mapInPandas(run, FILE)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files below a folder, parsed by kind."""
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def text_pages(frame: DataFrame, text: str = "text") -> DataFrame:
    """Plain texts as pages, by expressions alone."""
    return frame.withColumn("content", paragraphs_html(text))


# --- sinks

LEADING_ZERO = r"^\s*[+-]?0[0-9]+"


def spreadsheet_cell(column: str) -> Column:
    """A text cell as a number where it is one; with a leading zero it stays text (null here)."""
    return F.when(~F.col(column).rlike(LEADING_ZERO), number(column))


def write_table(frame: DataFrame, path: str, kind: str = "parquet", partition: Sequence[str] = (), mode: str = "error") -> None:
    """parquet, orc, csv, json or text files; partitioned by columns of few values if given."""
    writer = frame.write.format(kind).mode(mode)
    (writer.partitionBy(*partition) if partition else writer).save(path)
