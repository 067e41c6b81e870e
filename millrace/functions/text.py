"""Text rules as Column expressions: counts, cleaning, filters of text units, splitting, redaction.

Letter classes are spelled as Unicode categories, since plain ``\\w`` and ``\\b`` mean ASCII here.
Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that a search leaves out, in Spanish and English.
SEARCH_STOPWORDS = (
    "el la los las un una unos unas de del en y o para por con sin sobre que qué como cómo es ha han tengo tiene tienen este esta estos estas "
    "mi mis tu tus su sus lo le se ya muy más menos a al ni no si sí "
    "the a an of in on at to for with and or but is are was were be have has had this that these those i you he she it we they what which who where when why how"
).split()
# Kinds of entities that count, and those that need no capital letter.
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "LOC", "NORP", "EVENT", "FAC", "PRODUCT", "WORK_OF_ART", "LANGUAGE", "LAW")
ENTITY_FREE = ("NORP", "LANGUAGE")
# Headings of parts that aren't about the matter.
AUXILIARY_NAMES = (
    r"references?", r"bibliograph(?:y|ies)", r"works\s+cited", r"literature\s+cited", r"acknowledgements?", r"acknowledgments?",
    r"appendix(?:es)?", r"appendices", r"annex(?:es)?", r"about\s+the\s+authors?", r"author\s+bio(?:graph(?:y|ies))?", r"biograph(?:y|ies)",
    r"index", r"glossary", r"nomenclature", r"abbreviations?", r"funding", r"conflicts?\s+of\s+interest", r"disclosures?",
    r"copyright", r"licen[sc]e", r"disclaimer", r"legal\s+notice", r"footnotes?", r"endnotes?", r"notes?", r"citations?",
    r"further\s+reading", r"see\s+also", r"table\s+of\s+contents", r"toc", r"contents", r"publication\s+details?", r"colophon", r"imprint",
    r"erratum", r"errata", r"corrigend(?:um|a)", r"retraction",
)
#: The name alone, with a short label (Appendix A), or with a short title behind a colon or dash.
AUXILIARY = rf"(?i)^\s*(?:{'|'.join(AUXILIARY_NAMES)})(?:\s+[A-Za-z0-9][A-Za-z0-9.\-]*)?\s*(?:[:\-–—].{{0,60}})?\s*$"
# Marks that aren't odd symbols, besides letters and digits.
ALLOWED_MARKS = ".,;:!?'\"()[]{}<>#*_`~-–—/\\|@%&+=$€£¥…•·。、，！？：；「」『』（）《》〈〉〔〕・"
# A bullet, an ordered list mark or a letter mark at the start of a line.
BULLET = r"^\s*(?:[-*+•·▪◦‣∙]|\d+[.)]|[A-Za-z][.)])\s+"
# Names of values that must not be shown.
SECRET_NAMES = (
    "access[_-]?token", "api[_-]?key", "auth[_-]?token", "authorization", "cookie", "id[_-]?token", "password", "refresh[_-]?token", "session[_-]?token", "token",
)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tokens(text: str | Column) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(_col(text), r"\s+"), lambda x: x != "")


def word_count(text: str | Column) -> Column:
    return F.size(tokens(text))


def letter_word_count(text: str | Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.size(F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def collapsed(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def without_tags(text: str | Column) -> Column:
    """Tags out, the five basic entities decoded, blanks collapsed."""
    bare = F.regexp_replace(_col(text), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapsed(bare)


def without_blobs(text: str | Column) -> Column:
    """Data URIs as ``[image]``, runs of 2000 or more characters without blank as ``[blob]``."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"data:[a-zA-Z0-9+./;=-]*;base64,[A-Za-z0-9+/=\s]+", "[image]"), r"\S{2000,}", "[blob]")


def without_thinking(text: str | Column) -> Column:
    """Closed think blocks out; an open one drops the rest if something stands before it."""
    closed = F.regexp_replace(_col(text), r"(?is)<think>.*?</think>", "")
    head = F.trim(F.regexp_extract(closed, r"(?is)^(.*?)<think>", 1))
    return F.trim(F.when(closed.rlike("(?i)<think>") & (head != ""), head).otherwise(closed))


def char_budget(context: int, output: int) -> int:
    """Characters of a prompt that a model of ``context`` tokens takes beside its ``output``."""
    return max(512, context - output - 512) * 4


def first_chars(text: str | Column, most: int) -> Column:
    return F.substring(_col(text), 1, most)


def first_words(text: str | Column, most: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, most), " ")


def lines(text: str | Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(_col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs_html(text: str | Column) -> Column:
    """Each non-blank line as a paragraph element."""
    return F.array_join(F.transform(lines(text), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")


def sentences(text: str | Column) -> Column:
    """Pieces that end with a full stop, exclamation or question mark before a blank."""
    return F.filter(F.transform(F.split(_col(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def cleaned_items(text: str | Column) -> Column:
    """Items of a comma or line separated list, without list marks."""
    parts = F.transform(F.split(_col(text), r"[\n,]+"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(parts, lambda x: x != "")


def cleaned_sentence(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"^\s*(?:\d+[.)]|[-*•])\s*", ""))


# --- filters of text units; each says whether the unit stays


def long_enough(unit: str | Column) -> Column:
    return (word_count(unit) >= 4) | (F.length(F.regexp_replace(_col(unit), r"[^\p{L}\p{N}]", "")) >= 16)


def few_bullets(unit: str | Column) -> Column:
    """Not almost only list lines; a blank unit goes."""
    rows = F.filter(F.split(_col(unit), r"\r?\n"), lambda x: F.trim(x) != "")
    marked = F.size(F.filter(rows, lambda x: x.rlike(BULLET)))
    return F.when(F.size(rows) == 0, False).otherwise(marked / F.size(rows) <= 0.9)


def few_links(unit: str | Column) -> Column:
    """Not mostly links, by characters that aren't blank; a blank unit goes."""
    text = _col(unit)
    links = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\([^)]*\)|https?://\S+"), F.lit(0))
    inside = F.aggregate(links, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"\s", "")))
    filled = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(filled == 0, False).otherwise(inside / filled <= 0.5)


_NO_SYMBOL = r"[\s\p{L}\p{N}" + "".join("\\" + c if c in "[]{}()\\^-&|.*+?$" else c for c in ALLOWED_MARKS) + "]"


def few_symbols(unit: str | Column) -> Column:
    """Not dominated by odd symbols; a blank unit goes."""
    text = _col(unit)
    filled = F.length(F.regexp_replace(text, r"\s", ""))
    odd = F.length(F.regexp_replace(text, _NO_SYMBOL, ""))
    return F.when(filled == 0, False).otherwise(odd / filled <= 0.3)


UNIT_FILTERS: dict[str, Callable[[str | Column], Column]] = {
    "min_length": long_enough,
    "bullet_lines": few_bullets,
    "link_density": few_links,
    "symbol_ratio": few_symbols,
}
BUNDLES = {"basic": ("dedup", "min_length", "bullet_lines"), "web": ("dedup", "min_length", "bullet_lines", "link_density", "symbol_ratio")}


def normal_key(unit: str | Column) -> Column:
    return F.lower(collapsed(unit))


def deduplicated(units: DataFrame, document: str, position: str, unit: str) -> DataFrame:
    """The first of a document's units that are equal but for case and blanks."""
    first = Window.partitionBy(document, normal_key(unit)).orderBy(position)
    return units.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def filter_units(units: DataFrame, names: Sequence[str], document: str = "doc_id", position: str = "pos", unit: str = "unit") -> DataFrame:
    """Apply filters and bundles by name in order; unknown names are skipped.

    A filter that would leave a document without units changes nothing there.
    """
    wanted = [f for name in names for f in BUNDLES.get(name, (name,))]
    for name in wanted:
        if name == "dedup":
            units = deduplicated(units, document, position, unit)
        elif name in UNIT_FILTERS:
            keep = F.coalesce(UNIT_FILTERS[name](unit), F.lit(True))
            marked = units.withColumn("__keep", keep).withColumn("__kept", F.count_if("__keep").over(Window.partitionBy(document)))
            units = marked.where("__keep or __kept = 0").drop("__keep", "__kept")
    return units


def auxiliary_heading(unit: str | Column) -> Column:
    """Whether a unit's first line that isn't blank, without heading marks and numbers, names a side part."""
    head = F.trim(F.get(lines(unit), F.lit(0)))
    head = F.regexp_replace(head, r"^#{1,6}\s+", "")
    head = F.regexp_replace(head, r"(?i)^(?:\d+(?:\.\d+)*\.?\s+|(?:chapter|section)\s+\d+\s*[:\-–—]?\s*)", "")
    return F.coalesce(F.substring(head, 1, 80).rlike(AUXILIARY), F.lit(False))


def relevant_units(units: DataFrame, document: str = "doc_id", unit: str = "unit") -> DataFrame:
    """Units without those of side parts; a document of one unit, or of nothing else, stays whole."""
    every = Window.partitionBy(document)
    keep = ~auxiliary_heading(unit)
    marked = units.withColumns({"__keep": keep}).withColumns({"__kept": F.count_if(F.col("__keep")).over(every), "__all": F.count(F.lit(1)).over(every)})
    return marked.where("__keep or __kept = 0 or __all < 2").drop("__keep", "__kept", "__all")


def preview(unit: str | Column, most: int = 240) -> Column:
    """First line and the beginning of the rest, with a bar between."""
    text = F.trim(_col(unit))
    head = F.element_at(F.split(text, "\n"), 1)
    body = collapsed(F.substring(text, F.length(head) + 1, F.length(text)))
    return F.when(body != "", F.concat_ws(" | ", head, F.substring(body, 1, most))).otherwise(head)


# --- words that searches and extractions keep


def search_terms(text: str | Column, most: int = 4) -> Column:
    """The longest words of at least three letters that mean something, longest first, then as they stand."""
    words = F.split(F.lower(F.trim(_col(text))), r"[\s,.;:!?¿¡()\"']+")
    placed = F.transform(words, lambda x, at: F.struct((-F.length(x)).alias("n"), at.alias("at"), x.alias("w")))
    kept = F.filter(placed, lambda x: (F.length(x["w"]) >= 3) & ~x["w"].isin(*SEARCH_STOPWORDS))
    return F.transform(F.slice(F.array_sort(kept), 1, most), lambda x: x["w"])


def entity_valid(word: str | Column, label: str | Column) -> Column:
    w, kind = F.trim(_col(word)), F.upper(F.trim(_col(label)))
    return (F.length(F.trim(w)) > 1) & kind.isin(*ENTITY_LABELS) & (kind.isin(*ENTITY_FREE) | w.rlike(r"\p{Lu}"))


def predicate_name(text: str | Column) -> Column:
    return F.replace(F.lower(F.trim(_col(text))), F.lit(" "), F.lit("_"))


def snake_key(text: str | Column) -> Column:
    """Column key of a name: lower case, underscores, a prefix before a digit."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(text))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(slug.rlike("^[0-9]"), F.concat(F.lit("col_"), slug)).otherwise(slug)


# --- secrets in logs

def redacted(text: str | Column) -> Column:
    """Closed think blocks left out, bearer tokens and values of secret names replaced."""
    plain = F.regexp_replace(_col(text), r"(?is)<think>.*?</think>", "")
    plain = F.regexp_replace(plain, r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]")
    return F.regexp_replace(plain, rf"(?i)\b({'|'.join(SECRET_NAMES)})\s*[:=]\s*(?!\[REDACTED\])([^\s,;]+)", "$1=[REDACTED]")


def result_summary(text: str | Column, most: int = 200) -> Column:
    return F.substring(collapsed(redacted(text)), 1, most)


def content_hash(*columns: str) -> Column:
    """Hash of the columns as JSON with sorted keys, nulls left out."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256))


# --- parts of answers of a model


def tool_calls(text: str | Column) -> Column:
    """name and arguments (JSON) of each inline tool call; unreadable ones are left out."""
    blocks = F.regexp_extract_all(_col(text), F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    calls = F.transform(blocks, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda x: x["name"].isNotNull() & (x["name"] != ""))


def kept_indices(answer: str | Column, count: int) -> Column:
    """Numbers named in an answer that are valid positions below ``count``, sorted and distinct."""
    found = F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x < count))))
