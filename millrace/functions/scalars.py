"""Scalar rules for declared types: guarded casts, rounding, labels and small formats.

All are Column expressions, so they stay inside generated code and can be pushed below shuffles.
Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?|nan))\s*$"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: str | Column, already: bool = False) -> Column:
    """Text as a double; null where it is no plain decimal number (``5d`` and ``0x1F`` are none).

    ``already`` tells that the column is numeric, which spares the pattern.
    """
    text = _col(value)
    if already:
        return text.cast("double")
    return F.when(text.cast("string").rlike(NUMBER), text.cast("string").try_cast("double"))


def finite(value: str | Column, digits: int = 6) -> Column:
    """Rounded to ``digits``; not-a-number and infinities become null."""
    x = _col(value).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, digits))


def truth(value: str | Column) -> Column:
    """Boolean of true/false, yes/no, 1/0 in any case; anything else, and a missing value, is null."""
    text = F.lower(F.trim(_col(value).cast("string")))
    return F.when(text.isin("true", "yes", "t", "y", "1", "1.0"), True).when(text.isin("false", "no", "f", "n", "0", "0.0"), False)


def moment(value: str | Column) -> Column:
    """Timestamp without zone of an ISO date or date-time; null where it is none."""
    return F.try_to_timestamp(_col(value).cast("string")).cast("timestamp_ntz")


def key_text(value: str | Column, numeric: bool = False) -> Column:
    """Foreign key as text: 5.0 and 5 are both ``5``."""
    x = _col(value)
    if not numeric:
        plain = F.regexp_extract(x.cast("string"), r"^\s*(-?[0-9]+)\.0*\s*$", 1)
        return F.when(plain != "", plain).otherwise(x.cast("string"))
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def duration_text(seconds: str | Column) -> Column:
    """Seconds as h:mm:ss, or m:ss below an hour."""
    total = F.floor(_col(seconds)).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).when(total.isNotNull(), F.format_string("%d:%02d", minutes, rest))


def cut_text(text: str | Column, most: int, mark: str = "…") -> Column:
    """Trimmed text of at most ``most`` characters, with a mark where something was cut off."""
    t = F.trim(_col(text))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(mark))).otherwise(t)


def owner_tag(kind: str | Column, key: str | Column) -> Column:
    return F.concat_ws(":", _col(kind), _col(key).cast("string"))


def source_key(kind: str | Column, key: str | Column) -> Column:
    """``doc_5``, ``knowledge_5``, ``indexed_file_5``; another kind counts as doc."""
    k = _col(kind)
    return F.concat(F.when(k.isin("knowledge", "indexed_file"), k).otherwise("doc"), F.lit("_"), _col(key).cast("string"))


def embedding_prefix(text: str | Column, query: bool = False) -> Column:
    """Text as asymmetric encoders want it."""
    return F.concat(F.lit("query: " if query else "passage: "), _col(text))


def typed_cell(value: str | Column, kind: str) -> Column:
    """An extracted cell as its declared type, in text form; null where it doesn't fit.

    Numbers without fraction lose it, booleans are true or false, dates are ISO days.
    """
    text = F.trim(_col(value).cast("string"))
    if kind == "number":
        x = number(text)
        return F.when(F.abs(x) != float("inf"), key_text(x, numeric=True))
    if kind == "boolean":
        return truth(text).cast("string")
    if kind in ("date", "datetime"):
        return F.date_format(moment(text), "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(text != "", text)


def reminder_valid(offset: str | Column, rule: str | Column) -> Column:
    """Whether an alarm offset (-10080 to 0 minutes) and a recurrence rule are acceptable; null counts as absent."""
    minutes, text = _col(offset), _col(rule)
    return F.coalesce(minutes.between(-10080, 0), F.lit(True)) & F.coalesce(text.startswith("FREQ="), F.lit(True))
