"""Date expressions in texts of five languages: kind, precision, resolution, place and merging."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and their beginnings by month, in English, Spanish, French, German, Italian.
MONTHS = {
    1: "january jan enero janvier januar gennaio", 2: "february feb febrero février fevrier februar febbraio", 3: "march mar marzo mars märz maerz",
    4: "april apr abril avril aprile", 5: "may mayo mai maggio", 6: "june jun junio juin juni giugno", 7: "july jul julio juillet juli luglio",
    8: "august aug agosto août aout", 9: "september sep sept septiembre septembre settembre", 10: "october oct octubre octobre oktober ottobre",
    11: "november nov noviembre novembre", 12: "december dec diciembre décembre decembre dezember dicembre",
}
# Days of the week.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday lunes martes miércoles miercoles jueves viernes sábado sabado domingo lundi mardi mercredi jeudi vendredi samedi dimanche "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lunedì martedì mercoledì giovedì venerdì sabato domenica"
).split()
# Words that stand for a day, and words and units of relative dates.
STANDALONE = {
    "today": 0, "hoy": 0, "aujourd'hui": 0, "heute": 0, "oggi": 0, "yesterday": -1, "ayer": -1, "hier": -1, "gestern": -1, "ieri": -1,
    "tomorrow": 1, "mañana": 1, "demain": 1, "morgen": 1, "domani": 1,
}
MARKERS = (
    r"hace", r"dentro de", r"que viene", r"pr[oó]xim\p{L}*", r"pasad\p{L}*", r"ago", r"in", r"next", r"last", r"within", r"vor", r"n[aä]chst\p{L}*", r"letzt\p{L}*",
    r"il y a", r"dans", r"prochain\p{L}*", r"dernier\p{L}*", r"fa", r"tra", r"fra", r"prossim\p{L}*", r"scors\p{L}*",
)
STANDALONE_WORDS = (
    "ayer hoy mañana manana anteayer anoche yesterday today tomorrow tonight gestern heute morgen vorgestern hier aujourd'hui demain avant-hier ieri oggi domani stanotte"
).split()
TIME_UNITS = (
    r"d[ií]as?", r"semanas?", r"meses", r"mes", r"a[nñ]os?", r"horas?", r"minutos?", r"d[eé]cadas?", r"siglos?",
    r"days?", r"weeks?", r"months?", r"years?", r"hours?", r"minutes?", r"decades?", r"centur(?:y|ies)",
    r"tage?n?", r"wochen?", r"monate?n?", r"jahre?n?", r"stunden?", r"minuten?", r"jahrzehnte?n?",
    r"jours?", r"semaines?", r"mois", r"ann[eé]es?", r"heures?", r"d[eé]cennies?", r"si[eè]cles?",
    r"giorni?", r"settimane?", r"mesi", r"anni?", r"ore", r"ora", r"minuti?", r"decenni?", r"secoli?",
)
UNITS = {
    "day": "day days día dia días dias jour jours tag tage tagen giorno giorni", "week": "week weeks semana semanas semaine semaines woche wochen settimana settimane",
    "month": "month months mes meses mois monat monate monaten mese mesi", "year": "year years año años an ans année années jahr jahre jahren anno anni",
}

_MONTH_WORDS = {word: month for month, words in MONTHS.items() for word in words.split()}
_MONTH = "|".join(sorted(_MONTH_WORDS, key=len, reverse=True))
_EDGE = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
_UNIT_WORDS = {word: unit for unit, words in UNITS.items() for word in words.split()}
# What stands between the two ends of a range.
RANGE = r"(?i)\s+(?:-|–|—|to|al|hasta|a|y|and|e|until|till)\s+|\s*-\s*|\s*–\s*|\s*—\s*"
YEAR = r"(?<![\p{L}\p{N}_])(?:1[0-9]{3}|2[0-9]{3})(?![\p{L}\p{N}_])"
NUMERIC = r"(?<![\p{L}\p{N}_])(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})(?![\p{L}\p{N}_])"
DAY_NUMBER = r"(?<![\p{L}\p{N}_])(?:0?[1-9]|[12]\d|3[01])(?![\p{L}\p{N}_])"


def kind_of(expression: str | Column) -> Column:
    """absolute, relative, or null for what is no date: an amount, or a span of time without a pointer."""
    text = F.lower(F.col(expression) if isinstance(expression, str) else expression)
    absolute = text.rlike(YEAR) | text.rlike(NUMERIC) | text.rlike(_EDGE % _MONTH) | text.rlike(_EDGE % "|".join(WEEKDAYS))
    relative = text.rlike(_EDGE % "|".join(STANDALONE_WORDS)) | (text.rlike(_EDGE % "|".join(MARKERS)) & text.rlike(_EDGE % "|".join(TIME_UNITS)))
    return F.when(absolute, "absolute").when(relative, "relative")


def precision_of(expression: str | Column) -> Column:
    """day, month or year, by what an expression names; day if it names none of them."""
    text = F.lower(F.col(expression) if isinstance(expression, str) else expression)
    month, year, day = text.rlike(_EDGE % _MONTH), text.rlike(YEAR), text.rlike(DAY_NUMBER)
    return F.when(text.rlike(NUMERIC), "day").when(month & year & ~day, "month").when(year & ~month, "year").when(text.isNotNull(), "day")


def expressions(text: str | Column) -> Column:
    """Stretches of a text that name a date: numbers, days and months, weekdays, relative days and counts of units, and ranges of days.

    A year alone counts after a word for "in" or "since" only.
    """
    unit, edge_l, edge_r = "|".join((*TIME_UNITS, *_UNIT_WORDS)), r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    day = rf"(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:st|nd|rd|th|\.|º)?\s(?:de\s|of\s)?(?:{_MONTH})(?:\s(?:de\s|del\s)?\d{{4}})?|(?:{_MONTH})\s(?:de\s)?(?:\d{{1,2}},\s)?\d{{4}})"
    forms = (
        rf"{day}(?:\s(?:-|–|to|al|hasta|a)\s{day})?",
        rf"(?:{'|'.join(WEEKDAYS)})",
        rf"(?:{'|'.join(STANDALONE_WORDS)})",
        rf"\d+\s(?:{unit})\s(?:ago|fa)",
        rf"(?:hace|il y a|vor|in|dans|tra|fra|within|dentro de)\s\d+\s(?:{unit})",
        rf"(?:next|last|pr[oó]xim\p{{L}}*|pasad\p{{L}}*|n[aä]chst\p{{L}}*|letzt\p{{L}}*|prossim\p{{L}}*|scors\p{{L}}*)\s(?:{unit})",
        rf"(?:(?<=in\s)|(?<=en\s)|(?<=since\s)|(?<=seit\s)|(?<=nel\s)|(?<=em\s))(?:{YEAR})",
    )
    pattern = rf"(?iu){edge_l}(?:{'|'.join(forms)}){edge_r}"
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(0))


_NUMBERED = re.compile(r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}-\d{1,2}-\d{4})\b")
_RANGE = re.compile(RANGE)


def range_ends(expression: str) -> list[str]:
    """The two sides of a range, or the expression alone; dashes inside a date in numbers part nothing."""
    guarded = _NUMBERED.sub(lambda m: m[0].replace("-", "\0"), expression)
    sides = [side.replace("\0", "-").strip() for side in _RANGE.split(guarded, maxsplit=1)]
    return sides if all(sides) else [expression]


def _safe(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _back(anchor: date, months: int) -> date:
    total = anchor.year * 12 + anchor.month - 1 - months
    year, month = divmod(total, 12)
    for day in range(anchor.day, 27, -1):
        if found := _safe(year, month + 1, day):
            return found
    return date(year, month + 1, min(anchor.day, 28))


def resolve(expression: str | None, anchor: date | None) -> date | None:
    """The day an expression means: ISO, d/m/y, month names, standalone words and counts of units.

    Without a year, or with a weekday, the latest such day not after the anchor is meant.
    """
    if not expression:
        return None
    text = expression.lower().strip()
    if m := re.search(r"\b(\d{4})[/.-](\d{1,2})(?:[/.-](\d{1,2}))?\b", text):
        return _safe(int(m[1]), int(m[2]), int(m[3] or 1))
    if m := re.search(r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", text):
        return _safe(int(m[3]), int(m[2]), int(m[1])) or _safe(int(m[3]), int(m[1]), int(m[2]))
    if m := re.search(rf"\b({_MONTH})\b", text):
        month = _MONTH_WORDS[m[1]]
        year = re.search(r"\b(\d{4})\b", text)
        day = re.search(r"(?<!\d)(\d{1,2})(?!\d)", text)
        if year:
            return _safe(int(year[1]), month, int(day[1]) if day else 1)
        if anchor and (found := _safe(anchor.year, month, int(day[1]) if day else 1)):
            return found if found <= anchor else _safe(anchor.year - 1, month, found.day)
        return None
    if m := re.fullmatch(r"\s*(\d{4})\s*", text):
        return _safe(int(m[1]), 1, 1)
    if not anchor:
        return None
    for word, days in STANDALONE.items():
        if re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text):
            return anchor + timedelta(days=days)
    unit = next((u for w in re.findall(r"\w+", text) if (u := _UNIT_WORDS.get(w))), None)
    if unit:
        number = re.search(r"\d+", text)
        count = int(number[0]) if number else 1
        if re.search(r"\b(?:next|coming|próxim[oa]|prochaine?|nächste[nr]?|prossim[oa])\b", text):
            count = -count
        return anchor - timedelta(days=count * (7 if unit == "week" else 1)) if unit in ("day", "week") else _back(anchor, count * (12 if unit == "year" else 1))
    for at, word in enumerate(WEEKDAYS):
        if re.search(rf"(?<!\w){word}(?!\w)", text):
            index = ("lunes lundi montag lunedì monday|tuesday martes mardi dienstag martedì|wednesday miércoles miercoles mercredi mittwoch mercoledì|thursday jueves jeudi donnerstag giovedì|"
                     "friday viernes vendredi freitag venerdì|saturday sábado sabado samedi samstag sabato|sunday domingo dimanche sonntag domenica").split("|")
            target = next(k for k, names in enumerate(index) if word in names.split())
            return anchor - timedelta(days=(anchor.weekday() - target) % 7)
    return None


def resolved(expression: str | Column, anchor: str | Column) -> Column:
    """``resolve`` for columns, in Arrow batches; the anchor may be null."""

    @F.pandas_udf("date")
    def run(expressions: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([resolve(e, a if isinstance(a, date) else None) for e, a in zip(expressions, anchors, strict=True)], dtype=object)

    return run(expression, anchor)


def resolve_range(expression: str | None, anchor: date | None) -> tuple[date | None, date | None]:
    """First and last day of a range, in order, the last null without a range.

    A side that is no date by itself ("3" of "3 to 5 May 2024") borrows what it lacks from the other.
    """
    sides = range_ends(expression) if expression else []
    if len(sides) == 2:
        days = [resolve(side, anchor) or resolve(f"{side} {other}", anchor) for side, other in (sides, sides[::-1])]
        if all(days):
            return min(days), max(days)
    return resolve(expression, anchor), None


def resolved_range(expression: str | Column, anchor: str | Column) -> tuple[Column, Column]:
    """``resolve_range`` for columns, in Arrow batches: the first and the last day."""

    @F.pandas_udf("first date, last date")
    def run(expressions: pd.Series, anchors: pd.Series) -> pd.DataFrame:
        days = [resolve_range(e, a if isinstance(a, date) else None) for e, a in zip(expressions, anchors, strict=True)]
        return pd.DataFrame({"first": pd.Series([d[0] for d in days], dtype=object), "last": pd.Series([d[1] for d in days], dtype=object)})

    found = run(expression, anchor)
    return found["first"], found["last"]


def snippet(text: str | Column, offset: str | Column, length: str | Column, around: int = 60) -> Column:
    """Up to ``around`` characters on both sides of a stretch; offsets count from 0."""
    t, at, size = (F.col(c) if isinstance(c, str) else c for c in (text, offset, length))
    start = F.greatest(at - around, F.lit(0))
    return F.trim(F.substring(t, start + 1, at - start + size + around))


def located(text: str | Column, piece: str | Column, cursor: str | Column | None = None) -> Column:
    """Offset of a piece at or after the cursor, else from the start, else in any case; -1 if nowhere."""
    t, p = (F.col(c) if isinstance(c, str) else c for c in (text, piece))
    at = F.lit(0) if cursor is None else F.col(cursor) if isinstance(cursor, str) else cursor
    later = F.instr(F.substring(t, at + 1, F.length(t)), p)
    exact, loose = F.instr(t, p), F.instr(F.lower(t), F.lower(p))
    return F.when(later > 0, later + at).when(exact > 0, exact).otherwise(loose) - 1


def merged_dates(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries (key, raw, start, offset) of each text without repeats, by date and offset.

    A repeat has the same offset and text, or the same date and an overlapping place.  Undated entries come last.
    """
    schema = entries.select(key, "raw", "start", "offset").schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for row in rows.sort_values(["offset", "raw"], kind="stable").itertuples(index=False):
            raw, start, offset = row.raw, row.start, int(row.offset)
            same = any(
                (o == offset and r == raw) or (s == start and s is not None and (r == raw and o == offset or o < offset + len(raw) and offset < o + len(r))) for _, r, s, o in kept
            )
            if not same:
                kept.append((getattr(row, key), raw, start, offset))
        out = pd.DataFrame(kept, columns=[key, "raw", "start", "offset"])
        out["__d"] = [d.isoformat() if isinstance(d, date) else "9999-12-31" for d in out["start"]]
        return out.sort_values(["__d", "offset"], kind="stable").drop(columns="__d")

    return entries.select(key, "raw", "start", "offset").groupBy(key).applyInPandas(run, schema)
