"""Character-level transducers shared by the text operators."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Characters without width.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"

_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_TAG = re.compile(r"<[/!?A-Za-z][^<>]{0,400}>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPED_CHAR = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\[nrtbf\"'/\\]")
_WORD = re.compile(r"[^\W_]+")
_LOOKALIKE_TABLE = {ord(a): b for a, b in LOOKALIKES.items()}


class _Plain(dict):
    """Translation of one character to its plain lower-case letters, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = _LOOKALIKE_TABLE.get(code, char)
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)).translate(_LOOKALIKE_TABLE)
        if char in INVISIBLE or unicodedata.combining(char):
            plain = ""
        self[code] = plain = plain.casefold()
        return plain


_PLAIN = _Plain()
_OTHER = re.compile(r"[^\x00-\x7f]")


class _OfChar(dict):
    """A translation by character in place of its code."""

    def __init__(self, by_code: dict[int, str]) -> None:
        super().__init__()
        self.by_code = by_code

    def __missing__(self, char: str) -> str:
        self[char] = plain = self.by_code[ord(char)]
        return plain

    def over(self, text: str) -> str:
        """What ``str.translate`` gives; letters beyond ASCII are few, so only these are looked up."""
        return _OTHER.sub(lambda m: self[m[0]], text).lower()


_PLAIN_OF = _OfChar(_PLAIN)


def plain_words(text: str | None) -> list[str]:
    """Words of a text without case, accents, punctuation, markup, escapes, invisible and look-alike characters."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(" ", _ESCAPED_CHAR.sub(lambda m: chr(int(m[1], 16)), text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    text = text.lower() if text.isascii() else _PLAIN_OF.over(text)
    return _WORD.findall(text)


class _SameLength(dict):
    """Translation of one character to one character, so that offsets stay."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = _PLAIN[code]
        if unicodedata.category(char) == "Zs":
            plain = " "
        elif unicodedata.category(char) == "Pd":
            plain = "-"
        elif len(plain) != 1:
            plain = char.lower() if len(char.lower()) == 1 else char
        self[code] = plain
        return plain


_SAME = _SameLength()
_SAME_OF = _OfChar(_SAME)


def _same_length(text: str) -> str:
    out = _SAME_OF.over(text)
    # Lower case of one letter may be two.
    return out if len(out) == len(text) else text.translate(_SAME)


def aligned(text: str) -> tuple[str, list[int] | None]:
    """Plain lower-case form of a text and, if characters were left out, each kept one's place in the text."""
    if text.isascii():
        return text.lower(), None
    if _INVISIBLE.search(text):
        places = [i for i, c in enumerate(text) if c not in INVISIBLE]
        return _same_length("".join([text[i] for i in places])), places
    return _same_length(text), None
