"""HTML to text, blocks, markdown and a cleaned page, by the standard parser."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style noscript template head svg iframe".split())
SIDE = frozenset("nav aside footer header form button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_MARKUP = re.compile(r"<[a-zA-Z/!?]")


def looks_like_markup(text: str) -> bool:
    return bool(_MARKUP.search(text))


class _Blocks(HTMLParser):
    """Leaf blocks in the order of the page: tag and collapsed text."""

    def __init__(self, skip: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.hidden = skip, 0
        self.tags: list[str] = ["p"]
        self.blocks: list[tuple[str, str]] = []
        self.held: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((self.tags[-1], text))
        self.held.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.skip:
            self.hidden += 1
        elif tag in BLOCKS:
            self.flush()
            if tag not in VOID:
                self.tags.append(tag)
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag in self.tags[1:]:
                while self.tags.pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def blocks_of(page: str, main_only: bool = False) -> list[tuple[str, str]]:
    """Tag and text of each leaf block; text outside blocks counts as a paragraph.

    ``main_only`` leaves out menus, side notes, headers, footers and forms.
    """
    parser = _Blocks(HIDDEN | SIDE if main_only else HIDDEN)
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


def markdown_of(page: str) -> str:
    """Headings, lists and paragraphs as markdown; text without markup stays as it is."""
    if not looks_like_markup(page):
        return page
    out = []
    for tag, text in blocks_of(page):
        if tag[0] == "h" and tag[1:].isdigit():
            text = "#" * int(tag[1:]) + " " + text
        elif tag == "li":
            text = "- " + text
        elif tag == "blockquote":
            text = "> " + text
        out.append(text)
    return "\n\n".join(out)


def plain_of(page: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", page)).split())


class _Meta(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.in_title = True
        elif tag == "meta":
            named = {k: v or "" for k, v in attrs}
            self.found.append(((named.get("name") or named.get("property") or "").lower(), named.get("content", "").strip()))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)


def page_fields(page: str) -> dict[str, str | None]:
    """title, author, date and content of a page; metadata is the first whose name ends with a known word."""
    meta = _Meta()
    meta.feed(page)

    def first(*ends: str) -> str | None:
        return next((v for n, v in meta.found if v and n.endswith(ends)), None)

    title = " ".join("".join(meta.title).split()) or first("title")
    content = "\n".join(f"<{t if t[0] == 'h' and t[1:].isdigit() or t == 'li' else 'p'}>{html.escape(x, quote=False)}</{t if t[0] == 'h' and t[1:].isdigit() or t == 'li' else 'p'}>" for t, x in blocks_of(page, main_only=True))
    return {"title": title or None, "author": first("author", "creator"), "date": first("published_time", "date", "pubdate"), "content": content}


def batch(function: Callable[[str], object], kind: str) -> Callable[[str | Column], Column]:
    """A text function as an Arrow-batched column function; null stays null."""

    def values(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t) if t is not None else None)

    # The function is made when a column is asked for, since it needs a running session.
    return lambda column: F.pandas_udf(values, kind)(F.col(column) if isinstance(column, str) else column)


def block_texts(page: str) -> list[str]:
    return [text for _, text in blocks_of(page)]


to_blocks = batch(block_texts, "array<string>")
to_markdown = batch(markdown_of, "string")
to_plain = batch(plain_of, "string")
