"""Entries of contents pages: a table function that reads a page's tree by rules given as data.

A rule says which element is an entry, which elements hold nothing to read, and which are headings. The parser
is lenient as browsers are: elements that HTML closes by itself are closed, stray end tags are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LISTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}  # what such an element's start closes


@dataclass(frozen=True)
class Rule:
    """``entry``: the element of an entry, inside an element whose class or id is ``within`` if that is given;
    ``skip``: elements to leave out; ``headings``: elements whose text heads the entries after them."""

    entry: str = "li"
    within: str | None = None
    skip: tuple[str, ...] = ("nav", "footer", "header", "aside")
    headings: tuple[str, ...] = ("h1", "h2", "h3")

    def spelled(self) -> str:
        return json.dumps(asdict(self))


class _Page(HTMLParser):
    """One walk over a page; entries are complete when their element ends."""

    def __init__(self, rule: dict):
        super().__init__(convert_charrefs=True)
        self.rule, self.skip = rule, {*rule["skip"], "script", "style", "template"}
        self.open: list[tuple[str, bool]] = []  # tag and whether it is the element that ``within`` names
        self.heading: str | None = None
        self.heading_text: list[str] | None = None
        self.entry: dict | None = None
        self.found: list[dict] = []

    def _hidden(self) -> bool:
        return any(tag in self.skip for tag, _ in self.open)

    def _inside(self) -> bool:
        return self.rule["within"] is None or any(own for _, own in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = LISTED.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in closes:
                self._close(at)
            elif self.open[at][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "body"):
                break
        given = {k: v or "" for k, v in attrs}
        own = self.rule["within"] is not None and self.rule["within"] in (given.get("id"), *given.get("class", "").split())
        if tag not in VOID:
            self.open.append((tag, own))
        if self._hidden():
            return
        if tag in self.rule["headings"]:
            self.heading_text = []
        elif tag == self.rule["entry"] and self._inside() and self.entry is None:
            self.entry = {"depth": len(self.open), "heading": self.heading, "link": None, "title": [], "rest": [], "in": False}
        elif tag == "a" and self.entry and self.entry["link"] is None and given.get("href", "").strip():
            self.entry |= {"link": given["href"].strip(), "in": True}
        elif tag in ("br", *BLOCKS) and self.entry:
            (self.entry["title"] if self.entry["in"] else self.entry["rest"]).append("\n" if not self.entry["in"] else " ")

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break

    def _close(self, at: int) -> None:
        """End the element ``at`` and all that it still holds."""
        for depth in range(len(self.open), at, -1):
            tag = self.open[depth - 1][0]
            if tag in self.rule["headings"] and self.heading_text is not None:
                self.heading, self.heading_text = _plain(self.heading_text) or self.heading, None
            if tag == "a" and self.entry:
                self.entry["in"] = False
            if self.entry and self.entry["depth"] == depth:
                self.found.append(self.entry)
                self.entry = None
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self._hidden():
            return
        if self.heading_text is not None:
            self.heading_text.append(data)
        if self.entry:
            (self.entry["title"] if self.entry["in"] else self.entry["rest"]).append(data)

    def done(self) -> list[dict]:
        self.close()
        self._close(0)
        return self.found


def _plain(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _first_line(parts: list[str]) -> str | None:
    """The first line under a link that holds something: who wrote it."""
    return next((line for line in (" ".join(x.split()) for x in "".join(parts).split("\n")) if line), None)


@udtf(returnType="place int, heading string, title string, link string, authors string")
class ContentsEntries:
    """A row for each entry with a link: its place, heading, the link's text and target, the first line beside it."""

    def eval(self, html: str, rule: str) -> Iterator[tuple]:
        if html:
            page = _Page(json.loads(rule))
            page.feed(html)
            entries = [e for e in page.done() if e["link"] is not None and _plain(e["title"])]
            for place, e in enumerate(entries, 1):
                yield place, e["heading"], _plain(e["title"]), e["link"], _first_line(e["rest"])


def contents_entries(pages: DataFrame, rule: Rule, html_col: str = "html") -> DataFrame:
    """``pages`` without their HTML, with a row per entry: place, heading, title, link, authors.

    Pages without entries, null and empty ones, give no row; markup may be broken in any way.
    """
    found = pages.lateralJoin(ContentsEntries(F.col(html_col).outer(), F.lit(rule.spelled())))
    return found.drop(html_col)
