"""Captured pages as table functions: a page's tags are walked once, and each quote or text block of it is a row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.sources.store import ship

# Tags that have no end tag; tags whose content is no text; the classes of offer cards in RPC pages, by tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
RPC_CARDS = {("div", "yR1fYc"), ("li", "pIavfa"), ("div", "pIavfa")}
#: Base and taxes may miss the total by so much.
TOLERANCE = 2.0


class Element:
    """A tag with its attributes and what it holds, elements and strings in order."""

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.items = tag, attributes, []
        self.classes = set(attributes.get("class", "").split())

    def below(self) -> Iterator[Element]:
        """All elements inside, in the order of the page. Nesting of any depth needs no deep recursion."""
        todo = list(reversed(self.items))
        while todo:
            item = todo.pop()
            if isinstance(item, Element):
                yield item
                todo += reversed(item.items)

    def find(self, tag: str | None = None, of_class: str | None = None, **attributes: str) -> Element | None:
        return next(self.all(tag, of_class, **attributes), None)

    def all(self, tag: str | None = None, of_class: str | None = None, **attributes: str) -> Iterator[Element]:
        for x in self.below():
            if (tag is None or x.tag == tag) and (of_class is None or of_class in x.classes) and all(x.attributes.get(k) == v for k, v in attributes.items()):
                yield x

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.items))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in SILENT:
                todo += reversed(item.items)

    def text(self, between: str = "") -> str:
        return between.join(x for x in map(str.strip, self.strings()) if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.top = Element("", {})
        self.open = [self.top]

    def handle_starttag(self, tag, attributes):
        made = Element(tag, {k: v or "" for k, v in reversed(attributes)})
        self.open[-1].items.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag, attributes):
        self.open[-1].items.append(Element(tag, {k: v or "" for k, v in reversed(attributes)}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def parsed(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.top


def amount(text: str | None) -> float | None:
    digits = re.sub(r"[^0-9.]", "", text or "")
    try:
        return float(digits) if digits else None
    except ValueError:
        return None


def _money(part: Element, of_class: str) -> float | None:
    found = part.find(of_class=of_class)
    return None if found is None else amount(found.attributes.get("data-amount") or found.text())


def _told(part: Element, of_class: str) -> str | None:
    found = part.find(of_class=of_class)
    return None if found is None else found.text()


def _quote(part: Element, names: list[str | None]) -> tuple | None:
    """A quote of a card or row, or None if it has a fault: a name or the total is missing, or the parts do not add up."""
    fare, base, taxes = (_money(part, c) for c in ("fare-total", "fare-base", "fare-taxes"))
    whole = base is None or taxes is None or abs(base + taxes - (fare or 0)) <= TOLERANCE
    if None in names or not fare or not whole:
        return None
    return (*names, fare, base, taxes, _told(part, "dep-time"), _told(part, "arr-time"))


def _state(page: Element, html: str) -> str | None:
    """What ends a page's reading at once, in order of precedence."""
    low, title = html.lower(), page.find("h1")
    if page.find("div", "error-container") or (title and "500" in title.text()):
        return "ERROR"
    if page.find(id="cf-challenge") or "please verify you are a human" in low:
        return "CAPTCHA_CHALLENGE"
    if page.find("div", "sold-out-banner") or page.find("div", "empty-state") or "all flights sold out" in low or "no flights found" in low:
        return "NO_RESULTS"
    return None


def page_rows(html: str | None) -> list[tuple]:
    """(state, n_quotes, place, carrier, airline, flight, fare, base, taxes, dep_time, arr_time) of each quote; one row without a place for a page without quotes.

    Cards come before table rows, which count if no card gave a quote. A row without a
    total is passed over; any other fault, and any in a card, makes a page without quotes one of drift.
    """
    page, faults, quotes = parsed(html), 0, []
    state = _state(page, html or "")
    if state is None:
        for card in page.all("div", "flight-card"):
            found = _quote(card, [_told(card, c) for c in ("airline-code", "airline-name", "flight-number")])
            quotes.append(found) if found else None
            faults += found is None
        if not quotes:
            for row in page.all("tr", "flight-row"):
                found = _quote(row, [row.attributes.get(a, "") for a in ("data-airline-code", "data-airline", "data-flight-number")])
                quotes.append(found) if found else None
                faults += found is None and (row.find(of_class="fare-total") is None or bool(_money(row, "fare-total")))
        state = "SUCCESS" if quotes else "SELECTOR_DRIFT" if faults else "NO_RESULTS"
    return [(state, len(quotes), i, *q) for i, q in enumerate(quotes)] or [(state, 0, None, *[None] * 8)]


def blocks(html: str | None, around: int = 4) -> list[tuple[int, str]]:
    """Texts that may each hold an offer: those of offer cards that name a price, or, on a page without such cards, every line with a rupee sign and `around` lines on both sides."""
    page = parsed(html)
    cards = [x for x in page.below() if any(x.tag == tag and name in x.classes for tag, name in RPC_CARDS)]
    if cards:
        return [(i, t) for i, t in enumerate(x.text("\n") for x in cards) if "₹" in t or "INR" in t]
    lines = page.text("\n").split("\n")
    return [(i, "\n".join(lines[max(0, i - around) : i + around + 1])) for i, line in enumerate(lines) if "₹" in line]


QUOTE = "state string, n_quotes int, place int, carrier string, airline string, flight string, fare double, base double, taxes double, dep_time string, arr_time string"


class _Quotes:
    def eval(self, html: str):
        yield from page_rows(html)


class _Blocks:
    def eval(self, html: str):
        yield from blocks(html)


def page_quotes(df: DataFrame, html_col: str) -> DataFrame:
    """df beside the quotes of each page (page_rows): a lateral join with a table function, one page held at a time. Null and empty pages have no results."""
    ship(df.sparkSession)
    return df.lateralJoin(udtf(_Quotes, returnType=QUOTE)(F.col(html_col).outer()))


def page_blocks(df: DataFrame, html_col: str) -> DataFrame:
    """df beside `at` and `block` of each text that may hold an offer; a page without one has no row."""
    ship(df.sparkSession)
    return df.lateralJoin(udtf(_Blocks, returnType="at int, block string")(F.col(html_col).outer()))
