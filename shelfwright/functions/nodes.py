"""What selectors found on a parsed page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions import js
from shelfwright.functions.selectors import Automaton, has_slot


class Page:
    """A page in expressions; it notes the selectors asked for, which the parse then runs all at once."""

    def __init__(self, column: str = "page"):
        self.column = F.col(column)
        self.selectors: dict[str, int] = {}

    @property
    def text(self) -> Column:
        return self.column["text"]

    def hits(self, selector: str) -> Column:
        """Elements that the selector fits, in document order. Asking a page parsed without it is an error."""
        if selector not in self.selectors:
            if not selector.strip():
                raise ValueError("selector is empty")
            if not has_slot(selector):
                Automaton([selector])
            self.selectors[selector] = len(self.selectors)
        return F.element_at(self.column["hits"], self.selectors[selector] + 1)


def select(page: Page, selector: str, within: Column | None = None) -> Column:
    """Matching nodes in document order; ``within`` looks at the descendants of one node only."""
    found = page.hits(selector)
    if within is None:
        return found
    return F.filter(found, lambda n: (n["i"] > within["i"]) & (n["i"] <= within["last"]))


def closest(page: Page, selector: str, n: Column) -> Column:
    """The node itself or its nearest ancestor that fits; null when none does."""
    above = F.filter(page.hits(selector), lambda a: (a["i"] <= n["i"]) & (a["last"] >= n["i"]))
    return F.try_element_at(above, F.lit(-1))


def first_hits(page: Page, selectors: list[str]) -> Column:
    """Nodes of the first selector that matches at all; null when none does."""
    return F.coalesce(*[F.when(has(page, s), select(page, s)) for s in selectors])


def _slice(page: Page, start: Column, stop: Column) -> Column:
    return F.substr(page.text, start + 1, stop - start)


def raw_text(page: Page, n: Column) -> Column:
    return js.let(n, lambda x: _slice(page, x["t0"], x["t1"]))


def text_before(page: Page, n: Column) -> Column:
    """Text of the sibling in front of a node; null without one."""
    return js.let(n, lambda x: _slice(page, x["p0"], x["p1"]))


def text_behind(page: Page, n: Column) -> Column:
    """Text of the sibling behind a node; null without one."""
    return js.let(n, lambda x: _slice(page, x["n0"], x["n1"]))


def node_text(page: Page, n: Column) -> Column:
    return js.trim(raw_text(page, n))


def _not_blank(c: Column) -> Column:
    return js.let(c, lambda t: F.when(t != "", t))


def select_text(page: Page, selector: str, within: Column | None = None) -> Column:
    """Trimmed text of the first match; null when there is none or it is empty."""
    return _not_blank(node_text(page, F.get(select(page, selector, within), F.lit(0))))


def select_attr(page: Page, selector: str, attr: str, within: Column | None = None) -> Column:
    first = F.get(select(page, selector, within), F.lit(0))
    return _not_blank(first["attrs"][attr])


def select_texts(page: Page, selector: str, within: Column | None = None) -> Column:
    texts = F.transform(select(page, selector, within), lambda n: node_text(page, n))
    return F.filter(texts, lambda t: t != "")


def select_attrs(page: Page, selector: str, attr: str, within: Column | None = None) -> Column:
    values = F.transform(select(page, selector, within), lambda n: n["attrs"][attr])
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def has(page: Page, selector: str) -> Column:
    return F.size(page.hits(selector)) > 0


def has_any(page: Page, selectors: list[str]) -> Column:
    return has(page, ", ".join(selectors))
