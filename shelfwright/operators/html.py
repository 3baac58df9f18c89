"""Fetched HTML to what selectors find in it.

This is the one place where Python reads page content: an Arrow UDF that works on column batches. It reads the elements of a
page once, runs all selectors over them, and hands on only the elements that some selector fits. A page stays one row.
Element text is kept as a slice of the page text, so a page's text is stored once however deep its elements
nest. Everything that reads the result is a Catalyst expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright import schemas
from shelfwright.functions.nodes import Page
from shelfwright.functions.selectors import REMEMBERED, Automaton, Hits, filled

# Elements without content.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
# A start tag from the value closes an open element named by the key (implied end tags).
_BLOCKS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_CLOSED_BY = {
    "p": _BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}
_CLOSERS = set().union(*_CLOSED_BY.values())
# Implied end tags do not reach past these.
_FENCES = {"table", "ul", "ol", "dl", "select", "button", "td", "th", "div", "body", "html"}
#: Different sites whose selectors a worker keeps compiled.
COMPILED = 4096


# Markup in its plain form: a tag whose attributes are well written, or text up to the next tag. No plain tag holds an angle bracket.
_NAME = r"[a-zA-Z][a-zA-Z0-9-]*"
_ATTRIBUTE = r"""\s+([a-zA-Z_:@][\w:.@-]*)(?:=(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'=<>`/]+)))?"""
_TAG = re.compile(
    rf"""/({_NAME})\s*|({_NAME})((?:\s+[a-zA-Z_:@][\w:.@-]*(?:="[^"<>]*"|='[^'<>]*'|=[^\s"'=<>`/]+)?)*)\s*(/?)""", re.ASCII
)
_ATTRIBUTES = re.compile(_ATTRIBUTE, re.ASCII)
_UNCLEAR = re.compile(r"&(?!(?:amp|lt|gt|quot|#[0-9]{1,6});)")
# Elements whose content is no markup, and those that editions of the reader treat as such.
_RAW = {"script", "style"}
_SPECIAL = {"textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript", "svg", "math"}


class _Unclear(Exception):
    """Markup that is not in its plain form."""


class _Reader(HTMLParser):
    """Any markup at all, told to a page."""

    def __init__(self, page: ParsedPage):
        super().__init__(convert_charrefs=True)
        self.page = page

    def handle_starttag(self, tag, attrs):
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        self.page.start(tag, values)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.page.end(tag)

    def handle_data(self, data):
        self.page.data(data)


class _Tags:
    """Plain tags by their text, so that equal ones are taken apart once; bounded by characters."""

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.room = REMEMBERED

    def learn(self, written: str) -> tuple:
        """(name, attributes or None for an end tag, whether it may end others, is void, may hold no markup, ends in a slash)"""
        match = _TAG.fullmatch(written)
        if match is None:
            raise _Unclear
        end, tag, attrs, slash = match.groups()
        if end is not None:
            found = (end.lower(), None, False, False, False, False)
        else:
            tag = tag.lower()
            found = (
                tag, _values(attrs) if attrs else {}, tag in _CLOSERS, tag in _VOID, tag in _RAW or tag in _SPECIAL, bool(slash)
            )
        self.room -= 64 + len(written)
        if self.room < 0:
            self.known.clear()
            self.room = REMEMBERED
        self.known[written] = found
        return found


_TAGS = _Tags()


class ParsedPage:
    """The elements of a page as lists, in document order, and its text.

    Plain markup is read by patterns; a page with anything else in it goes through the standard library's reader, which
    gives the same for plain markup but takes several times as long. ``written`` has the text of the tag of an element read
    by patterns, else None.
    """

    def __init__(self, html: str | None, plain: bool = True):
        self._begin()
        try:
            if not plain:
                raise _Unclear
            self._read_plain(html or "")
        except _Unclear:
            self._begin()
            reader = _Reader(self)
            reader.feed(html or "")
            reader.close()
        self._close(0)
        self.text = "".join(self._parts)

    @property
    def from_end(self) -> list[int]:
        """The place of each element among its siblings, counted from the last."""
        found, prevs = [1] * len(self.tags), self.prevs
        for i in range(len(prevs) - 1, -1, -1):
            if prevs[i] >= 0:
                found[prevs[i]] = found[i] + 1
        return found

    def _begin(self) -> None:
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.written: list[str | None] = []
        self.parents: list[int] = []
        self.prevs: list[int] = []
        self.last: list[int] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        # The open elements, from a place for the page itself on, and the last child of each so far.
        self._open: list[int] = [-1]
        self._last_child: list[int] = [-1]
        self._parts: list[str] = []
        self._size = 0

    def _read_plain(self, html: str) -> None:
        if "\x00" in html or "\r" in html:
            raise _Unclear
        known, learn, opened = _TAGS.known, _TAGS.learn, self._open
        chunks = html.split("<")
        if chunks[0]:
            self.data(unescape(chunks[0]) if "&" in chunks[0] else chunks[0])
        # ``position`` is where the text of chunk ``k`` begins, behind its bracket.
        k, position = 1, len(chunks[0]) + 1
        while k < len(chunks):
            chunk = chunks[k]
            if chunk.startswith("!"):
                if chunk.startswith("!--"):
                    stop = self._comment(html, position - 1)
                elif chunk[:14].lower() == "!doctype html>":
                    stop = position + 14
                else:
                    raise _Unclear
                k += 1 + html.count("<", position, stop)
                following = html.find("<", stop)
                text = html[stop:] if following < 0 else html[stop:following]
                position = following + 1
                if text:
                    self.data(unescape(text) if "&" in text else text)
                continue
            written, closed, text = chunk.partition(">")
            if not closed:
                raise _Unclear
            tag, attrs, closer, void, special, slash = known.get(written) or learn(written)
            k += 1
            if attrs is None:
                if len(opened) > 1 and self.tags[opened[-1]] == tag:
                    self._close(len(opened) - 2)
                else:
                    self.end(tag)
            else:
                if closer:
                    self._imply_ends(tag)
                self._add(tag, attrs, written, void)
                if special:
                    start = position + len(written) + 1
                    stop = self._content(html, tag, start, slash)
                    if stop > start:
                        k += html.count("<", start, stop)
                        position = stop + 1
                        continue
            position += len(chunk) + 1
            if text:
                if "&" in text:
                    text = unescape(text)
                self._parts.append(text)
                self._size += len(text)

    def _comment(self, html: str, position: int) -> int:
        stop = html.find("-->", position + 4)
        body = html[position + 4 : stop]
        if stop < 0 or body.startswith((">", "->")) or "--" in body or body.endswith("-"):
            raise _Unclear
        return stop + 3

    def _content(self, html: str, tag: str, position: int, slash: bool) -> int:
        """What follows the start of an element whose content may be no markup."""
        stop = html.find("</", position)
        if slash or stop < 0 or html[stop + 2 : stop + 3 + len(tag)].lower() != f"{tag}>":
            raise _Unclear
        body = html[position:stop]
        if tag in _RAW:
            if "<!--" in body:
                raise _Unclear
            if body:
                self.data(body)
            return stop
        if "<" in body:
            raise _Unclear
        return position

    def _close(self, depth: int) -> None:
        """Close all open elements but the first ``depth``."""
        opened, size, final = self._open, self._size, len(self.tags) - 1
        while len(opened) > depth + 1:
            node = opened.pop()
            self._last_child.pop()
            self.t1[node] = size
            self.last[node] = final

    def _imply_ends(self, tag: str) -> None:
        opened, tags = self._open, self.tags
        k = len(opened) - 1
        while k >= 1:
            name = tags[opened[k]]
            if tag in _CLOSED_BY.get(name, ()):
                self._close(k - 1)
            elif name in _FENCES and not (tag in ("tr", "tbody") and name in ("td", "th")):
                return
            k = min(k, len(opened)) - 1

    def _add(self, tag: str, attrs: dict[str, str], written: str | None, void: bool) -> None:
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.written.append(written)
        self.parents.append(self._open[-1])
        self.prevs.append(self._last_child[-1])
        self.last.append(i)
        self.t0.append(self._size)
        self.t1.append(self._size)
        self._last_child[-1] = i
        if not void:
            self._open.append(i)
            self._last_child.append(-1)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in _CLOSERS:
            self._imply_ends(tag)
        self._add(tag, attrs, None, tag in _VOID)

    def end(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == tag:
                self._close(k - 1)
                return

    def data(self, data: str) -> None:
        self._parts.append(data)
        self._size += len(data)


def _values(written: str) -> dict[str, str]:
    """Attributes of a plain tag; of a repeated name the first counts."""
    if "&" in written and _UNCLEAR.search(written):
        raise _Unclear
    values: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTES.findall(written):
        value = double or single or bare
        values.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return values


def _hits_of(pages: list[ParsedPage], hits: list[Hits]) -> pa.Array:
    """The elements found on each page, as a list for each selector; all pages at once."""

    def joined(lists) -> np.ndarray:
        return np.fromiter(chain.from_iterable(lists), np.int64)

    totals = np.array([len(page.tags) for page in pages], np.int64)
    begin = np.cumsum(totals) - totals
    sizes = np.array([h.size for h in hits], np.int64)
    slots = np.cumsum(sizes) - sizes
    counts = np.array([len(h.elements) for h in hits], np.int64)
    # by page and selector; the elements of one selector stay in document order
    slot = joined(h.selectors for h in hits) + np.repeat(slots, counts)
    order = np.argsort(slot, kind="stable")
    found = (joined(h.elements for h in hits) + np.repeat(begin, counts))[order]
    inner = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=int(sizes.sum())))])
    nodes, places = np.unique(found, return_inverse=True)
    page_of = np.repeat(np.arange(len(pages)), totals)[nodes]
    own = nodes - begin[page_of]
    last, t0, t1, prevs = (joined(getattr(page, name) for page in pages) for name in ("last", "t0", "t1", "prevs"))
    prev = prevs[nodes]
    before = prev + begin[page_of]
    follower = last[nodes] + 1
    behind = np.where(follower < totals[page_of], follower + begin[page_of], 0)
    followed = (follower < totals[page_of]) & (prevs[behind] == own)
    arrays = {
        "i": pa.array(own, pa.int32()), "last": pa.array(last[nodes], pa.int32()),
        "t0": pa.array(t0[nodes], pa.int32()), "t1": pa.array(t1[nodes], pa.int32()),
        "p0": pa.array(t0[before], pa.int32(), mask=prev < 0), "p1": pa.array(t1[before], pa.int32(), mask=prev < 0),
        "n0": pa.array(t0[behind], pa.int32(), mask=~followed), "n1": pa.array(t1[behind], pa.int32(), mask=~followed),
    }
    attrs = [pages[p].attrs[i] for p, i in zip(page_of.tolist(), own.tolist(), strict=True)]
    arrays["attrs"] = pa.MapArray.from_arrays(
        pa.array(np.cumsum([0] + [len(a) for a in attrs]), pa.int32()),
        pa.array(list(chain.from_iterable(attrs)), pa.string()),
        pa.array(list(chain.from_iterable(a.values() for a in attrs)), pa.string()),
    )
    names = schemas.HIT.fieldNames()
    flat = pa.StructArray.from_arrays([arrays[name] for name in names], names).take(pa.array(places.reshape(-1)))
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lists)


def _selecting(sheets: Mapping[str, Sequence[str]]):
    """UDF over (html, sheet, configured selectors as JSON)."""
    compiled: dict[tuple[str, str | None], Automaton] = {}

    def automaton(sheet: str, configured: str | None) -> Automaton:
        key = (sheet, configured)
        if key not in compiled:
            if len(compiled) >= COMPILED:
                compiled.clear()
            values = json.loads(configured) if configured else {}
            compiled[key] = Automaton([filled(s, values) for s in sheets.get(sheet, ())])
        return compiled[key]

    @F.arrow_udf(schemas.PARSED_PAGE)
    def run(html: pa.Array, sheet: pa.Array, configured: pa.Array) -> pa.Array:
        pages, hits = [], []
        for text, name, values in zip(html.to_pylist(), sheet.to_pylist(), configured.to_pylist(), strict=True):
            page = ParsedPage(text)
            pages.append(page)
            hits.append(automaton(name, values).found(page))
        return pa.StructArray.from_arrays(
            [pa.array([page.text for page in pages], pa.string()), _hits_of(pages, hits)], ["text", "hits"]
        )

    return run


def parse_pages(
    df: DataFrame, page: Page | Mapping[str, Page], html_col: str = "html", sheet: Column | None = None,
    configured: Column | None = None,
) -> DataFrame:
    """Replace the HTML column by ``page``: a struct of the text and of the elements that selectors fit.

    The selectors are those that expressions have asked ``page`` for so far, so build the expressions first. With several
    readers, ``sheet`` names the one of a row. ``configured`` (JSON) fills the slots of a row's selectors: sites that differ in
    nothing but selectors share all expressions. Each row is one page; null HTML is a page without elements.
    """
    sheets = {name: list(p.selectors) for name, p in (page if isinstance(page, Mapping) else {"": page}).items()}
    run = _selecting(sheets)
    parsed = run(
        F.col(html_col), F.lit("") if sheet is None else F.coalesce(sheet, F.lit("")),
        F.lit(None).cast("string") if configured is None else configured,
    )
    return df.withColumn("page", parsed).drop(html_col)
