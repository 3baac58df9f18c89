"""CSS selectors compiled to one automaton that reads the elements of a page once, in document order.

A selector is a chain of simple tests. Each test of each chain is one bit; an element's state is the set of tests up to
which a chain fits when it ends there. The state follows from the element itself and from four sets handed down: those of its
parent, of all its ancestors, of its previous sibling and of all earlier ones. So an element costs the same
however deep it lies, and all selectors of a page reader are tested together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

_PART = re.compile(
    r"(?P<tag>^[a-z][a-z0-9-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]"
    r"|:nth-last-child\((?P<nth>\d+)\)|:(?P<last>last-child)"
)
_SLOT = re.compile(r"\{([\w.]+):([^}]*)\}")
#: Characters of elements that a worker remembers with their tests, so that equal elements are tested once.
REMEMBERED = 1 << 22


def slot(name: str, default: str = "") -> str:
    """A selector, or a part of one, that a site may configure under this name."""
    return "{" + name + ":" + default + "}"


def filled(selector: str, configured: Mapping[str, str | None]) -> str:
    """The selector with its slots replaced by what the site configures, or else by their defaults."""
    return _SLOT.sub(lambda m: configured.get(m[1]) or m[2], selector)


def has_slot(selector: str) -> bool:
    return _SLOT.search(selector) is not None


def split(selector: str, marks: str) -> list[str]:
    """Split at the marks, but not inside brackets."""
    out, depth, cur = [], 0, ""
    for ch in selector:
        depth += (ch == "[") - (ch == "]")
        if depth == 0 and ch in marks:
            out += [cur, ch]
            cur = ""
        else:
            cur += ch
    return out + [cur]


def _chain(alternative: str) -> tuple[list[str], list[str]]:
    """The simple tests of a chain, and the combinators between them."""
    tokens = split(re.sub(r"\s*([>+~])\s*", r"\1", alternative.strip()), " >+~")
    parts, marks = [tokens[0]], []
    for mark, part in zip(tokens[1::2], tokens[2::2], strict=True):
        if mark != " " or part:
            marks.append(mark)
            parts.append(part)
    return parts, marks


def _simple(part: str) -> tuple[tuple[str, str | None], list[Callable], list[Callable], int]:
    """``a.next[rel='x']`` as where to look it up, tests of (tag, classes, attributes), tests of attributes' values, and
    the place from the end or 0.
    """
    keys, tests, values, nth, end = [], [], [], 0, 0
    for m in _PART.finditer(part):
        if m.start() != end:
            break
        end = m.end()
        if m["tag"]:
            keys.append((3, "tag", m["tag"]))
            tests.append(lambda tag, classes, attrs, want=m["tag"]: tag == want)
        elif m["cls"]:
            keys.append((1, "class", m["cls"]))
            tests.append(lambda tag, classes, attrs, want=m["cls"]: want in classes)
        elif m["id"]:
            keys.append((0, "id", m["id"]))
            tests.append(lambda tag, classes, attrs, want=m["id"]: attrs.get("id") == want)
        elif m["attr"]:
            keys.append((2, "attr", m["attr"]))
            if m["op"] is None:
                tests.append(lambda tag, classes, attrs, want=m["attr"]: want in attrs)
            else:
                values.append(_value(m["attr"], m["op"], m["val"]))
        else:
            place = int(m["nth"] or 1)
            if nth not in (0, place):
                raise ValueError(f"selector not supported: {part!r}")
            nth = place
    if end != len(part) or not part:
        raise ValueError(f"selector not supported: {part!r}")
    _, kind, value = min(keys, default=(4, "any", None))
    return (kind, value), tests, values, nth


def _value(name: str, op: str, want: str) -> Callable:
    if op == "=":
        return lambda attrs: attrs.get(name) == want
    if op == "*=":
        return lambda attrs: name in attrs and want in attrs[name]
    if op == "^=":
        return lambda attrs: name in attrs and attrs[name].startswith(want)
    return lambda attrs: name in attrs and attrs[name].endswith(want)


class Hits(NamedTuple):
    """Pairs of a selector, of ``size``, and an element that it fits, by elements in document order."""

    size: int
    selectors: list[int]
    elements: list[int]


class Automaton:
    """All selectors of a list; an empty alternative, as of a slot that is not configured, fits nothing."""

    def __init__(self, selectors: Sequence[str]):
        self.size = len(selectors)
        self.first = self.below = self.child = self.next = self.later = self.ends = 0
        self.owner: dict[int, int] = {}
        self.nth: dict[int, int] = {}
        self.index: dict[tuple[str, str | None], list[tuple[int, list[Callable], list[Callable]]]] = {}
        self.remembered: dict[tuple, tuple[int, list]] = {}
        self.room = REMEMBERED
        bit = 1
        for number, selector in enumerate(selectors):
            for alternative in split(selector, ",")[::2]:
                if not alternative.strip():
                    continue
                parts, marks = _chain(alternative)
                for i, part in enumerate(parts):
                    place, tests, values, nth = _simple(part)
                    self.index.setdefault(place, []).append((bit, tests, values))
                    if nth:
                        self.nth[nth] = self.nth.get(nth, 0) | bit
                    if i == 0:
                        self.first |= bit
                    how = marks[i] if i < len(marks) else None
                    if how is None:
                        self.ends |= bit
                        self.owner[bit] = number
                    elif how == " ":
                        self.below |= bit
                    elif how == ">":
                        self.child |= bit
                    elif how == "+":
                        self.next |= bit
                    else:
                        self.later |= bit
                    bit <<= 1
        # Steps taken before: what an element passes and its neighbours' numbers, to its own number and the selectors that fit.
        self.passed: dict[str, int] = {}
        self.steps: dict[tuple[int, int, int, int], tuple[int, tuple[int, ...]]] = {}
        self._forget()
        self.placed = 0
        for mask in self.nth.values():
            self.placed |= mask

    def tests(self, tag: str, attrs: Mapping[str, str]) -> int:
        """The tests that the element itself passes, its place among siblings aside.

        What follows from the tag, the classes, the id and the names of attributes is remembered; values are looked at each time.
        """
        key = (tag, attrs.get("class"), attrs.get("id"), *attrs)
        known = self.remembered.get(key)
        if known is None:
            known = self._known(tag, attrs)
            self.room -= 64 + len(key[1] or "") + len(key[2] or "")
            if self.room < 0:
                self.remembered.clear()
                self.room = REMEMBERED
            self.remembered[key] = known
        found, valued = known
        for bit, tests in valued:
            for test in tests:
                if not test(attrs):
                    break
            else:
                found |= bit
        return found

    def _known(self, tag: str, attrs: Mapping[str, str]) -> tuple[int, list]:
        classes = attrs.get("class", "").split()
        places = [("any", None), ("tag", tag), ("id", attrs.get("id"))]
        places += [("class", c) for c in set(classes)] + [("attr", a) for a in attrs]
        found, valued = 0, []
        for place in places:
            for bit, tests, values in self.index.get(place, ()):
                if all(t(tag, classes, attrs) for t in tests):
                    if values:
                        valued.append((bit, values))
                    else:
                        found |= bit
        return found, valued

    def _forget(self) -> None:
        self.passed.clear()
        self.steps.clear()
        self.numbers: dict[tuple[int, int, int], int] = {(0, 0, 0): 0}
        self.states: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.left = REMEMBERED

    def _step(self, key: tuple[int, int, int, int]) -> tuple[int, tuple[int, ...]]:
        """The state of an element: its own tests that fit, those of its ancestors and those of its earlier siblings."""
        tests, parent, prev, nth = key
        own, above, _ = self.states[parent]
        over = above | (own & self.below)
        allowed = self.first | (over | (own & self.child)) << 1
        own, _, earlier = self.states[prev]
        before = earlier | (own & self.later)
        allowed |= (before | (own & self.next)) << 1
        state = tests & allowed
        if state & self.placed:
            state &= ~self.placed | nth
        fit, hit = set(), state & self.ends
        while hit:
            low = hit & -hit
            fit.add(self.owner[low])
            hit ^= low
        number = self.numbers.setdefault((state, over, before), len(self.states))
        if number == len(self.states):
            self.states.append((state, over, before))
        self.left -= 512
        self.steps[key] = number, tuple(sorted(fit))
        return self.steps[key]

    def found(self, page) -> Hits:
        """All pairs of a selector and an element that it fits."""
        if self.left < 0:
            self._forget()
        # The last number is that of no parent, and of no earlier sibling.
        numbers, selectors, elements = [0] * (len(page.tags) + 1), [], []
        passed, steps = self.passed, self.steps
        places = [self.nth.get(n, 0) for n in page.from_end] if self.placed else [0] * len(page.tags)
        for i, (written, parent, prev, nth) in enumerate(zip(page.written, page.parents, page.prevs, places, strict=True)):
            tests = passed.get(written)
            if tests is None:
                tests = self.tests(page.tags[i], page.attrs[i])
                if written is not None:
                    passed[written] = tests
                    self.left -= 128 + len(written)
            key = tests, numbers[parent], numbers[prev], nth
            step = steps.get(key) or self._step(key)
            numbers[i], fit = step
            if fit:
                selectors += fit
                elements += (i,) * len(fit)
        return Hits(self.size, selectors, elements)

    def hits(self, page) -> list[list[int]]:
        """For each selector the elements that it fits, in document order."""
        out: list[list[int]] = [[] for _ in range(self.size)]
        _, selectors, elements = self.found(page)
        for selector, element in zip(selectors, elements, strict=True):
            out[selector].append(element)
        return out
