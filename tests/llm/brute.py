"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def find_roots(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def simhash(text: str | None) -> int:
    words = WORDS.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def repeated(sequences: list, size: int) -> list[list[tuple[int, int]]]:
    """Merged stretches of windows that start at two or more places, per sequence."""
    seen = Counter(s[i : i + size] for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        spans: list[tuple[int, int]] = []
        for i in range(len(s) - size + 1):
            if seen[s[i : i + size]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + size)
                else:
                    spans.append((i, i + size))
        out.append(spans)
    return out


def cut(sequence, spans):
    edges = [0, *[x for s in spans for x in s], len(sequence)]
    return [sequence[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
