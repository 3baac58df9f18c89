"""Ranked search against plain loops over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfwright.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(docs, items, k):
    """The contract as loops: docs are (id, text), items (id, text); rows of (item, rank, doc, score)."""
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in TERM.findall((text or "").translate(LOWER)) if t in c
            )
            if score > 0:
                scores.append((-score, 2**63 - 1 if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.rank_documents(d, i, k=k).collect()), key=str)


def test_equals_plain_loops(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Été", "été", "ÉTÉ", "x-y", "AB", "ab"]
    docs = [(rng.randrange(400), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for _ in range(500)]
    docs += [(7, "same same text w1")] * 40 + [(None, "w1 w2 same"), (1, None), (2, ""), (3, "!?.")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "unheard"), (None, "w1 same"), (93, "same"), (93, "w1"), (94, "w2 w2 w2"), (94, "w2 w2 w2")]
    assert run(spark, docs, items) == plain(docs, items, 10)
    assert run(spark, docs, items, k=3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], [])
    assert run(spark, [(1, None)], [(1, "a")]) == []


def test_other_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, "a", "y", 6)], "doc_id long, text string, item string, score int")
    items = spark.createDataFrame([(5, "a", 1)], "item_id long, text string, rank int")
    assert [(r.item_id, r.rank, r.doc_id) for r in ranked.rank_documents(docs, items).orderBy("rank").collect()] == [
        (5, 1, 2), (5, 2, 1)
    ]


def test_a_term_that_all_documents_have(spark):
    docs = [(i, "hot " * (1 + i % 3) + f"t{i}") for i in range(3000)]
    assert run(spark, docs, [(1, "hot"), (2, "hot t17 t2999")]) == plain(docs, [(1, "hot"), (2, "hot t17 t2999")], 10)


@pytest.mark.parametrize("leaf", [0, 1, 7, 100, 10**9])
def test_intervals_of_any_leaf_size(monkeypatch, leaf):
    monkeypatch.setattr(ranked, "LEAF", leaf)
    rng = np.random.default_rng(leaf % 97)
    for n_docs, n_terms, top in ((1, 1, 3), (50, 8, 4), (300, 20, 10), (300, 3, 10)):
        cells = rng.random((n_terms, n_docs)) < rng.random((n_terms, 1))
        impacts = np.where(cells, rng.integers(0, 6, (n_terms, n_docs)) * 10 ** rng.integers(0, 3, (n_terms, 1)), 0)
        terms, rows = np.nonzero(cells)
        shard = ranked.Shard(np.arange(n_docs), terms, rows, impacts[terms, rows].astype(np.int64), n_terms)
        for _ in range(15):
            own = np.sort(rng.choice(n_terms, rng.integers(1, n_terms + 1), replace=False))
            times = rng.integers(1, 4, len(own))
            sums = (impacts[own] * times[:, None]).sum(axis=0)
            want = sorted(((int(s), -i) for i, s in enumerate(sums) if s > 0), reverse=True)[:top]
            assert shard.top(own, times, top) == [(s, -i) for s, i in want]


def test_shards_of_any_size_merge(monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 40)
    monkeypatch.setattr(ranked, "SHARD_ROWS", 9)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30)))) for i in range(120)]
    docs.append((500, "a b c d e f " * 30))
    terms = {c.encode(): i for i, c in enumerate("abcdef")}
    batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t.encode() for _, t in docs])], names=["doc", "text"])
    coded = list(ranked._postings(terms)([batch.slice(0, 50), batch.slice(50)]))
    total, words = len(docs), sum(len(t.split()) for _, t in docs)
    weights = np.array([100, 50, 60, 70, 80, 90])
    items = [(0, np.array([0, 3]), np.array([1, 2])), (1, np.array([5]), np.array([1]))]
    found = [r for b in ranked._search(items, weights, total, words, 4)(coded) for r in b.to_pylist()]
    for item, own, times in items:
        best = sorted((-r["score"], r["doc"]) for r in found if r["item"] == item)[:4]
        want = []
        for i, t in docs:
            c, n = Counter(t.split()), len(t.split())
            m = 25 + (75 * n * total) // words
            want.append((-sum(int(weights[o]) * int(x) * (10**9 * c["abcdef"[o]] // (1000 * c["abcdef"[o]] + 8 * m))
                              for o, x in zip(own, times, strict=True)), i))
        assert best == sorted(want)[:4]


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(ranked, "PART", 10)
    text = ("Ab cd-éé " * 50 + "x" * 100).encode()
    assert ranked.term_counts(text) == Counter({b"ab": 50, b"cd": 50, "éé".encode(): 50, b"x" * 100: 1})
