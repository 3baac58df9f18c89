"""Vectors, URL rules and the classifier on odd rows and against plain Python."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwright.llm import quality, queries, urls, vectors
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def want_vectors(rows, threshold):
    good = [
        lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows
    ]
    links = []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if good[i] and good[j] and la == lb and len(a) == len(b):
                cos = np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))
                if cos >= threshold:
                    links.append((i, j))
    roots = brute.find_roots(range(len(rows)), links)
    least: dict = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(least.get(roots[k], i), i)
    count = [sum(k in pair for pair in links) for k in range(len(rows))]
    return sorted(((i, count[k], least.get(roots[k])) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile", [512, 7])
def test_vectors_against_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [
        (k, (centres[k % 6] + rng.normal(size=16) * rng.choice([0.02, 0.15, 1])).astype(np.float32).tolist(), int(k % 3))
        for k in range(150)
    ]
    rows += [(200 + k, rows[0][1], 0) for k in range(20)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15]
    rows += [(300 + k, v, 1) for k, v in enumerate(bad)] + [(310, rows[0][1], None), (311, rows[1][1][:8], 1)]
    rows += [(None, rows[2][1], 2), (None, [5.0] * 16, 2), (5, rows[5][1], 2), (400, (1e-3 * np.array(rows[3][1])).tolist(), 0)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, root int, links int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = vectors.near_vectors(table, 0.98, tile=tile)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr) == want_vectors(exact, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(200, 32)) * rng.choice([1e-6, 1, 1e6], size=(200, 1))
    b = a[rng.permutation(200)] + rng.normal(size=(200, 32)) * np.abs(a).max(axis=1, keepdims=True) * rng.choice([0.01, 0.1], size=(200, 1))
    for threshold in (0.5, 0.9, 0.98, 0.999):
        i, j = vectors.close_pairs(a, b, threshold)
        cos = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(cos >= threshold)), strict=True))


def test_urls_odd_rows(spark):
    texts = [
        None, "", "no scheme", "http://", "http://COM/", "http://com", "https://a.Example.com/en/x?q#h", "http://www.example.com/en/",
        "http://b.www.example.com/en/x", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/est", "http://y.net/fr/#a",
        "http://spam-farm.org/x", "http://farm.org/a/spam/b", "http://farm.org/spammer", "ftp://a://b.com/é?x", "http://É.com/\n/x",
        "http://net/es/", "http://x.net?/es/",
    ]
    want = {
        4: ("com", "/", "com/", "allow"), 5: ("com", "", None, "allow"), 6: ("a.example.com", "/en/x", "example.com/en/", "block"),
        7: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 8: ("b.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        9: ("notexample.com", "/en/", "com/", "allow"), 10: ("x.net", "/es/1", "net/es/", "block"), 11: ("x.net", "/est", None, "allow"),
        12: ("y.net", "/fr/", "net/fr/", "block"), 13: ("spam-farm.org", "/x", None, "block"), 14: ("farm.org", "/a/spam/b", None, "block"),
        15: ("farm.org", "/spammer", None, "allow"), 16: ("a:", "//b.com/é", None, "allow"), 17: ("É.com", "/\n/x", "com/", "allow"),
        18: ("net", "/es/", "net/es/", "block"), 19: ("x.net", "", None, "allow"),
    } | {k: ("", "", None, "allow") for k in range(4)}
    pages = spark.createDataFrame([(i, t, "h", "r") for i, t in enumerate(texts)] * 2, "page_id long, url string, host string, rule string")
    for inline in (256, 0):
        rows = urls.judge(pages, queries.URL_RULES, inline=inline).collect()
        assert len(rows) == 2 * len(texts)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_rarest_token_indexes_a_rule(spark):
    pages = spark.createDataFrame([("common.com", "/")] * 9 + [("rare.com", "/")], "host string, path string")
    index = urls.index_rules(pages, [urls.Rule("a.rare.common.com/", "block"), urls.Rule("shop", "block")])
    assert set(index) <= {"a", "rare", ""} and index[""][0].text == "shop"


def test_quality_of_documents(spark):
    rows = queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_quality_odd_rows(spark):
    good, bad = "plain words in a row. " * 30, "BUY!! NOW!! ### " * 30
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(100, None), (101, ""), (102, "a"), (None, good), (103, good * 400 + bad)]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.row.doc_id: r for r in got}
    assert by_id[100].score == by_id[101].score and by_id[None].held_out is False
    assert all(by_id[i].predicted == i % 2 for i in range(60))
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    unlabelled = quality.score_documents(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in unlabelled] == [0.5]


def test_every_byte_is_pooled():
    """A sign anywhere in a long text, also across the end of a chunk, reaches the maxima."""
    filters = np.zeros((quality.WIDTH, quality.FILTERS, 256))
    for k, c in enumerate(b"!@!@"):
        filters[k, 0, c] = 1
    network = quality.Network(filters, np.full(quality.FILTERS, -3.5), np.ones(quality.FILTERS), np.zeros(quality.FILTERS), 0.0)
    texts = [b"", b"!@!@", b"a" * 10_000] + [b"a" * n + b"!@!@" + b"b" * 700 for n in (0, 249, 250, 251, 252, 5_000)] + [b"!@!", b"x" * 900 + b"!@!@"]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])
    top, _ = quality.pooled(data, offsets, network)
    assert [bool(t[0] > 0) for t in top] == [b"!@!@" in t for t in texts]


def plain_pool(text, network):
    """Each filter at each window of each chunk, one after another; bytes beyond the text are zero."""
    tops, sums, n = [0.0] * quality.FILTERS, [0.0] * quality.FILTERS, 0
    for start in range(0, len(text), quality.CHUNK):
        n += 1
        for f in range(quality.FILTERS):
            best = 0.0
            for at in range(start, min(start + quality.CHUNK, len(text))):
                window = text[at : at + quality.WIDTH].ljust(quality.WIDTH, bytes(1))
                value = network.bias[f] + sum(network.filters[p, f, b] for p, b in enumerate(window))
                best = max(best, value)
            tops[f] = max(tops[f], best)
            sums[f] += best
    return tops, [x / max(1, n) for x in sums]


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(9)
    network = quality.Network(
        rng.normal(0, 0.5, (quality.WIDTH, quality.FILTERS, 256)), rng.normal(0, 0.5, quality.FILTERS),
        rng.normal(0, 0.3, quality.FILTERS), rng.normal(0, 0.3, quality.FILTERS), 0.2,
    )
    sizes = [0, 1, 3, 4, 5, 251, 252, 253, 255, 256, 504, 505, 3000, 20_011]
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)).decode() for n in sizes] + ["é" * 300, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(1)
    got = {r.id: r.score for r in df.select("id", quality.scorer(network)(F.col("text")).alias("score")).collect()}
    for i, text in enumerate(texts):
        top, mean = plain_pool((text or "").encode(), network)
        logit = sum(a * b for a, b in zip(top, network.top, strict=True)) + sum(a * b for a, b in zip(mean, network.mean, strict=True)) + 0.2
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-4, i


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 252, 253, 5000):
        text = bytes(i % 251 for i in range(n))
        chunks = quality.chunks_of(text)
        assert b"".join(c[: quality.CHUNK] for c in chunks) == text and len(chunks) == -(-n // quality.CHUNK)


def test_fit_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda chunks, labels: seen.append((chunks, labels)))
    docs = spark.createDataFrame([(i, "x" * 1000 + str(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    quality.learn(docs, labels, rows=10)
    quality.learn(docs, labels, most_bytes=5_100)
    assert [len(c) for c, _ in seen] == [10, 5] and all(len(x) == 4 for c, _ in seen for x in c)
