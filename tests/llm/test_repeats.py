"""Repeated byte strings and near-duplicate texts against plain Python."""

import random

import pyarrow as pa
import pytest

from shelfwright.llm import queries, shingles, simhash, substrings, suffixes, windows
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def byte_rows(frame):
    return sorted(
        (r.row.doc_id or 0, r.n_bytes, r.n_removed, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept))
        for r in frame.collect()
    )


def want_bytes(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), text, spans in zip(rows, texts, brute.repeated(texts, size), strict=True):
        out.append((doc_id or 0, len(text), sum(b - a for a, b in spans), tuple(spans), b"".join(brute.cut(text, spans))))
    return sorted(out)


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 20, 45, 90)]
    rows = [(i, " ".join(rng.choice([word(), word(), rng.choice(passages)]) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, "a" * 199), (105, passages[3])]
    rows += [(106, passages[3]), (106, passages[3]), (106, passages[2] * 3), (None, passages[1] * 2), (None, "a" * 210)]
    return rows


def test_bytes_against_brute_force(spark):
    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, th int, places int")
    for size, q in ((200, 64), (60, 16)):
        assert byte_rows(suffixes.remove_repeats(docs, size, q)) == want_bytes(rows, size)


def test_bytes_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(1, "x" + part * 2), (2, part[:700] + "y"), (3, "".join(rng.choice("abc") for _ in range(5000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert byte_rows(suffixes.remove_repeats(docs)) == want_bytes(rows, 200)


def test_bytes_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op9_suffix_dedup"](spark, SF).collect())
    assert got == sorted((d, n, k, len(s), brute.sha(t)) for d, n, k, s, t in want_bytes(rows, 200))


def merged(spans):
    out = []
    for s in spans:
        if out and s.start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s.stop))
        else:
            out.append((s.start, s.stop))
    return tuple(out)


def want_words(rows, size):
    texts = [tuple(brute.WORDS.findall((t or "").encode())) for _, t in rows]
    out = []
    for (doc_id, _), words, spans in zip(rows, texts, brute.repeated(texts, size), strict=True):
        kept = b" ".join(w for part in brute.cut(words, spans) for w in part)
        out.append((doc_id or 0, len(words), sum(b - a for a, b in spans), tuple(spans), kept.decode()))
    return sorted(out)


def test_words_against_brute_force(spark):
    rows = odd_texts() + [(300, "one two three " * 40), (301, "\x00 \x0b\x1c a " * 30), (302, "w" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, th int, path int")
    for size, q in ((35, 8), (10, 3)):
        got = sorted(
            (r.row.doc_id or 0, r.n_words, r.n_removed, merged(r.spans), r.kept)
            for r in substrings.remove_spans(docs, size, q).collect()
        )
        assert got == want_words(rows, size)


def test_words_beyond_a_piece(spark):
    long = ("x" * (1 << 21)) + " " + " ".join(str(i) for i in range(400_000))
    rows = [(1, long), (2, "a b " + long[-2000:]), (3, "y " + long[: (1 << 21)] + " 0 1 2 3 4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_spans(docs).collect()}
    tail = len(long[-2000:].split()[1:])
    assert got == {1: (400_001, tail), 2: (3 + tail, tail), 3: (7, 0)}


def test_words_that_differ_by_a_pattern(spark):
    """Thue-Morse words cancel in any polynomial modulo a power of two; no sequence of 35 words repeats here."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"c{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{common} {one}"), (2, f"{common} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_spans(docs, size=35).collect()] == [0, 0]
    texts = [" ".join([one] * 3 + [f"x{i}" for i in range(20)]), " ".join([other] * 3 + [f"x{i}" for i in range(20)])]
    docs = spark.createDataFrame([(1, one), (2, other), (3, texts[0]), (4, texts[1])], "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.representatives(docs).collect()) == [1, 2, 3, 4]
    at, (units,) = substrings.word_units(*windows.raw(pa.array([one, other, one])), 0)
    assert at.tolist() == [0, 1, 2, 3] and units[0] == units[2] != units[1]


def test_words_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op3_substrings"](spark, SF).collect())
    assert got == sorted((d, n, k, brute.sha(t.encode())) for d, n, k, _, t in want_words(rows, 35))


def test_paths_and_circles(spark):
    from shelfwright.llm.scratch import Scratch

    chain = [(i, 100 + i, 101 + i) for i in range(9)]
    circle = [(20, 300, 301), (21, 301, 302), (22, 302, 300)]
    fork = [(30, 109, 500), (31, 109, 501)]
    segments = spark.createDataFrame([(*s, 0) for s in chain + circle + fork], "seg long, head long, tail long, check long")
    paths = {r.seg: r.path for r in substrings.compact(segments, Scratch(spark, "test")).collect()}
    assert {paths[i] for i in range(9)} == {8}
    assert {paths[i] for i in (20, 21, 22)} == {20}
    assert paths[30] == 30 and paths[31] == 31


@pytest.mark.parametrize("links", [3, 5])
def test_lone_path(spark, links):
    """The longest path left alone, of a length that is no power of two, bears one name."""
    from shelfwright.llm.scratch import Scratch

    rows = [(50 - i, 100 + i, 101 + i, 0) for i in range(links + 1)]
    segments = spark.createDataFrame(rows, "seg long, head long, tail long, check long")
    assert {r.path for r in substrings.compact(segments, Scratch(spark, "test")).collect()} == {50 - links}


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_no_documents(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert suffixes.remove_repeats(empty).count() == 0
    assert substrings.remove_spans(empty).count() == 0
    assert simhash.near_texts(empty).count() == 0


def simhash_want(rows):
    prints = [brute.simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = brute.find_roots(range(len(rows)), links)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(least.get(roots[k], i), i)
    return sorted(
        ((i, f"{prints[k]:016x}", least.get(roots[k])) for k, (i, _) in enumerate(rows)), key=repr
    )


def test_simhash_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op1_simhash"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == simhash_want(rows)


def test_simhash_odd_rows(spark):
    rows = odd_texts() + [(200, "One two"), (201, "one  TWO"), (202, " \t"), (202, "one two three four"), (None, "one two")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, fp int")
    assert sorted(map(tuple, simhash.near_texts(docs).collect()), key=repr) == simhash_want(rows)


def test_simhash_dense_bucket(spark):
    """Thousands of fingerprints in one bucket: linked whole, over several tiles."""
    import itertools

    from pyspark.sql import functions as F

    from shelfwright.llm.components import components
    from shelfwright.llm.scratch import Scratch

    near = [sum(1 << b for b in bits) for bits in itertools.combinations(range(0, 40, 2), 3)]
    far = [x | 0x7FFF << 45 for x in near]
    prints = spark.createDataFrame([(x,) for x in near + far], "fp long")
    scratch = Scratch(spark, "test")
    roots = components(simhash.link(prints, 4, scratch), scratch)
    groups = roots.groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in groups) == [len(near), len(far)]


def test_thresholds_cover_the_distance():
    assert sum(t + 1 for t in simhash.allocate([[5, 9, 20], [1, 2, 3], [100, 200, 300]], 4)) == 5
    assert simhash.allocate([[5, 9], [1, 2], [1000, 2000]], 3) == [1, 1, -1]
