"""The near-duplicate stage against all pairs in plain Python."""

import random

import corpus_pipeline as pipeline
from shelfwright.llm import shingles
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = brute.WORDS.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def keep_first(rows):
    """Positions of the rows kept, of (id, text) in the order of ids, null ids last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    sets = [shingle_set(rows[k][1]) for k in order]
    links = [(i, j) for i in range(len(order)) for j in range(i) if similar(sets[i], sets[j])]
    roots = brute.find_roots(range(len(order)), links)
    return [order[k] for k in range(len(order)) if roots[k] == k]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_copies_with_edited_words(spark):
    """Two words of 69 edited: far in SimHash, near in shingles."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IN (1, 177)")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [1]


def test_links_of_both_methods(spark):
    """Texts of one fingerprint but few common shingles, near ones far in SimHash, and a group that takes both to connect."""
    rng = random.Random(5)
    tail = [" ".join(f"{k}{rng.random()}" for _ in range(60)) for k in "abc"]
    base = [f"w{i}" for i in range(140)]
    rows = [(9, "spam " * 900 + tail[0]), (7, "spam " * 900 + tail[1]), (8, "Spam " * 900 + tail[2])]
    rows += [(None, "SPAM " * 900 + tail[2]), (3, " ".join(base)), (2, edited(rng, base, 2)), (4, "alone"), (5, None), (6, "")]
    chain = [f"c{i}" for i in range(80)]
    rows += [(10, " ".join(["x"] * 1200 + chain)), (11, " ".join(chain)), (12, "x " * 1200 + "z")]
    prints = [brute.simhash(t) for _, t in rows]
    sets = [shingle_set(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 4 or similar(sets[i], sets[j])
    ]
    assert any(not similar(sets[i], sets[j]) for i, j in links)
    assert any((prints[i] ^ prints[j]).bit_count() > 4 for i, j in links)
    roots = brute.find_roots(range(len(rows)), links)
    groups = [[r[0] for k, r in enumerate(rows) if roots[k] == root] for root in set(roots.values())]
    want = sorted(min(x for x in g if x is not None) for g in groups)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want


def test_representatives_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (3, 5, 6, 30, 70, 140, 300, 900)]
    rows = [(None, None), (900, ""), (901, " \t"), (902, "a b"), (903, "A  b"), (None, "a b c"), (904, "a b c d e"), (905, "a b c d e f")]
    for base in bases:
        for edits in range(0, 1 + len(base) // 20):
            rows += [(len(rows), edited(rng, base, edits)) for _ in range(4)]
    license_ = [f"l{i}" for i in range(40)]
    rows += [(len(rows), edited(rng, license_ + [f"u{rng.random()}" for _ in range(60)], 1)) for _ in range(20)]
    rows += [(5, "a b"), (len(rows), " ".join(bases[4]).upper())]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").coalesce(1)
    want = sorted(((rows[k][0], rows[k][1]) for k in keep_first(rows)), key=repr)
    for tile in (1 << 18, 500):
        monkeypatch.setattr(shingles, "TILE", tile)
        got = sorted(((r.doc_id, r.text) for r in shingles.representatives(docs).collect()), key=repr)
        assert got == want


def test_representatives_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(rows[k][0] for k in keep_first(rows))
    assert sorted(r.doc_id for r in shingles.representatives(docs).collect()) == want


def test_copies_do_not_travel_to_each_bucket(spark, monkeypatch, tmp_path):
    """Groups of many near copies, some of them beside texts that share a passage: few sets are shipped, and all links found."""
    rng = random.Random(11)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(150)]
        rows += [(len(rows) + i, edited(rng, base, 1)) for i in range(30)]
        rows += [(len(rows) + i, " ".join(base[40:60] + [f"o{rng.random()}" for _ in range(80)])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    compare, folder = shingles._similar, str(tmp_path)

    def counted(batches):
        import os
        import uuid

        for batch in batches:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(len(batch.column("shingles").flatten())))
            yield from compare(iter([batch]))

    monkeypatch.setattr(shingles, "_similar", counted)
    got = sorted(r.doc_id for r in shingles.representatives(docs).collect())
    assert got == sorted(rows[k][0] for k in keep_first(rows))
    shipped = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert shipped <= 3 * sum(len(shingle_set(t)) for _, t in rows)


def test_rounds(spark, monkeypatch):
    """Buckets that are not connected after the first comparison are compared in rounds; none is lost."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    rows = [(0, "")]
    for g in range(12):
        base = common + [f"g{g}w{i}" for i in range(60)]
        rows += [(len(rows) + i, edited(rng, base, i % 3)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(rows[k][0] for k in keep_first(rows))
    monkeypatch.setattr(shingles, "ROUND", 0.5)
    assert sorted(r.doc_id for r in shingles.representatives(docs).collect()) == want


def test_no_documents(spark):
    assert shingles.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_inside_characters(spark):
    """Only the rest of a cut character goes; genuine replacement characters and nulls stay."""
    same = "q" * 198
    # the repeat is the last byte of a character, the passage, and the first byte of a character
    rows = [
        (1, "� a � é" + same + "é b �"), (2, "x 日�ĩ" + same + "ê�"), (3, None), (4, "�é日"), (5, ""),
        (6, "�é" + "p" * 199 + " �"), (7, "ĩ" + "p" * 199 + "!"),
    ]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars int").coalesce(1)
    cut = pipeline.cut_repeats(spark, docs, "")
    assert cut.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    want = {1: "� a �  b �", 2: "x 日��", 3: None, 4: "�é日", 5: "", 6: "� �", 7: "!"}
    assert got == {k: (t, None if t is None else len(t)) for k, t in want.items()}
