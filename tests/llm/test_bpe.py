"""Byte-pair encoding with word ends against the tokenizers library and against one merge at a time."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwright.llm import bpe, queries

PATH = public_tokenizers.path(bpe.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own_ids(texts):
    return bpe.encode_batch(pa.array(texts, pa.string()), PATH).to_pylist()


def one_merge_at_a_time(word, vocabulary):
    """The rule itself: of all pairs the lowest rank, of its places the first."""
    symbols = [*vocabulary.inner[list(word[:-1])], vocabulary.last[word[-1]]] if len(word) > 1 else [vocabulary.last[word[0]]]
    table = dict(zip(vocabulary.keys.tolist(), zip(vocabulary.ranks.tolist(), vocabulary.made.tolist(), strict=True), strict=True))
    while True:
        options = [
            (table[key][0], i, table[key][1])
            for i, key in enumerate(int(a) * vocabulary.size + int(b) for a, b in zip(symbols, symbols[1:], strict=False))
            if key in table
        ]
        if not options:
            return [int(s) for s in symbols]
        _, i, made = min(options)
        symbols[i : i + 2] = [made]


ODD = [
    None, "", " ", "\n\t ", "it's they'll we've 's''s'sabc 'reabc '", "''' '' 's 't'sm 'd1'll9", "a" * 41,
    "<|endoftext|>", "Hi <|endoftext|> you<|startoftext|>x<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>",
    "ΑΣ ΣΑΣ Σ", "é é İI ﬁ Ⅷ½²", "中文字" * 300, "́ ́a‍️😀👍🏽", "\u0085  x　y",
]


def test_odd_texts_equal_the_library():
    assert own_ids(ODD) == [library_ids(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="'strevlmd !1aé<|>", max_size=40)), max_size=5))
def test_any_text_equals_the_library(texts):
    ids = own_ids(texts)
    assert ids == [library_ids(t) for t in texts]
    decoded = bpe.decode_batch(pa.array(ids, pa.list_(pa.int32())), PATH).to_pylist()
    assert decoded == [LIBRARY.decode(i, skip_special_tokens=False) for i in ids]


def test_rounds_equal_one_merge_at_a_time():
    vocabulary, rng = bpe.model(PATH), random.Random(5)
    made = [bytes(rng.choice(b"aaabehnstio \xc3\xa9".replace(b" ", b"")) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    raw = np.frombuffer(b"".join(made), dtype=np.uint8)
    lengths = np.array([len(w) for w in made])
    symbols = vocabulary.inner[raw]
    symbols[np.cumsum(lengths) - 1] = vocabulary.last[raw[np.cumsum(lengths) - 1]]
    ids, sizes = bpe.merge_rounds(symbols, lengths, vocabulary)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [one_merge_at_a_time(w, vocabulary) for w in made]


def test_parts_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abe' é1\n<|endoftext|>") for _ in range(900)) for _ in range(20)]
    texts += ["x" * 5000, "ab cd " * 2000 + "<|endoftext|>", ""]
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 64)
    assert own_ids(texts) == [library_ids(t) for t in texts]


def test_a_text_of_a_megabyte_without_a_blank():
    text = "".join(random.Random(2).choice("etaoinshrdlu") for _ in range(200_000))
    assert own_ids([text]) == [library_ids(text)]


def test_decode_of_odd_ids():
    lists = pa.array([[49407, 320], [], None, [-1, 320, 10**6, None]], pa.list_(pa.int32()))
    assert bpe.decode_batch(lists, PATH).to_pylist() == ["<|endoftext|> a</w>", "", None, "a</w>"]
    assert bpe.decode_batch(lists.slice(1, 3), PATH).to_pylist() == ["", None, "a</w>"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Model(public_tokenizers.path("byte_bpe_50k.json"))


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "Hello hello's", "x"), (None, None, None), (1, "Hello hello's", "x"), (2, "", "y")]
    docs = spark.createDataFrame(rows, "id long, body string, ids string")
    got = docs.withColumn("tokens", bpe.encode(F.col("body"))).collect()
    assert sorted(map(str, ((r.id, r.ids, r.tokens) for r in got))) == sorted(
        str((i, x, library_ids(t))) for i, t, x in rows
    )
    assert docs.limit(0).select(bpe.encode(F.col("body")), bpe.decode(F.array().cast("array<int>"))).collect() == []


def test_query_equals_the_library(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library_ids(d.text)
        row = got[d.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
