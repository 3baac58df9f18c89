"""SentencePiece ids against the library, and the way back."""

import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from shelfwright.llm import pieces, queries
from tests.llm.brute import sha

SF = "/root/testdata/sf0.001"


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_ids_of_documents(spark):
    model = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for r in docs:
        ids = model.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(map(tuple, queries.QUERIES["op4_pieces"](spark, SF).collect())) == sorted(want)


def test_odd_texts(spark):
    model = library()
    texts = [
        None, "", " ", "  a  b\n\tc ", "日x\xa0 é ﬁ", "Ⅳ<s> a</s>", "\x00\x1f a", "x" * 500 + " y", "ab" * 31, "ab" * 32,
        "𝒳😀 ok", "a​b\r\nb", " " * 70, "the the", "the the",
    ]
    rows = [(i if i % 3 else None, t, 1, "x") for i, t in enumerate(texts)]
    coded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, word int, ids string")).cache()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), list(r.ids)) for r in coded.collect())
    assert got == sorted((-1 if i is None else i, model.encode(t or "")) for i, t, _, _ in rows)
    assert sorted(r.text for r in pieces.decode(coded).collect()) == sorted(t or "" for t in texts)
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_of_texts(monkeypatch):
    """Parts of a few characters, words at the fold's width, runs of spaces and marks: ids of the library, and the bytes back."""
    rng = random.Random(4)
    model, path = library(), public_tokenizers.path(pieces.MODEL)
    letters = ["a", "e", "t", "s", "the", "ing", "tion", " ", " ", "  ", "▁", "é", "日", "😀", "\n", "0", "xyz" * 25, "q" * 61, "w" * 62]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(300)]
    texts = [None, "", " ", "▁ ▁", *texts, "z" * 400 + " " + "é " * 90]
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(pieces, "CHUNK_CHARS", size)
        coded = pieces.encode_batch(pa.array(texts), path)
        assert coded.to_pylist() == [model.encode(t or "") for t in texts]
    want = [(" " + t.replace("▁", " ")).encode() if t else b"" for t in texts]
    assert pieces.decode_batch(coded, path).to_pylist() == want
    assert pieces.decode_batch(coded[3:9], path).to_pylist() == want[3:9]
    assert pieces.encode_batch(pa.array([], pa.string()), path).to_pylist() == []
    assert pieces.decode_batch(pa.array([None, [5, None, -1, 1 << 30]], pa.list_(pa.int32())), path).to_pylist()[0] == b""


def test_nothing_is_shuffled(spark):
    coded = pieces.encode(spark.read.parquet(f"{SF}/documents.parquet"))
    for made in (coded, pieces.decode(coded)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
