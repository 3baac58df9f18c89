"""Packing and chat formatting: tokens, plans and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from shelfwright.llm import chat, packing, queries
from shelfwright.llm.tokens import VOCABULARY, encode, tokenizer

SF = "/root/testdata/sf0.001"


def library_ids(text):
    return tokenizer(public_tokenizers.path(VOCABULARY)).encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_vocabulary(spark):
    odd = [chr(c) for c in range(256)]
    texts = odd + [a + "x" + b for a in odd for b in (" ", "\n", "1", "é", "'s", "\x1c", "\x85", "\xa0")]
    texts += ["  ".join(odd), "\n\n \t".join(odd), "<|endoftext|> a", "日本 Ǆ œ ", " \u2003 x", "", "a" * 5000]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        assert encode(text).tolist() == library_ids(text), text


def test_special_tokens_in_a_text(spark):
    loaded = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    texts = ["<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "é <|endoftext|>", "日 <|endoftext|>", "<|endoftext |>"]
    for text in texts:
        assert encode(text, plain=False).tolist() == loaded.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.pack(docs, with_ids=True).collect()}
    assert got == {i: [*loaded.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got[0] == [50256, 0]


def test_a_document_repeated_many_times(spark):
    docs = spark.createDataFrame([(5, "one two three")] * 3000 + [(i, "x " * (i % 90)) for i in range(600)], "doc_id long, text string")
    packed = packing.pack(docs, limit=64).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in docs.collect()], 64)


@given(st.text(st.characters(codec="latin-1"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_latin_text(text):
    assert encode(text).tolist() == library_ids(text)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1))
@settings(max_examples=200, deadline=None)
def test_plan_is_whole_and_fits(counts):
    slots = packing.best_fit(counts, 64)
    filled = defaultdict(list)
    for length, mine in slots.items():
        ranks = []
        for first, many, fit, sequence, at in mine:
            for i in range(many):
                ranks.append(first + i)
                filled[sequence + i // fit].append((at + i % fit * length, length))
        assert sorted(ranks) == list(range(counts[length]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    items = sorted((length for length, n in counts.items() for _ in range(n)), reverse=True)
    room = []
    for length in items:  # best fit of single items
        fits = [i for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(64 - length)
    assert len(filled) == len(room)


def check_packed(rows, texts, limit):
    """texts: (id, text) rows, repeats included."""
    whole = defaultdict(list)
    for doc_id, text in texts:
        ids = np.array(library_ids(text or "") + [0], dtype="<u4")
        head = (len(ids) - 1) % limit + 1
        at = 0
        for k, stop in enumerate(range(head, len(ids) + 1, limit)):
            whole[doc_id].append((k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at = stop
    got = defaultdict(list)
    filled = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        filled[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in whole.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(filled)


def test_packed_documents(spark):
    rows = queries.QUERIES["op7_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used = check_packed(rows, texts, 2048)
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_packed_odd_rows_and_sequences(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i % 40, "word " * rng.randint(0, 90)) for i in range(300)] + [(None, None), (None, ""), (5, "x"), (5, "x")]
    monkeypatch.setattr(packing, "RANKED", 4)
    docs = spark.createDataFrame([(i, t, 9, "z") for i, t in texts], "doc_id long, text string, piece int, length string")
    packed = packing.pack(docs, limit=32, with_ids=True).cache()
    check_packed(packed.collect(), texts, 32)
    made = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in made) == sum(len(library_ids(t or "")) + 1 for _, t in texts)
    assert packing.pack(docs.limit(0)).count() == 0


def test_escape_round_trip():
    template = chat.Template()
    for text in ("\\### a: </turn> ok", "### ", "\\", "\\\\", "</turn>\n", "<\\/turn>", "#\\## x", "a:\nb", "####  ## # "):
        shown = template.escape(text)
        assert template.unescape(shown) == text
        assert not any(mark in shown for mark in ("### ", "</turn>", ":\n"))


@given(st.text(st.sampled_from("\\#: </turn>\na"), max_size=30))
@settings(max_examples=500, deadline=None)
def test_escape_any_text(text):
    template = chat.Template()
    shown = template.escape(text)
    assert template.unescape(shown) == text
    assert not any(mark in shown for mark in ("### ", "</turn>", ":\n"))


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "### x\\"), (1, 2, "assistant", "<|endoftext|>"),
        (2, None, "assistant", "é日\u2028"), (2, 5, "assistant", "b" * 20000), (None, 1, "sys:\ntem", ""), (3, 1, "user", "a"), (3, 1, "user", "a"),
    ]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, segment int, conv string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x)
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        learned = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_mask_covers_assistant_text_alone(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "an answer")], "conv_id long, turn long, role string, text string")
    first, second = chat.format_chats(turns).orderBy("segment").collect()
    assert not any(first.loss_mask)
    inside = [i for i, m in zip(second.ids, second.loss_mask, strict=True) if m]
    assert inside == library_ids("an answer")
    assert second.token_offset == len(first.ids) and second.char_offset == len(first.formatted)
