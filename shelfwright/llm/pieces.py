"""SentencePiece encoding and decoding: lattices of the distinct words of a batch, folded in numpy rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.bpe import _ranges
from shelfwright.llm.scratch import Scratch

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words up to this many characters are folded with their boundaries as the bits of one number.
BITS = 62
#: Characters that one round of numpy work holds; longer texts are cut between words.
CHUNK_CHARS = 1 << 20
POINTS = 0x110000
_WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Vocabulary:
    """The piece table as arrays: a trie of the pieces as sorted (node, character) keys, their order, and their bytes."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        children: dict[int, int] = {}
        of_node, scores, self.bytes = {}, np.zeros(size), [b""] * size
        for i in range(size):
            if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                continue
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[i] = bytes.fromhex(piece[3:5])
                continue
            self.bytes[i] = piece.replace(SPACE, " ").encode()
            scores[i] = self.library.get_score(i)
            node = 0
            for char in piece:
                node = children.setdefault(node * POINTS + ord(char), len(children) + 1)
            of_node[node] = i
        self.longest = max((len(self.library.id_to_piece(i)) for i in of_node.values()), default=0)
        self.byte_ids = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        #: the best-scored piece has the lowest number; pieces of one score have the same
        self.cost = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        keys = np.array(list(children), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), dtype=np.int64)[order]
        self.piece = np.full(len(children) + 1, -1, dtype=np.int64)
        self.piece[list(of_node)] = list(of_node.values())
        self.first = np.zeros(POINTS, dtype=np.int32)
        roots = self.keys < POINTS
        self.first[self.keys[roots]] = self.child[roots]
        self.packed = pa.array(self.bytes, pa.large_binary())


vocabulary = cache(Vocabulary)


def _bit(at: np.ndarray) -> np.ndarray:
    return np.uint64(1) << at.astype(np.uint64)


def edges(points: np.ndarray, left: np.ndarray, pieces: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 on, the places where a piece of that length stands, and its id.

    ``left`` is how many characters a word has from each place on. Substrings join the pieces a character at a time.
    """
    at, node = np.arange(len(points)), pieces.first[points].astype(np.int64)
    found = node > 0
    for n in range(1, pieces.longest + 1):
        at, node = at[found], node[found]
        ids = pieces.piece[node]
        yield at[ids >= 0], ids[ids >= 0]
        longer = left[at] > n
        at, node = at[longer], node[longer]
        key = node * POINTS + points[at + n]
        place = np.searchsorted(pieces.keys, key)
        place[place == len(pieces.keys)] = 0
        found = pieces.keys[place] == key
        node = pieces.child[place]


def fold(word: np.ndarray, start: np.ndarray, size: np.ndarray, cost: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The boundaries left in each word, as the bits of one number, after its edges (of two characters or more) are folded.

    All boundaries are there at first. Time after time each word takes its best-scored edge that joins exactly two
    neighbours (the leftmost of equals), and the boundary inside goes. Edges that can join no more leave the arrays.
    """
    mask = _bit(lengths + 1) - np.uint64(1)
    order = np.argsort((word << 32) | (cost << 12) | (start << 6) | size)
    word, start, size = word[order], start[order], size[order]
    ends, inside = _bit(start) | _bit(start + size), _bit(start + size) - _bit(start + 1)
    while len(word):
        now = mask[word]
        usable = (now & ends) == ends
        within = np.bitwise_count(now & inside)
        joins = np.flatnonzero(usable & (within == 1))
        if not len(joins):
            break
        owner = word[joins]
        best = joins[np.r_[True, owner[1:] != owner[:-1]]]
        mask[word[best]] &= ~inside[best]
        moved = np.zeros(len(lengths), dtype=bool)
        moved[word[best]] = True
        keep = usable & (within > 0) & moved[word]
        keep[best] = False
        word, ends, inside = word[keep], ends[keep], inside[keep]
    return mask


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of characters, on end, and how many each has."""
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    total = np.cumsum(sizes)
    point, size = np.repeat(points.astype(np.int64), sizes), np.repeat(sizes, sizes)
    k = np.arange(len(point)) - np.repeat(total - sizes, sizes)
    low = point >> (6 * (size - 1 - k))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    return np.where(k == 0, lead | low, 0x80 | (low & 63)), sizes


def encode_words(points: np.ndarray, lengths: np.ndarray, pieces: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of up to ``BITS`` characters, on end, and how many each has; characters without a piece become bytes.

    The model is a byte-pair one, whose ids are not those of the best sum of scores; see ``fold``.
    """
    firsts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    local = np.arange(len(points)) - firsts[word]
    found = list(edges(points, lengths[word] - local, pieces))
    many = found[1:]
    at = np.concatenate([a for a, _ in many]) if many else np.zeros(0, dtype=np.int64)
    ids = np.concatenate([i for _, i in many]) if many else np.zeros(0, dtype=np.int64)
    size = np.repeat(np.arange(2, 2 + len(many)), [len(a) for a, _ in many])
    mask = fold(word[at], local[at], size, pieces.cost[ids], lengths)

    begins = np.flatnonzero((mask[word] >> local.astype(np.uint64)) & np.uint64(1))
    spans = np.diff(np.r_[begins, len(points)])
    symbol = np.full(len(begins), -1, dtype=np.int64)
    for n, (places, of_places) in enumerate(found, 1):
        mine = np.flatnonzero(spans == n)
        if len(mine) and len(places):
            spot = np.minimum(np.searchsorted(places, begins[mine]), len(places) - 1)
            symbol[mine] = np.where(places[spot] == begins[mine], of_places[spot], -1)
    counts = np.ones(len(begins), dtype=np.int64)
    raw = np.flatnonzero(symbol < 0)
    out = symbol
    if len(raw):
        codes, sizes = _utf8(points[begins[raw]])
        counts[raw] = sizes
        out = np.repeat(symbol, counts)
        out[_ranges((np.cumsum(counts) - counts)[raw], sizes)] = pieces.byte_ids[codes]
    per_word = np.add.reduceat(counts, np.searchsorted(begins, firsts)) if len(firsts) else np.zeros(0, dtype=np.int64)
    return out, per_word


def _chunks(texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """(text's number, part with marks for its spaces): lists of about ``CHUNK_CHARS`` characters; a part starts a word."""
    held, size = [], 0
    for number, text in enumerate(texts):
        text = text.as_py()
        if not text:
            continue
        text = SPACE + text.replace(" ", SPACE)
        start = 0
        while start < len(text):
            cut = _WORD_START.search(text, start + CHUNK_CHARS) if len(text) - start > CHUNK_CHARS else None
            stop = cut.start() if cut else len(text)
            held.append((number, text[start:stop]))
            size += stop - start
            start = stop
            if size >= CHUNK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode_batch(texts: pa.Array, path: str) -> pa.Array:
    """The ids of each text, as lists."""
    pieces = vocabulary(path)
    counts, flat = np.zeros(len(texts), dtype=np.int64), []
    for parts in _chunks(texts):
        begins = np.cumsum([0, *(len(p) for _, p in parts)])
        points = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le"), dtype="<u4")
        marks = points == ord(SPACE)
        starts = marks.copy()
        starts[1:] &= ~marks[:-1]
        starts[begins[:-1]] = True
        at = np.flatnonzero(starts)
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(4 * np.r_[at, len(points)]), pa.py_buffer(points)]
        ).dictionary_encode()
        raw, offsets = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        index, offsets = offsets, np.frombuffer(raw.buffers()[1], dtype=np.int64)[: len(raw) + 1] // 4
        chars, lengths = np.frombuffer(raw.buffers()[2], dtype="<u4"), np.diff(offsets)
        short = lengths <= BITS
        ids, made = encode_words(chars[np.repeat(short, lengths)], lengths[short], pieces)
        sizes = np.zeros(len(lengths), dtype=np.int64)
        sizes[short] = made
        if not short.all():
            # words beyond the fold's width, by the library itself
            long = np.flatnonzero(~short)
            words = [chars[offsets[w] + 1 : offsets[w + 1]].tobytes().decode("utf-32-le") for w in long]
            more = [np.array(pieces.library.encode(w), dtype=np.int64) for w in words]
            sizes[long] = [len(m) for m in more]
            place = np.empty(len(lengths), dtype=np.int64)
            place[short], place[long] = np.cumsum(made) - made, len(ids) + np.cumsum(sizes[long]) - sizes[long]
            ids = np.concatenate([ids, *more])
        else:
            place = np.cumsum(sizes) - sizes
        flat.append(ids[_ranges(place[index], sizes[index])].astype(np.int32))
        number = np.array([n for n, _ in parts])
        np.add.at(counts, number[np.searchsorted(begins, at, side="right") - 1], sizes[index])
    values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, pa.int32()))


def decode_batch(ids: pa.Array, path: str) -> pa.Array:
    """The bytes of the pieces of each list, on end; ids without a piece give nothing."""
    pieces = vocabulary(path).packed
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    edges_ = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    values = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    known = (values >= 0) & (values < len(pieces))
    edges_ = np.r_[0, np.cumsum(known)][edges_]
    found = pieces.take(pa.array(values[known]))
    offsets = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1][edges_]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), found.buffers()[2]]
    ).cast(pa.binary())


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """One row per document: ``row_number``, id and ``ids``, the ids the library gives for the whole text.

    Spaces are marks at the front of words, which no piece crosses; so each distinct word of a batch is encoded once, from
    its lattice. Words of over 62 characters are encoded by the library. Nothing is shuffled. Texts are worked on in parts of
    about ``CHUNK_CHARS`` characters; only a text without any space is one part. Null and empty texts have no ids. Rows
    that repeat stay rows of their own, each with its own number. Other columns are not read. An empty table gives an
    empty table.
    """
    Scratch(docs.sparkSession, "pieces")  # sets the size of batches
    file = path or public_tokenizers.path(MODEL)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return encode_batch(texts, file)

    return docs.select(
        F.monotonically_increasing_id().alias("row_number"), F.col(id_col).alias(id_col),
        ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ids"),
    )


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(row_number, text) of the output of ``encode``: the bytes of the ids' pieces are put together."""
    file = path or public_tokenizers.path(MODEL)

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        return decode_batch(lists, file)

    text = F.decode(joined("ids"), "utf-8")
    return encoded.select("row_number", F.call_function("substring", text, F.lit(2)).alias("text"))
