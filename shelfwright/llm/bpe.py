"""Byte-pair encoding with word ends, in batched numpy merge rounds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

VOCABULARY = "word_bpe_49k.json"
#: Characters that one round of numpy work holds; longer texts are cut at blanks, which no word crosses.
CHUNK_CHARS = 1 << 20
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: The word pattern that `words` follows, and the letters that may follow an apostrophe in it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT, LONG = "stmd", ("re", "ve", "ll")
NEVER = np.iinfo(np.int32).max


class Model:
    """A vocabulary file of this kind as arrays: sorted pair keys with their ranks, and the symbols of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bpe, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        if bpe["type"] != "BPE" or not suffix or split != PATTERN or spec["decoder"] is not None:
            raise ValueError(f"{path} is no byte-pair vocabulary with word ends of the expected pattern")
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        vocabulary = bpe["vocab"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that do not match as they stand")
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

        strings = np.empty(self.size, dtype=object)
        for token, i in [*vocabulary.items(), *self.special.items()]:
            strings[i] = token
        self.strings = pa.array(strings, pa.string())

        shown = _byte_letters()
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocabulary[shown[b] + suffix] for b in range(256)], dtype=np.int64)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(
            *((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs), strict=True
        ))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        # A round merges every place of a word's lowest pair at once. That is the order of one merge at a time
        # as long as no symbol takes part in a merge of lower rank than the one that makes it.
        first_use = np.full(self.size, NEVER, dtype=np.int64)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        if (first_use[made] <= np.arange(len(pairs))).any():
            raise ValueError(f"{path} uses a symbol before it is made")

        self.kinds = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.split = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """The class of each character, asked of the library's own pattern the first time it is met."""
        found = self.kinds[points]
        if (found == UNKNOWN).any():
            for point in np.unique(points[found == UNKNOWN]).tolist():
                char = chr(point)
                size = [len(self.split.pre_tokenize_str(x + char)) for x in ("a", "!")]
                if size[0] == 1:
                    kind = LETTER if len(self.split.pre_tokenize_str("a" + char)[0][0]) == 2 else SPACE
                else:
                    kind = OTHER if size[1] == 1 else NUMBER
                self.kinds[point] = kind
            found = self.kinds[points]
        return found


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


model = cache(Model)


def words(text: str, vocabulary: Model) -> tuple[pa.Array, np.ndarray]:
    """The words of a normalised text as UTF-8 and the character each starts at."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds = vocabulary.classes(points)
    starts = kinds != SPACE
    starts[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    # An apostrophe that opens a run and stands alone takes certain letters with it.
    padded = np.concatenate([points, np.zeros(3, dtype=np.uint32)])
    marks = np.flatnonzero(starts & (points == ord("'")))
    one = np.isin(padded[marks + 1], [ord(c) for c in SHORT])
    two = np.zeros(len(marks), dtype=bool)
    for first, second in LONG:
        two |= (padded[marks + 1] == ord(first)) & (padded[marks + 2] == ord(second))
    for places, taken in ((marks[one], 1), (marks[two], 2)):
        starts[places + 1] = False
        behind = places + 1 + taken
        behind = behind[behind < len(points)]
        starts[behind] = kinds[behind] != SPACE
    at = np.flatnonzero(starts)
    sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    solid = kinds != SPACE
    if not solid.all():
        raw = raw[np.repeat(solid, sizes)]
        sizes = np.where(solid, sizes, 0)
    lengths = np.add.reduceat(sizes, at) if len(at) else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]
    ), at


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Model) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words, on end in one array, until none has a pair left: the symbols and the new lengths.

    A round looks up every pair by binary search, takes the lowest rank of each word, and merges all its places from
    the left. Words without a pair leave the array, so a round costs what is still open.
    """
    ends = np.cumsum(lengths)
    done_symbols, done_lengths = np.empty_like(symbols), np.zeros_like(lengths)
    where = ends - lengths  # where each word may write: it only ever shrinks
    open_words = np.flatnonzero(lengths > 0)
    symbols = symbols.astype(np.int64)
    sizes = lengths[open_words]
    while len(open_words):
        firsts = np.cumsum(sizes) - sizes
        key = symbols * vocabulary.size
        key[:-1] += symbols[1:]
        at = np.searchsorted(vocabulary.keys, key)
        at[at == len(vocabulary.keys)] = 0
        rank = np.where(vocabulary.keys[at] == key, vocabulary.ranks[at], NEVER)
        rank[firsts + sizes - 1] = NEVER
        lowest = np.minimum.reduceat(rank, firsts)
        closed = lowest == NEVER
        if closed.any():
            leave = np.repeat(closed, sizes)
            ids, count = open_words[closed], sizes[closed]
            done_symbols[_ranges(where[ids], count)] = symbols[leave]
            done_lengths[ids] = count
            stay = ~leave
            symbols, rank, at = symbols[stay], rank[stay], at[stay]
            open_words, sizes, lowest = open_words[~closed], sizes[~closed], lowest[~closed]
            if not len(open_words):
                break
        chosen = rank == np.repeat(lowest, sizes)
        both = chosen[1:] & chosen[:-1]
        if both.any():  # a pair of twice the same symbol: every second place of a run, from its left end
            place = np.flatnonzero(chosen)
            fresh = np.concatenate([[True], np.diff(place) > 1])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            chosen[place[(np.arange(len(place)) - run_start) % 2 == 1]] = False
        symbols[chosen] = vocabulary.made[at[chosen]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = ~chosen[:-1]
        firsts = np.cumsum(sizes) - sizes
        sizes = np.add.reduceat(keep.astype(np.int64), firsts)
        symbols = symbols[keep]
    return done_symbols[_ranges(where, done_lengths)], done_lengths


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each start, on end."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def _chunks(texts: pa.Array, vocabulary: Model) -> Iterator[list[tuple[int, str, int | None]]]:
    """(text's number, normalised part, special id behind it): lists of about ``CHUNK_CHARS`` characters."""
    held, size = [], 0
    for number, text in enumerate(texts):
        text = text.as_py() or ""
        start = 0
        while start < len(text) or not start:
            stop = start + CHUNK_CHARS
            if stop < len(text):
                blank = re.compile(r"[ \n]").search(text, stop)
                stop = blank.start() if blank else len(text)
            part = text[start:stop]
            pieces = vocabulary.special_pattern.split(part) if vocabulary.special_pattern else [part]
            for i in range(0, len(pieces), 2):
                behind = vocabulary.special[pieces[i + 1]] if i + 1 < len(pieces) else None
                held.append((number, vocabulary.normalize(pieces[i]) if pieces[i] else "", behind))
            size += len(part) + 1
            start = max(stop, 1)
            if size >= CHUNK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode_batch(texts: pa.Array, path: str) -> pa.Array:
    """The ids of each text, as lists."""
    vocabulary = model(path)
    counts = np.zeros(len(texts), dtype=np.int64)
    flat = []
    for parts in _chunks(texts, vocabulary):
        numbers = np.array([p[0] for p in parts])
        begins = np.cumsum([0, *(len(p[1]) + 1 for p in parts)])
        found, at = words(" ".join(p[1] for p in parts), vocabulary)
        coded = found.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        lengths = np.diff(offsets)
        raw = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(distinct) else \
            np.zeros(0, dtype=np.uint8)
        symbols = vocabulary.inner[raw]
        symbols[np.cumsum(lengths) - 1] = vocabulary.last[raw[np.cumsum(lengths) - 1]]
        ids, lengths = merge_rounds(symbols, lengths, vocabulary)
        part_of = np.searchsorted(begins, at, side="right") - 1
        # Special tokens are one more kind of word, behind the words of their part.
        behind = [(i, p[2]) for i, p in enumerate(parts) if p[2] is not None]
        if behind:
            extra = np.array([x[1] for x in behind])
            places = np.searchsorted(part_of, [x[0] for x in behind], side="right")
            index = np.insert(index, places, len(lengths) + np.arange(len(extra)))
            part_of = np.insert(part_of, places, [x[0] for x in behind])
            ids, lengths = np.concatenate([ids, extra]), np.concatenate([lengths, np.ones(len(extra), dtype=np.int64)])
        firsts, sizes = np.cumsum(lengths) - lengths, lengths[index]
        flat.append(ids[_ranges(firsts[index], sizes)].astype(np.int32))
        np.add.at(counts, numbers[part_of], sizes)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def decode_batch(ids: pa.Array, path: str) -> pa.Array:
    """The tokens of each list, joined by a blank, special ones included; ids outside the vocabulary give nothing."""
    strings = model(path).strings
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    values, offsets = ids.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
    known = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, len(strings))), False)
    tokens = strings.take(pc.if_else(known, values, None))
    if tokens.null_count:
        real = tokens.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        tokens = tokens.drop_null()
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens), " ")
    return pc.if_else(ids.is_valid(), joined, None).cast(pa.string())


def encode(text: Column, path: str | None = None) -> Column:
    """Ids (array of int) of whole texts, equal to those of the tokenizers library without special tokens added.

    Words are those of the vocabulary's own normaliser and pattern; the distinct words of a batch are merged together.
    A null or empty text has no ids. Strings of special tokens in a text are those tokens, as in the library. Texts are
    worked on in parts of about ``CHUNK_CHARS`` characters, so long ones need no more memory than their ids; only a
    text without any blank is one part. Each row stands alone: ties, repeated rows and other columns change nothing.
    """
    file = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return encode_batch(texts, file)

    return ids(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text the library decodes ids to, special tokens included: for a vocabulary without a decoder, its tokens
    joined by blanks. Null gives null, an empty list an empty text, an id outside the vocabulary nothing.
    """
    file = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return decode_batch(lists, file)

    return text(ids)
