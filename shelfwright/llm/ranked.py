"""Ranked lexical search: best-first document intervals over range-maximum tables of posting lists."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.scratch import Scratch

#: A shard ends at whichever comes first; its tables take some 100 bytes a posting.
SHARD_POSTINGS, SHARD_ROWS = 1 << 20, 1 << 16
#: An interval with at most this many postings is added up outright, which costs less than to split it again.
LEAF = 2048
#: Bytes of item texts that one pass over the documents answers.
BLOCK_BYTES = 8 << 20
#: Bytes of a text whose terms are held at once.
PART = 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Letters and digits of ASCII, and whatever is not ASCII; on UTF-8 bytes this is the same as on characters.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text; only A-Z is lower-cased."""
    if len(text) <= PART:
        return Counter(TERM.findall(text.translate(LOWER)))
    counts, start = Counter(), 0
    while start < len(text):
        cut = BREAK.search(text, min(start + PART, len(text)))
        stop = cut.start() if cut else len(text)
        counts.update(TERM.findall(text[start:stop].translate(LOWER)))
        start = stop
    return counts


def _postings(terms: dict[bytes, int]):
    """(doc, n, terms, tfs) of each document with a term at all; only the items' terms are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes, ends, held, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                docs.append(doc)
                sizes.append(counts.total())
                for term in counts.keys() & terms.keys():
                    held.append(terms[term])
                    tfs.append(counts[term])
                ends.append(len(held))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch(
                [
                    pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(held, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                names=["doc", "n", "terms", "tfs"],
            )

    return run


class Shard:
    """Posting lists of some documents, on end in one array, with a range-maximum sparse table over their impacts."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, rows: np.ndarray, impacts: np.ndarray, n_terms: int):
        """``rows`` (places in ``docs``, which are sorted by id) rise within each term; ``terms`` are sorted."""
        self.docs, self.rows, self.impacts = docs, rows, impacts
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1))
        self.keys = terms.astype(np.int64) * len(docs) + rows
        longest = int(np.diff(self.starts).max(initial=1))
        levels = [np.arange(len(rows), dtype=np.int32)]
        for k in range(1, longest.bit_length()):
            below, half = levels[-1], 1 << (k - 1)
            left, right = below[:-half], below[half:]
            level = below.copy()
            level[:-half] = np.where(impacts[right] > impacts[left], right, left)
            levels.append(level)
        self.table = np.stack(levels)
        sizes = np.arange(longest + 1)
        sizes[0] = 1
        self.log = np.frexp(sizes)[1] - 1

    def highest(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each non-empty stretch [s, e) of one list."""
        level = self.log[e - s]
        left, right = self.table[level, s], self.table[level, e - (1 << level)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def interval(self, lo: int, hi: int, terms: np.ndarray, times: np.ndarray, s: np.ndarray, e: np.ndarray):
        """The interval of rows [lo, hi) as a heap entry: what its documents can score at most, and where to split it."""
        some = e > s
        if not some.all():
            terms, times, s, e = terms[some], times[some], s[some], e[some]
        if not len(s):
            return None
        at = self.highest(s, e)
        best = self.impacts[at] * times
        return -int(best.sum()), lo, hi, int(self.rows[at[int(best.argmax())]]), terms, times, s, e

    def top(self, terms: np.ndarray, times: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, row) of the ``k`` best rows with a score above 0; ties go to the smaller row.

        The interval with the largest bound goes first. It is split at the document of its largest single impact,
        which is scored in full; both sides get bounds of their own. The search ends when no bound left can still
        change the list.
        """
        found: list[tuple[int, int]] = []  # a heap of (score, -row), the worst first

        def offer(score: int, row: int) -> None:
            if score > 0:
                if len(found) < k:
                    heapq.heappush(found, (score, -row))
                elif (score, -row) > found[0]:
                    heapq.heapreplace(found, (score, -row))

        heap = []

        def push(entry) -> None:
            if entry and entry[0] < 0 and (len(found) < k or (-entry[0], -entry[1]) > found[0]):
                heapq.heappush(heap, entry[:4] + (len(heap), entry[4:]))

        push(self.interval(0, len(self.docs), terms, times, self.starts[terms], self.starts[terms + 1]))
        while heap:
            bound, lo, hi, split, _, (terms, times, s, e) = heapq.heappop(heap)
            if len(found) == k and (-bound, -lo) <= found[0]:
                break
            if int((e - s).sum()) <= LEAF:
                for score, row in self._sums(lo, hi, times, s, e, k, found[0][0] if len(found) == k else 1):
                    offer(score, row)
                continue
            wanted = terms * len(self.docs) + split
            place = np.searchsorted(self.keys, wanted)
            here = np.zeros(len(place), dtype=bool)
            inside = place < len(self.keys)
            here[inside] = self.keys[place[inside]] == wanted[inside]
            offer(int((self.impacts[place[here]] * times[here]).sum()), split)
            push(self.interval(lo, split, terms, times, s, place))
            push(self.interval(split + 1, hi, terms, times, place + here, e))
        return [(score, -row) for score, row in sorted(found, reverse=True)]

    def _sums(self, lo: int, hi: int, times: np.ndarray, s: np.ndarray, e: np.ndarray, k: int, least: int):
        """The best ``k`` rows of an interval that reach ``least``, from all its postings."""
        sizes = e - s
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(s - (ends - sizes), sizes)
        rows, order = np.unique(self.rows[at], return_inverse=True)
        sums = np.zeros(len(rows), dtype=np.int64)
        np.add.at(sums, order, self.impacts[at] * np.repeat(times, sizes))
        reach = np.flatnonzero(sums >= least)
        best = reach[np.lexsort((rows[reach], -sums[reach]))[:k]]
        return zip(sums[best].tolist(), rows[best].tolist(), strict=True)


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(item, doc, score): the ``k`` best documents of each shard for each item."""

    def answer(held: list[tuple]) -> pa.RecordBatch:
        docs, sizes, counts, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
        by_id = np.argsort(docs, kind="stable")
        place = np.empty(len(docs), dtype=np.int64)
        place[by_id] = np.arange(len(docs))
        rows = np.repeat(np.arange(len(docs)), counts)
        length = 100 - 75 + (75 * sizes * n_docs) // n_terms
        tf = tfs.astype(np.int64)
        impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[rows]))
        rows = place[rows]
        order = np.lexsort((rows, terms))
        shard = Shard(docs[by_id], terms[order], rows[order], impacts[order], len(weights))
        out = []
        for item, own, times in items:
            out += [(item, int(shard.docs[row]), score) for score, row in shard.top(own, times, k)]
        return pa.record_batch(
            [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int64(), pa.int64()), strict=True)],
            names=["item", "doc", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, rows = [], 0, 0
        for batch in batches:
            lists, tfs = batch.column("terms"), batch.column("tfs")
            ends = lists.offsets.to_numpy()
            start = 0
            while start < batch.num_rows:
                # As many rows as the shard has room for, one at least.
                room = np.searchsorted(ends, ends[start] + SHARD_POSTINGS - postings, side="right") - 1
                stop = int(min(max(room, start + 1), start + SHARD_ROWS - rows, batch.num_rows))
                first, last = ends[start], ends[stop]
                values = lists.values.to_numpy()[first:last], tfs.values.to_numpy()[first:last]
                part = batch.slice(start, stop - start)
                held.append((
                    part.column("doc").to_numpy(), part.column("n").to_numpy(), np.diff(ends[start : stop + 1]), *values,
                ))
                postings, rows, start = postings + int(last - first), rows + stop - start, stop
                if postings >= SHARD_POSTINGS or rows >= SHARD_ROWS or start < batch.num_rows:
                    yield answer(held)
                    held, postings, rows = [], 0, 0
        if held:
            yield answer(held)

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items a few megabytes at a time; the driver holds one block."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row["text"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
    weight: Callable[[int, int], int] = lambda n, df: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))),
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the whole table for each item, in whole numbers.

    A document scores, for each term of the item and each time it occurs there, the term's weight times
    ``10**9 tf div (1000 tf + 8 m)`` with ``m = 25 + 75 n N div L``; counts are over all documents that have a term. Only
    documents with a score above 0 are returned; ties go to the smaller id.

    Items are the query set: they are worked on in blocks of ``BLOCK_BYTES`` of text, each one pass over all documents. A pass
    stores the postings of the block's terms, counts them, and cuts the documents into shards where they lie. In a
    shard every posting list has a range-maximum table; the interval of documents with the largest sum of maxima is
    split at its largest impact until no interval can change the list. Shards share the global counts, so
    their lists merge exactly; nothing but counts and lists of ``k`` is shuffled, whatever a term's frequency.

    Null texts have no terms. Null ids of documents rank last among ties and come back null; rows that repeat an id are documents
    of their own. Items that repeat id and text are one item; items with one id, null included, and different
    texts are ranked apart. Other columns are not read. Without documents, items or common terms the result is empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    last = 2**63 - 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    corpus = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(last)).alias("doc"), text)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), text).distinct()
    schema = "item_id long, rank int, doc_id long, score long"
    results = []
    for block in _blocks(asked):
        counted = [term_counts(bytes(row["text"])) for row in block]
        terms = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        if not terms:
            continue
        coded = scratch.save(
            corpus.mapInArrow(_postings(terms), "doc long, n long, terms array<int>, tfs array<int>"), "postings"
        )
        n_docs, n_terms = coded.agg(F.count("n"), F.sum("n")).first()
        df = coded.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.zeros(len(terms), dtype=np.int64)
        for row in df.collect():  # at most the block's distinct terms
            weights[row["term"]] = weight(n_docs, row["count"])
        queries = []
        for i, counts in enumerate(counted):
            own = np.array([terms[t] for t in counts], dtype=np.int64)
            times = np.array(list(counts.values()), dtype=np.int64)
            if len(own):
                queries.append((i, own, times))
        found = scratch.save(
            coded.mapInArrow(_search(queries, weights, n_docs, n_terms, k), "item int, doc long, score long"), "found"
        )
        scratch.drop(coded)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], "item int, item_id long")
        results.append(
            ranked.join(F.broadcast(names), "item").select(
                "item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(last)).alias("doc_id"), "score"
            )
        )
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out
