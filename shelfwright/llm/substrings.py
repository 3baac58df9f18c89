"""Repeated word spans by compacting a de Bruijn graph of word k-mers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm import windows as W
from shelfwright.llm.scratch import Scratch, keyed_texts

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
Q = 8
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
EDGE = "kind int, bucket long, whole long, head long, tail long, check long, rid long, th long, place long"


def word_units(data: np.ndarray, offsets: np.ndarray, *families: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word offsets of the rows, and the identifiers of all words in each family.

    Families 0 and 1 are the halves of a word's 128-bit BLAKE2 digest, so no pattern inside words makes them agree.
    """
    low = int(offsets[0])
    data, edges = data[low : int(offsets[-1])], offsets - low
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = edges[:-1][edges[:-1] < len(data)]
    begins[first] |= inside[first]
    last = edges[1:][edges[1:] > 0] - 1
    ends[last] |= inside[last]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    stops = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(stops), pa.py_buffer(data[inside])]
    ).dictionary_encode()
    digests = b"".join(hashlib.blake2b(w.as_buffer(), digest_size=16).digest() for w in words.dictionary)
    halves = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
    index = words.indices.to_numpy(zero_copy_only=False)
    return np.searchsorted(begins, edges), [halves[index, family] for family in families]


def _anchors(size: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                offsets, (units,) = word_units(*W.raw(batch.column("text")), 0)
                yield from W.anchor_rows(batch, offsets, lambda start, stop, units=units: units[start:stop], size, q)

    return run


def _edges(size: int):
    """Settled runs as one path each, open runs as one edge per k-mer, with the (k-1)-mers at both ends."""

    def ids(sums, first, stop, family=0):
        return W.ids_of(sums, first, stop, family).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, (units, others) = word_units(*W.raw(batch.column("text")), 0, 1)
            sums, checks = W.prefix(units), W.prefix(others, 1)
            lists = batch.column("runs")
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            place, bucket, whole, n, mixed = (
                flat.field(k).to_numpy(zero_copy_only=False) for k in ("place", "bucket", "whole", "n", "mixed")
            )
            rid, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "th"))
            first, _, more = W.unpacked(place)
            at, stop = offsets[doc] + first, offsets[doc] + first + more + size
            s = np.flatnonzero(n > 1)
            yield pa.record_batch({
                "kind": np.zeros(len(s), dtype=np.int32), "bucket": bucket[s], "whole": whole[s],
                "head": ids(sums, at[s], at[s] + size - 1), "tail": ids(sums, stop[s] - size + 1, stop[s]),
                "check": ids(checks, at[s], stop[s], 1), "rid": rid[doc[s]], "th": th[doc[s]], "place": place[s],
            })
            s = np.flatnonzero(mixed)
            count = more[s] + 1
            for k in range(0, len(s), 2048):
                some, each = s[k : k + 2048], count[k : k + 2048]
                row = np.repeat(some, each)
                step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                x, zero = at[row] + step, np.zeros_like(step)
                yield pa.record_batch({
                    "kind": np.ones(len(row), dtype=np.int32), "bucket": ids(sums, x, x + size),
                    "whole": ids(checks, x, x + size, 1), "head": ids(sums, x, x + size - 1),
                    "tail": ids(sums, x + 1, x + size), "check": ids(checks, x, x + size, 1),
                    "rid": rid[doc[row]], "th": th[doc[row]], "place": W.packed(first[row] + step, zero, zero),
                })

    return run


def compact(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(seg, path): segments (seg, head, tail) joined end to end wherever no other segment enters or leaves.

    Each segment points to its only successor. Pointers double by a self-join until they reach the end of their
    path, which names it; the pointers that never do lie on circles, named by their smallest segment.
    """
    leaving = segments.groupBy("head").agg(F.count("*").alias("n"), F.min("seg").alias("v")).where("n = 1")
    entering = segments.groupBy("tail").agg(F.count("*").alias("n"), F.min("seg").alias("u")).where("n = 1")
    state = scratch.save(
        entering.join(leaving, F.col("tail") == F.col("head"))
        .where("u <> v")
        .select("u", F.col("v").alias("to"), F.least("u", "v").alias("low"), F.lit(False).alias("done")),
        "links",
    )
    steps, before_active = 1, None
    while True:
        active = state.where("NOT done").count()
        # a path that has not ended has pointers that reach its end in each round: if none did, circles are left
        if not active or (active == before_active and steps > active):
            break
        before_active = active
        ahead = state.select(F.col("u").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        moved = (
            state.where("NOT done")
            .join(ahead, "to", "left")
            .select(
                "u", F.coalesce("far", "to").alias("to"), F.least("low", "far_low").alias("low"),
                F.col("far").isNull().alias("done"),
            )
        )
        before, state = state, scratch.save(state.where("done").unionByName(moved), "links")
        scratch.drop(before)
        steps *= 2
    pointed = state.select(F.col("u").alias("seg"), F.when(F.col("done"), F.col("to")).otherwise(F.col("low")).alias("path"))
    return segments.select("seg", "check").join(pointed, "seg", "left").select(
        "seg", "check", F.coalesce("path", "seg").alias("path")
    )


def repeated_spans(texts: DataFrame, scratch: Scratch, size: int, q: int) -> DataFrame:
    """(rid, th, place, path, check) of all stretches of repeated k-mers; texts: (rid, th, text)."""
    rows = "bucket long, whole long, rid long, th long, place long"
    anchors = scratch.save(texts.mapInArrow(_anchors(size, q), rows), "anchors")
    kept, classes, open_ = W.repeated_classes(anchors, scratch, "runs")
    scratch.drop(anchors)
    mixed = scratch.save(open_.select("bucket").distinct(), "open")
    wanted = classes.join(mixed.withColumn("mixed", F.lit(True)), "bucket", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    lists = wanted.groupBy("rid", "th").agg(
        F.collect_list(F.struct("place", "bucket", "whole", "n", "mixed")).alias("runs")
    )
    edges = scratch.save(texts.join(lists, ["rid", "th"]).mapInArrow(_edges(size), EDGE), "edges")
    single = edges.where("kind = 1")
    again = scratch.save(
        single.groupBy("bucket", "whole").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again"
    )
    kmers = scratch.save(
        single.join(again, ["bucket", "whole"], "left_semi").withColumn("seg", F.xxhash64("bucket", "whole", F.lit(1))),
        "kmers",
    )
    paths = edges.where("kind = 0").withColumn("seg", F.xxhash64("bucket", "whole", F.lit(0)))
    segments = scratch.save(
        paths.select("seg", "head", "tail", "check")
        .unionByName(kmers.select("seg", "head", "tail", "check"))
        .groupBy("seg")
        .agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("check").alias("check")),
        "segments",
    )
    scratch.drop(edges)
    compacted = scratch.save(compact(segments, scratch), "paths")
    occurrences = kept.select("rid", "th", "place", F.xxhash64("bucket", "whole", F.lit(0)).alias("seg")).unionByName(
        kmers.select("rid", "th", "place", "seg")
    )
    return scratch.save(occurrences.join(compacted, "seg").select("rid", "th", "place", "path", "check"), "spans")


def _cut(size: int, fields: list[str]):
    """Stretches whose words, read again at their coordinates, bear their path's check are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = W.raw(batch.column("text"))
            word_at, (units,) = word_units(data, offsets, 1)
            sums = W.prefix(units, 1)
            lists = batch.column("spans")
            total, removed, spans, kept = [], [], [], []
            for row in range(batch.num_rows):
                words = WORD.findall(data[offsets[row] : offsets[row + 1]].tobytes())
                total.append(len(words))
                mine = lists[row].values
                if mine is None or not len(mine):
                    kept.append(b" ".join(words))
                    removed.append(0)
                    spans.append([])
                    continue
                place, path, check = (mine.field(k).to_numpy(zero_copy_only=False) for k in ("place", "path", "check"))
                first, _, more = W.unpacked(place)
                stop = first + more + size
                same = W.ids_of(sums, word_at[row] + first, word_at[row] + stop, 1).view(np.int64) == check
                order = np.flatnonzero(same)[np.argsort(first[same], kind="stable")]
                left, gone, out = [], 0, []
                at = 0
                for s, e, p in zip(first[order].tolist(), stop[order].tolist(), path[order].tolist(), strict=True):
                    if s > at:
                        left += words[at:s]
                    gone += max(0, e - max(s, at))
                    at = max(at, e)
                    if out and out[-1]["path"] == p and s <= out[-1]["stop"]:
                        out[-1]["stop"] = max(e, out[-1]["stop"])
                    else:
                        out.append({"start": s, "stop": e, "path": p})
                kept.append(b" ".join(left + words[at:]))
                removed.append(gone)
                spans.append(out)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("path", pa.int64())]))
            yield pa.record_batch(
                [
                    batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=fields,
            )

    return run


def remove_spans(
    docs: DataFrame, size: int = 35, q: int = Q, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``row`` (its other columns), ``n_words``, ``n_removed``, ``spans`` and ``kept`` (text).

    Each ``size`` consecutive words of one document are an edge between their first and last ``size - 1`` words. Every
    word goes that lies in an edge which also starts anywhere else in the table. Edges with one anchor (see
    ``windows``) travel as one run; runs that repeat as a whole are paths already, the others whose anchor repeats
    are taken apart into edges. Repeated paths and edges are then joined end to end where nothing branches, and
    ``spans`` gives each document's word coordinates with the compacted path they lie on. Before removal, the words
    at these coordinates are read again and held against an independent identifier of the path's words.

    Null, empty and short texts keep everything. Rows that repeat an id and text repeat each other. Texts and words
    may be of any length. Other columns pass through inside ``row``. An empty table gives an empty table.
    """
    if not q < size < 1000:
        raise ValueError("q must be below size, and size below 1000")
    scratch = Scratch(docs.sparkSession, "substrings")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    found = repeated_spans(keyed_texts(docs, id_col, text_col), scratch, size, q)
    lists = found.groupBy("rid", "th").agg(F.collect_set(F.struct("place", "path", "check")).alias("spans"))
    rows = keyed_texts(docs.withColumn("llm_row", others), id_col, text_col, "llm_row")
    joined = rows.join(lists, ["rid", "th"], "left").select(F.col("llm_row").alias("row"), "text", "spans")
    long = T.LongType()
    schema = T.StructType([
        T.StructField("row", joined.schema["row"].dataType),
        T.StructField("n_words", long),
        T.StructField("n_removed", long),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", long), T.StructField("stop", long), T.StructField("path", long)
        ]))),
        T.StructField("kept", T.StringType()),
    ])
    return joined.mapInArrow(_cut(size, schema.names), schema)
