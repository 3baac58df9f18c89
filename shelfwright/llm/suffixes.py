"""Repeated byte strings by bucket refinement over the suffixes of anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm import windows as W
from shelfwright.llm.scratch import Scratch, keyed_texts, tidied

Q = 64
#: Windows of one cell at the middle level of refinement.
CELL = 16
PLACES = "rid long, th long, place long"


def _anchors(size: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.raw(batch.column("text"))
            yield from W.anchor_rows(
                batch, offsets, lambda start, stop, data=data: W.TABLES[0][data[start:stop]], size, q
            )

    return run


def _contexts(size: int):
    """The bytes under each open run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.raw(batch.column("text"))
            places = batch.column("places")
            counts = places.value_lengths().to_numpy(zero_copy_only=False)
            place = places.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            first, _, more = W.unpacked(place)
            at, length = offsets[doc] + first, more + size
            for k in range(0, len(place), 2048):
                some = slice(k, k + 2048)
                stops = np.cumsum(length[some])
                spot = np.repeat(at[some] - (stops - length[some]), length[some]) + np.arange(stops[-1])
                yield pa.record_batch({
                    "rid": batch.column("rid").take(pa.array(doc[some])),
                    "th": batch.column("th").take(pa.array(doc[some])),
                    "place": place[some],
                    "context": pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(stops),
                        [None, pa.py_buffer(np.r_[0, stops].astype(np.int64)), pa.py_buffer(data[spot])],
                    ).cast(pa.binary()),
                })

    return run


def _cells(size: int, q: int):
    """Runs cut into cells of windows at fixed distances before the anchor.

    A cell's bucket is the bytes that all its windows share: the q-gram bucket, refined by what stands before
    and after. Its whole is all bytes under the cell; a cell that its run fills only in part has none, and
    stays open by an identifier of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.raw(batch.column("context"))
            if not batch.num_rows:
                continue
            base, data = offsets[:-1] - offsets[0], data[offsets[0] : offsets[-1]]
            sums = W.prefix(W.TABLES[0][data])
            rid, th, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "th", "place"))
            first, lead, more = W.unpacked(place)
            low, high = (lead - more) // CELL, lead // CELL
            count = high - low + 1
            row = np.repeat(np.arange(len(place)), count)
            cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            near, far = cell * CELL, np.minimum(cell * CELL + CELL - 1, size - q)
            anchor = base[row] + lead[row]
            bucket = W.mix(W.ids_of(sums, anchor - near, anchor - far + size) + cell.astype(np.uint64))
            whole = W.mix((rid[row] ^ W.mix(th[row].view(np.uint64)).view(np.int64)).view(np.uint64) ^ W.mix(place[row].view(np.uint64)))
            full = (far <= lead[row]) & (near >= (lead - more)[row])
            whole[full] = W.ids_of(sums, (anchor - far)[full], (anchor - near + size)[full])
            far, near = np.minimum(far, lead[row]), np.maximum(near, (lead - more)[row])
            yield pa.record_batch({
                "bucket": bucket.view(np.int64), "whole": whole.view(np.int64), "rid": rid[row], "th": th[row],
                "place": W.packed(first[row] + lead[row] - far, far, far - near),
            })

    return run


def _windows(size: int):
    """Each window of the open cells, with two identifiers of independent families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = W.raw(batch.column("context"))
            base, data = offsets[:-1] - offsets[0], data[offsets[0] : offsets[-1]]
            rid, th, place, inner = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "th", "place", "inner")
            )
            first, _, more = W.unpacked(inner)
            count = more + 1
            row = np.repeat(np.arange(len(place)), count)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            spot = base[row] + at - W.unpacked(place)[0][row]
            one, two = (
                W.ids_of(W.prefix(W.TABLES[f][data], f), spot, spot + size, f).view(np.int64) for f in (0, 1)
            )
            zero = np.zeros_like(at)
            yield pa.record_batch({
                "bucket": one, "whole": two, "rid": rid[row], "th": th[row], "place": W.packed(at, zero, zero),
            })

    return run


def repeated_places(texts: DataFrame, scratch: Scratch, size: int, q: int) -> DataFrame:
    """(rid, th, place) of all windows of ``size`` bytes that start at two or more places; texts: (rid, th, text)."""
    rows = "bucket long, whole long, rid long, th long, place long"
    anchors = scratch.save(texts.mapInArrow(tidied(_anchors(size, q)), rows), "anchors")
    kept, classes, open_ = W.repeated_classes(anchors, scratch, "runs")
    scratch.drop(anchors)
    lists = open_.groupBy("rid", "th").agg(F.collect_list("place").alias("places"))
    contexts = scratch.save(
        texts.join(lists, ["rid", "th"]).mapInArrow(tidied(_contexts(size)), f"{PLACES}, context binary"),
        "contexts",
    )
    cells = scratch.save(contexts.mapInArrow(tidied(_cells(size, q)), rows), "cells")
    cells_kept, cell_classes, cells_open = W.repeated_classes(cells, scratch, "cells")
    scratch.drop(cells)
    inner = contexts.withColumn("anchor", W.anchor_of(F.col("place"))).join(
        cells_open.select("rid", "th", F.col("place").alias("inner")).withColumn(
            "anchor", W.anchor_of(F.col("inner"))
        ),
        ["rid", "th", "anchor"],
    ).where(
        (F.shiftright("inner", 20) >= F.shiftright("place", 20))
        & (
            F.shiftright("inner", 20) + F.col("inner").bitwiseAND(F.lit(1023))
            <= F.shiftright("place", 20) + F.col("place").bitwiseAND(F.lit(1023))
        )
    )
    single = scratch.save(
        inner.select("rid", "th", "place", "inner", "context").mapInArrow(tidied(_windows(size)), rows), "windows"
    )
    again = scratch.save(
        single.groupBy("bucket", "whole").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again"
    )
    found = (
        W.settled(kept, classes)
        .unionByName(W.settled(cells_kept, cell_classes))
        .unionByName(single.join(again, ["bucket", "whole"], "left_semi").select("rid", "th", "place"))
    )
    return scratch.save(found, "places")


def merged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches joined where they touch or overlap."""
    if not len(first):
        return first, stop
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]])
    return first[new], reach[np.r_[new[1:], len(first)] - 1]


def _cut(size: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.raw(batch.column("text"))
            places = batch.column("places").to_pylist()
            removed, starts, stops, counts, kept = [], [], [], [], []
            for row, mine in enumerate(places):
                text = data[offsets[row] : offsets[row + 1]]
                if not mine:
                    kept.append(text.tobytes())
                    removed.append(0)
                    counts.append(0)
                    continue
                first, _, more = W.unpacked(np.array(mine, dtype=np.int64))
                first, stop = merged(first, first + more + size)
                edges = np.r_[0, np.stack([first, stop], axis=1).ravel(), len(text)]
                kept.append(b"".join(text[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(int((stop - first).sum()))
                counts.append(len(first))
                starts.append(first)
                stops.append(stop)
            flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, stops)]
            spans = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(x) for x in flat], ["start", "stop"]),
            )
            yield pa.record_batch(
                [batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())],
                names=fields,
            )

    return run


def remove_repeats(
    docs: DataFrame, size: int = 200, q: int = Q, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``row`` (its other columns), ``n_bytes``, ``n_removed``, ``spans`` and ``kept`` (bytes).

    Every byte is removed that lies in a string of ``size`` bytes which also starts anywhere else in the table. The
    suffixes sorted into buckets are those at anchors (see ``windows``); a bucket starts as the q-gram at the anchor and
    holds the run of windows around it. Buckets of one are done. Of the others, whole runs that agree are settled at
    once; the rest are refined by the identifiers of the bytes before and after, first for cells of 16 windows, then
    for single windows, and each level reuses what the level before has settled.

    Null and empty texts, and texts shorter than ``size``, keep everything. Rows that repeat an id and text repeat each
    other, so all their windows go. A text of any length is worked on in pieces of about 250,000 bytes. Other
    columns pass through inside ``row``, where their names cannot clash. An empty table gives an empty table.
    """
    if not q < size < 1000:
        raise ValueError("q must be below size, and size below 1000")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    texts = keyed_texts(docs, id_col, text_col)
    places = repeated_places(texts, scratch, size, q)
    lists = places.groupBy("rid", "th").agg(F.collect_set("place").alias("places"))
    rows = keyed_texts(docs.withColumn("llm_row", others), id_col, text_col, "llm_row")
    joined = rows.join(lists, ["rid", "th"], "left").select(F.col("llm_row").alias("row"), "text", "places")
    schema = T.StructType([
        T.StructField("row", joined.schema["row"].dataType),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())
        ]))),
        T.StructField("kept", T.BinaryType()),
    ])
    return joined.mapInArrow(tidied(_cut(size, schema.names)), schema)


def _whole_end(part: bytes) -> bytes:
    """The bytes without a last UTF-8 character that lacks some of its own."""
    for back in range(1, min(3, len(part)) + 1):
        byte = part[-back]
        if byte >= 0xC0:
            return part[:-back] if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else part
        if byte < 0x80:
            break
    return part


@F.arrow_udf(T.BinaryType())
def whole_characters(kept: pa.Array, spans: pa.Array) -> pa.Array:
    """``kept`` without the rest of a character that an edge of one of its ``spans`` cuts; all else stays as it is."""
    out = []
    for data, mine in zip(kept.to_pylist(), spans.to_pylist(), strict=True):
        if mine:
            parts, at, gone = [], 0, 0
            for span in mine:
                parts.append(_whole_end(data[at : span["start"] - gone]))
                at, gone = span["start"] - gone, gone + span["stop"] - span["start"]
                # what follows a cut starts with a whole character
                while at < len(data) and 0x80 <= data[at] < 0xC0:
                    at += 1
            parts.append(data[at:])
            data = b"".join(parts)
        out.append(data)
    return pa.array(out, pa.binary())
