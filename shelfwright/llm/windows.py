"""Windows of fixed length over sequences of units (bytes or words): anchors, identifiers, repeated classes.

Every window of ``size`` units has an anchor: the leftmost of its q-grams with the smallest hash. It depends on the
window's content alone, so equal windows have their anchors at the same place. Consecutive windows with one
anchor form a run; runs, about one per 60 bytes, stand for all windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.scratch import Scratch

#: Units handled at once; longer sequences are cut into overlapping pieces. A piece takes some 15 MB of arrays.
PIECE = 1 << 17
_PLACE = np.uint64((1 << 22) - 1)
_rng = np.random.default_rng(20240229)
TABLES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
BASES = [int(x) * 2 + 1 for x in _rng.integers(1 << 60, 1 << 62, 2, dtype=np.uint64)]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n + 1`` powers of the base and of its inverse, modulo 2**64; a worker keeps the longest made."""
    if family in _POWERS and len(_POWERS[family][0]) > n:
        return _POWERS[family]
    n = 1 << max(16, int(n).bit_length())
    out = []
    for base in (BASES[family] % (1 << 64), pow(BASES[family], -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    _POWERS[family] = out[0], out[1]
    return _POWERS[family]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix(units: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which ``ids_of`` takes the identifier of any stretch."""
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(len(units), family)[0][: len(units)], out=out[1:])
    return out


def ids_of(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit identifier of each stretch, the same wherever its content stands."""
    return mix((sums[stop] - sums[start]) * powers(len(sums), family)[1][start])


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out


@dataclass
class Runs:
    """Runs of windows: first and last window, anchor, identifiers of the anchor's q-gram and of the whole stretch."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    bucket: np.ndarray
    whole: np.ndarray


def runs(units: np.ndarray, stops: np.ndarray, size: int, q: int) -> Runs:
    """The runs of a piece that holds several sequences, which end at ``stops``."""
    n = len(units)
    none = np.zeros(0, dtype=np.int64)
    if n < size:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    sums, inverse = prefix(units), powers(n)[1]
    grams = mix((sums[q:] - sums[:-q]) * inverse[: n - q + 1])
    order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (smallest_in(order, size - q + 1) & _PLACE).astype(np.int64)
    crossing = np.zeros(n + 1, dtype=np.int32)
    ends = np.unique(stops[(stops > 0) & (stops < n)])
    np.add.at(crossing, np.maximum(ends - size + 1, 0), 1)
    np.add.at(crossing, ends, -1)
    window = np.flatnonzero(np.cumsum(crossing[: n - size + 1]) == 0)
    if not len(window):
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    at = anchor[window]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    first, last, at = window[new], window[np.r_[new[1:], len(window)] - 1], at[new]
    place = (at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    whole = mix(mix((sums[last + size] - sums[first]) * inverse[first]) ^ place)
    return Runs(first, last, at, grams[at], whole)


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, start, stop): whole sequences up to PIECE units, long ones in overlapping parts."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        start = int(offsets[row])
        end = max(row + 1, int(np.searchsorted(offsets, start + PIECE, side="right")) - 1)
        stop = int(offsets[end])
        if stop - start <= PIECE:
            yield row, end, start, stop
        else:
            for at in range(start, max(start + 1, stop - size + 1), PIECE - size + 1):
                yield row, row + 1, at, min(stop, at + PIECE)
        row = end


def packed(first: np.ndarray, lead: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Place of a run in one whole number: first window, units up to the anchor, windows after the first."""
    return (first.astype(np.int64) << 20) | (lead.astype(np.int64) << 10) | more.astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 20, (place >> 10) & 1023, place & 1023


def anchor_of(place: Column) -> Column:
    return F.shiftright(place, 20) + F.shiftright(place, 10).bitwiseAND(F.lit(1023))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column as one array, and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def anchor_rows(
    batch: pa.RecordBatch, offsets: np.ndarray, units: Callable[[int, int], np.ndarray], size: int, q: int
) -> Iterator[pa.RecordBatch]:
    """(bucket, whole, rid, th, place) of the runs of all rows, whose units start at the offsets."""
    rid, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "th"))
    for row, end, start, stop in pieces(offsets, size):
        found = runs(units(start, stop), offsets[row + 1 : end + 1] - start, size, q)
        if not len(found.first):
            continue
        doc = row + np.searchsorted(offsets[row + 1 : end + 1], start + found.first, side="right")
        place = packed(start + found.first - offsets[doc], found.anchor - found.first, found.last - found.first)
        yield pa.record_batch({
            "bucket": found.bucket.view(np.int64), "whole": found.whole.view(np.int64),
            "rid": rid[doc], "th": th[doc], "place": place,
        })


def repeated_classes(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One refinement of buckets. Rows are (bucket, whole, rid, th, place).

    Returns the rows whose bucket holds at least two, the classes of equal (bucket, whole) with their size ``n`` and
    one place, and of these the ones still open: in a bucket that has a class of one row beside others. A class of
    two or more rows is settled, its windows all repeat, and one of its rows goes on as witness for the open
    ones. Buckets of one row are dropped: nothing equals them.

    Counts are combined before they are shuffled, and stored before rows meet them: a join of two stored tables is
    one that adaptive execution can split, so no bucket that holds a large share of all rows stays in one task.
    """
    again = scratch.save(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "again")
    kept = scratch.save(rows.join(again, "bucket"), f"{name}-kept")
    classes = scratch.save(
        kept.groupBy("bucket", "whole").agg(
            F.count("*").alias("n"), F.first("rid").alias("rid"), F.first("th").alias("th"),
            F.first("place").alias("place"),
        ),
        f"{name}-classes",
    )
    mixed = scratch.save(
        classes.groupBy("bucket")
        .agg(F.count("*").alias("classes"), F.sum((F.col("n") == 1).cast("int")).alias("single"))
        .where("classes > 1 AND single > 0")
        .select("bucket"),
        "mixed",
    )
    return kept, classes, classes.join(mixed, "bucket")


def settled(kept: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid, th, place) of rows in classes of two or more."""
    return kept.join(
        classes.where("n > 1").select("bucket", "whole"), ["bucket", "whole"], "left_semi"
    ).select("rid", "th", "place")
