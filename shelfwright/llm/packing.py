"""Best-fit packing of token sequences, planned on a histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm.scratch import Scratch, tidied
from shelfwright.llm.tokens import encode

#: Rows of one length that are ranked together; more are ranked in several groups.
RANKED = 512


def _pieces(limit: int, end_id: int, with_ids: bool, names: list[str], paths: tuple[str | None, str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                all_ids = np.append(encode(text.as_py() or "", *paths, plain=False), np.uint32(end_id)).astype("<u4")
                head = (len(all_ids) - 1) % limit + 1
                at = 0
                for k, stop in enumerate(range(head, len(all_ids) + 1, limit)):
                    part = all_ids[at:stop]
                    doc.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part)
                    at = stop
            columns = [
                batch.column("id").take(pa.array(doc, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            if with_ids:
                columns.append(
                    pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)),
                        pa.array(np.concatenate(ids) if ids else np.zeros(0), pa.int32()),
                    )
                )
            yield pa.record_batch(columns, names=names)

    return run


def best_fit(counts: dict[int, int], limit: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Best fit over counts, longest first: per length its slots as (first rank, ranks, per sequence, sequence, offset).

    Open sequences with the same room and filling are one entry with a count. All pieces of one length fill the
    smallest room that takes them, as many to a sequence as fit; an entry is split at most in three per length, so the
    plan grows with the number of lengths, not of documents.
    """
    room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in [*sorted(r for r in room if r >= length), None]:
            if not left:
                break
            entries = room.pop(free) if free is not None else [((), left)]
            size = limit if free is None else free
            fit = size // length
            for filling, many in entries:
                full = min(many, left // fit)
                if full:
                    room[size - fit * length].append(((*filling, (length, fit)), full))
                    left -= full * fit
                    many -= full
                if left and many:
                    room[size - left * length].append(((*filling, (length, left)), 1))
                    left, many = 0, many - 1
                if many and free is not None:
                    room[free].append((filling, many))
    slots: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for free in sorted(room):
        for filling, many in room[free]:
            offset = 0
            for length, fit in filling:
                slots[length].append((taken[length], many * fit, fit, sequence, offset))
                taken[length] += many * fit
                offset += length * fit
            sequence += many
    return slots


def pack(
    docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    with_ids: bool = False, tokenizer_path: str | None = None, ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is its token ids and ``end_id``. One longer than ``limit`` is cut into pieces of ``limit``, the first one
    shorter if need be. Only the count of pieces per length (at most ``limit`` numbers) comes to the driver; the plan
    made of it is a table of one row per length. Each piece is ranked among those of its length, a frequent length
    in several groups whose sizes are summed up first, and takes the slot of its rank. Groups are dealt by a piece's place in
    the stored table, so copies of one document are spread as well.

    Null and empty texts are one piece that holds ``end_id`` alone. Rows that repeat an id are documents of their own.
    Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [
        T.StructField("id", source.schema["id"].dataType), T.StructField("piece", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ]
    schema = T.StructType(fields)
    cut = _pieces(limit, end_id, with_ids, schema.names, (tokenizer_path, ranks_path))
    pieces = scratch.save(source.mapInArrow(tidied(cut), schema).withColumn("seat", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = best_fit(counts, limit)
    plan = spark.createDataFrame(
        [(length, -(-counts[length] // RANKED), slots[length]) for length in sorted(slots)],
        "length long, groups int, slots array<struct<first:long,ranks:long,fit:long,sequence:long,at:long>>",
    )
    # one row per length, at most `limit` of them
    small = F.broadcast(plan.select("length", "groups"))
    dealt = pieces.join(small, "length").withColumn(
        "grp", F.pmod(F.xxhash64("seat"), F.col("groups"))
    )
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("length", "grp").agg(F.count("*").alias("n"))
        .select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("length", "grp").orderBy("seat")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["length", "grp"])
    rank = F.col("base") + F.col("place")
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["ranks"]))[0]
    within = F.col("rank") - F.col("slot.first")
    return (
        ranked.withColumn("rank", rank)
        .join(F.broadcast(plan.select("length", "slots")), "length")
        .withColumn("slot", slot)
        .select(
            F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
            (F.col("slot.sequence") + F.expr("(rank - slot.first) DIV slot.fit")).alias("sequence_id"),
            (F.col("slot.at") + within % F.col("slot.fit") * F.col("length")).alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
