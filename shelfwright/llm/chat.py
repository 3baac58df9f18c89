"""Conversations as token ids with a loss mask, and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm.scratch import Scratch, task_count
from shelfwright.llm.tokens import VOCABULARY, encode, tokenizer


@dataclass(frozen=True)
class Template:
    """Control strings and the reserved ids that stand for them, beyond the vocabulary's own."""

    begin: str = "### "
    colon: str = ":\n"
    end: str = "</turn>\n"
    first_id: int = 50257

    @property
    def reserved(self) -> tuple[int, int, int]:
        return self.first_id, self.first_id + 1, self.first_id + 2

    def escape(self, text: str) -> str:
        r"""Doubles each backslash, then breaks control strings by one after their first character."""
        text = text.replace("\\", "\\\\")
        for mark in (self.begin, self.colon, self.end.rstrip("\n")):
            text = text.replace(mark, mark[0] + "\\" + mark[1:])
        return text

    @staticmethod
    def unescape(text: str) -> str:
        parts = text.split("\\\\")
        return "\\".join(p.replace("\\", "") for p in parts)


def _segments(template: Template, trained: tuple[str, ...], names: list[str]):
    """Each turn as ids: role and text are encoded apart, the reserved ids are spliced in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, colon, end = (np.array([i], dtype=np.uint32) for i in template.reserved)
        current, turns, tokens, chars = object(), 0, 0, 0
        for batch in batches:
            out = {name: [] for name in names[1:]}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != current:
                    current, turns, tokens, chars = conv, 0, 0, 0
                role, text = template.escape(role or ""), template.escape(text or "")
                head, body = encode(role), encode(text)
                ids = np.concatenate([begin, head, colon, body, end])
                edge = np.zeros(len(ids) + 1, dtype=np.int8)
                if template.unescape(role) in trained:
                    edge[len(head) + 2] += 1
                    edge[len(head) + 2 + len(body)] -= 1
                shown = template.begin + role + template.colon + text + template.end
                for name, value in zip(
                    names[1:], (turns, shown, ids.astype(np.int32), np.cumsum(edge[:-1]).astype(bool), tokens, chars),
                    strict=True,
                ):
                    out[name].append(value)
                turns, tokens, chars = turns + 1, tokens + len(ids), chars + len(shown)
            yield pa.record_batch(
                [
                    batch.column("conv"), pa.array(out["segment"], pa.int64()), pa.array(out["formatted"], pa.string()),
                    pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["loss_mask"], pa.list_(pa.bool_())),
                    pa.array(out["token_offset"], pa.int64()), pa.array(out["char_offset"], pa.int64()),
                ],
                names=names,
            )

    return run


def format_chats(
    turns: DataFrame, template: Template | None = None, trained: tuple[str, ...] = ("assistant",),
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    r"""One row per turn in its conversation's order: id, ``segment`` (from 0), ``formatted``, ``ids``, ``loss_mask``,
    ``token_offset``, ``char_offset``.

    A conversation is its segments on end; they stay rows, so its length is not bounded by memory. A segment is
    ``### role:\n text </turn>\n``. In ``ids`` the control strings are reserved ids, and the mask, prefix sums
    over the edges of what is trained on, covers the texts of the trained roles alone. Control strings inside roles
    and texts are broken by a backslash, and each backslash there is doubled, so both directions are exact.

    Null roles and texts are empty. Null ids are one conversation. Rows go by turn (null first); equal turns by role and
    text. Repeated rows are turns of their own. Other columns are not read. An empty table gives an empty table.
    """
    spark = turns.sparkSession
    Scratch(spark, "chat")
    template = template or Template()
    rows = turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    long = T.LongType()
    schema = T.StructType([
        T.StructField("conv", rows.schema["conv"].dataType), T.StructField("segment", long),
        T.StructField("formatted", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())), T.StructField("token_offset", long),
        T.StructField("char_offset", long),
    ])
    return (
        rows.repartition(task_count(spark), "conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .mapInArrow(_segments(template, trained, schema.names), schema)
        .withColumnRenamed("conv", id_col)
    )


def _read(template: Template, path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, colon, end = template.reserved
        decode = tokenizer(path).decode

        def text_of(ids: np.ndarray) -> str:
            return template.unescape(decode(ids.tolist(), skip_special_tokens=False))

        done: list[list] = []
        state: list | None = None
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, formatted, ids, mask in zip(
                *(batch.column(c) for c in ("conv", "formatted", "ids", "loss_mask")), strict=True
            ):
                conv = conv.as_py()
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = (x.values.to_numpy(zero_copy_only=False) for x in (ids, mask))
                middle = int(np.flatnonzero(ids == colon)[0])
                if ids[0] != begin or ids[-1] != end:
                    raise ValueError("a segment lacks its reserved ids")
                role, text = text_of(ids[1:middle]), text_of(ids[middle + 1 : -1])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if mask.any():
                    learned = text_of(ids[mask])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(formatted.as_py())
            if done:
                yield _digests(done, kind, names)
                done = []
        if state is not None:
            done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])
            yield _digests(done, kind, names)

    return run


def _digests(rows: list[list], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(segments: DataFrame, template: Template | None = None, id_col: str = "conv_id", path: str | None = None) -> DataFrame:
    """One row per conversation, decoded from the ids of ``format_chats``: counts and digests of turns and loss text.

    Segments are read in order and digested one by one; no conversation is held as a whole.
    """
    spark = segments.sparkSession
    template = template or Template()
    rows = segments.withColumnRenamed(id_col, "conv").select("conv", "segment", "formatted", "ids", "loss_mask")
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([
        T.StructField("conv", rows.schema["conv"].dataType), T.StructField("n_turns", long),
        T.StructField("turns_sha256", text), T.StructField("loss_chars", long), T.StructField("loss_sha256", text),
        T.StructField("formatted_chars", long),
    ])
    return (
        rows.repartition(task_count(spark), "conv")
        .sortWithinPartitions("conv", "segment")
        .mapInArrow(_read(template, path or public_tokenizers.path(VOCABULARY), schema.names), schema)
        .withColumnRenamed("conv", id_col)
    )
