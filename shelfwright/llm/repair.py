"""Repair of conversation structure by cheapest edits, with square-root checkpointed dynamic programming.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials. A row may be kept (K), given another role (R), or
deleted (D), and rows may be inserted (I). States are what the output ends with: nothing, s, u or a.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm.scratch import Scratch, task_count

#: Rows of a conversation that one task walks at once: a conversation of 2**32 rows has as many segments as a segment has rows.
SEGMENT_BITS = 16
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of each initial, per state; None where the initial may not follow.
AFTER = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
    "": (None, None, None, None),
}
INSERTED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
#: A row's kind: its initial's place here, plus 4 if truncated, 8 if blank, 16 if a repeat.
INITIALS = ("s", "u", "a", "")
TRUNCATED, BLANK, REPEAT = 4, 8, 16
WHITE = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=1 << 16)
def before(kind: int, behind: tuple) -> tuple:
    """The cheapest cost from each state in front of a row, by those behind it; insertions in front of the row included."""
    costs = []
    extra = CUT if kind & TRUNCATED else 0
    for state in range(4):
        best = DELETE + behind[state]
        if not kind & (BLANK | REPEAT):
            kept = AFTER[INITIALS[kind & 3]][state]
            if kept is not None:
                best = min(best, extra + behind[kept])
            for initial in "ua":
                changed = AFTER[initial][state]
                if changed is not None:
                    best = min(best, RENAME + extra + behind[changed])
        costs.append(best)
    for _ in range(2):
        for state in range(4):
            costs[state] = min(costs[state], INSERT + costs[INSERTED[state]])
    return tuple(min(c, NEVER) for c in costs)


def backward(kinds: bytes, end: tuple) -> tuple:
    """The costs in front of all rows."""
    costs = end
    for kind in reversed(kinds):
        costs = before(kind, costs)
    return costs


def transfer(kinds: bytes) -> list[int]:
    """The cheapest cost from each state in front of the rows to each state behind them, row by row."""
    columns = [backward(kinds, tuple(0 if s == t else NEVER for s in range(4))) for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(kinds: bytes, state: int, end: tuple, last: bool) -> tuple[list[tuple[int, str, int]], int]:
    """The ASCII-least cheapest edits as (row, edit, state behind it), and the state reached.

    Costs are stored at every ``isqrt(n)``-th row only; the block that the walk enters has its own made again. With ``last``
    the rows end the conversation, so insertions behind them belong to the walk.
    """
    n = len(kinds)
    step = max(1, isqrt(n))
    checkpoints = {}
    costs = end
    for i in range(n - 1, -1, -1):
        costs = before(kinds[i], costs)
        if i % step == 0:
            checkpoints[i] = costs
    edits = []
    for start in range(0, n, step):
        stop = min(start + step, n)
        block = [checkpoints.get(stop, end)]
        for i in range(stop - 1, start - 1, -1):
            block.append(before(kinds[i], block[-1]))
        block.reverse()
        i = start
        while i < stop:
            kind, here, behind = kinds[i], block[i - start], block[i - start + 1]
            cost, extra = here[state], CUT if kind & TRUNCATED else 0
            open_row = not kind & (BLANK | REPEAT)
            kept = AFTER[INITIALS[kind & 3]][state]
            if DELETE + behind[state] == cost:
                edits.append((i, "D", state))
            elif INSERT + here[INSERTED[state]] == cost:
                state = INSERTED[state]
                edits.append((i, "I", state))
                continue
            elif open_row and kept is not None and extra + behind[kept] == cost:
                state = kept
                edits.append((i, "K", state))
            else:
                state = next(
                    t for t in (AFTER[x][state] for x in "ua") if t is not None and RENAME + extra + behind[t] == cost
                )
                edits.append((i, "R", state))
            i += 1
    while last and END[state]:
        state = INSERTED[state]
        edits.append((max(n - 1, 0), "I", state))
    return edits, state


def faults(kinds: bytes) -> list[int]:
    """Blank, repeated, truncated (each row's first fault counts), and neighbours that may not follow one another."""
    roles = [k & 3 for k in kinds]
    return [
        sum(1 for k in kinds if k & BLANK),
        sum(1 for k in kinds if k & REPEAT and not k & BLANK),
        sum(1 for k in kinds if k & TRUNCATED and not k & (BLANK | REPEAT)),
        sum(unsound(a, b) for a, b in zip(roles, roles[1:], strict=False)),
    ]


def unsound(first: int, second: int) -> bool:
    return (INITIALS[first] + INITIALS[second]) not in ("su", "ua", "au")


def _kinds(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[int]]]:
    """(kinds, positions) of each segment: entries of kind -1 mark the rows that no earlier row equals."""
    for entries in batch.column("entries"):
        fields = entries.values
        positions, codes = fields.field("pos").to_pylist(), fields.field("kind").to_pylist()
        first = {p for p, c in zip(positions, codes, strict=True) if c < 0}
        rows = [(p, c) for p, c in zip(positions, codes, strict=True) if c >= 0]
        yield bytes(c if p in first else c | REPEAT for p, c in rows), [p for p, _ in rows]


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [transfer(kinds) for kinds, _ in _kinds(batch)]
        yield pa.record_batch(
            [batch.column("conv"), batch.column("seg"), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "seg", "costs"]
        )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind every segment of a conversation, from its last one on."""
    for batch in batches:
        rows, segs, ends = [], [], []
        for i, parts in enumerate(batch.column("parts").to_pylist()):
            costs = END
            for part in reversed(parts):
                rows.append(i)
                segs.append(part["seg"])
                ends.append(list(costs))
                m = part["costs"]
                costs = tuple(min(min(m[4 * s + t] + costs[t] for t in range(4)), NEVER) for s in range(4))
        yield pa.record_batch(
            [batch.column("conv").take(pa.array(rows, pa.int64())), pa.array(segs, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
            names=["conv", "seg", "behind"],
        )


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a segment for each state in front of it."""
    for batch in batches:
        exits = [
            [walk(kinds, state, tuple(end), False)[1] for state in range(4)]
            for (kinds, _), end in zip(_kinds(batch), batch.column("behind").to_pylist(), strict=True)
        ]
        yield pa.record_batch(
            [batch.column("conv"), batch.column("seg"), batch.column("behind"), pa.array(exits, pa.list_(pa.int32()))],
            names=["conv", "seg", "behind", "exits"],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of every segment of a conversation, from its first one on."""
    for batch in batches:
        rows, segs, ends, states, last = [], [], [], [], []
        for i, parts in enumerate(batch.column("parts").to_pylist()):
            state = START
            for j, part in enumerate(parts):
                rows.append(i)
                segs.append(part["seg"])
                ends.append(part["behind"])
                states.append(state)
                last.append(j == len(parts) - 1)
                state = part["exits"][state]
        yield pa.record_batch(
            [
                batch.column("conv").take(pa.array(rows, pa.int64())), pa.array(segs, pa.int64()),
                pa.array(ends, pa.list_(pa.int64())), pa.array(states, pa.int32()), pa.array(last, pa.bool_()),
            ],
            names=["conv", "seg", "behind", "entry", "last"],
        )


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "seg", "faults", "ends", "cost", "audit", "pos", "role"]
    for batch in batches:
        out = {name: [] for name in names[2:]}
        given = zip(*(batch.column(c).to_pylist() for c in ("entry", "behind", "last")), strict=True)
        for (kinds, positions), (entry, behind, last) in zip(_kinds(batch), given, strict=True):
            end = END if behind is None else tuple(behind)
            edits, _ = walk(kinds, entry or START, end, last is not False)
            cost = 0
            for row, edit, _ in edits:
                cost += {"D": DELETE, "I": INSERT, "K": 0, "R": RENAME}[edit]
                cost += CUT if edit in "KR" and kinds[row] & TRUNCATED else 0
            out["faults"].append(faults(kinds))
            out["ends"].append([kinds[0] & 3, kinds[-1] & 3])
            out["cost"].append(cost)
            out["audit"].append("".join(e for _, e, _ in edits))
            out["pos"].append([positions[row] for row, _, _ in edits])
            out["role"].append([ROLES[s] if e in "IR" else None for _, e, s in edits])
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        yield pa.record_batch(
            [batch.column("conv"), batch.column("seg"), *(pa.array(out[n], k) for n, k in zip(names[2:], kinds, strict=True))],
            names=names,
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation of rows in order; a conversation is never held."""
    done: list[tuple] = []
    current, kind, open_ = None, None, False

    def out() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv", "repaired_sha256"]
        )

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, role, text in zip(
            batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text"), strict=True
        ):
            if not open_ or conv != current:
                if open_:
                    done.append((current, digest.hexdigest()))
                current, open_, digest = conv, True, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text.as_py()}".encode())
        if done:
            yield out()
            done = []
    if open_:
        done.append((current, digest.hexdigest()))
        yield out()


def _with(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


@dataclass
class Repair:
    """The cheapest edits of every conversation.

    Rows are sorted once over all tasks, whatever a conversation's share of them, and stored with their place. A row is a repeat
    if its place is not the smallest of its id, role and text. A conversation is walked in segments of ``2**SEGMENT_BITS``
    places: segments give their cost transfers, a fold over these gives the costs behind each segment, and a second
    fold the state in front of it; then all segments are walked side by side, each with checkpoints at square-root distance.

    Null roles and texts are one blank. Rows go by turn (null first); equal turns by role, then by the text's SHA-256.
    Null ids are one conversation. Repeated rows are rows of their own (and faults). Texts may be of any length. Other columns
    are not read. An empty table gives empty tables.
    """

    turns: DataFrame
    id_col: str = "conv_id"
    turn_col: str = "turn"
    role_col: str = "role"
    text_col: str = "text"

    def __post_init__(self):
        self.scratch = Scratch(self.turns.sparkSession, "repair")

    def _named(self, conv: str | Column = "conv") -> Column:
        return (F.col(conv) if isinstance(conv, str) else conv).alias(self.id_col)

    @cached_property
    def rows(self) -> DataFrame:
        """All rows in order: ``pos`` rises with conversation and turn; ``kind`` holds initial, blank and truncated."""
        def given(column: str) -> Column:
            return F.coalesce(F.col(column).cast("string"), F.lit(" "))

        ended = F.rtrim(F.col("text"), F.lit(WHITE))
        initial = F.substring("role", 1, 1)
        kind = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in INITIALS[:3]]), initial) - 1, F.lit(3))
        kind = F.when(kind < 0, 3).otherwise(kind)
        blank = F.when(ended == "", BLANK).otherwise(0)
        truncated = F.when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
        named = self.turns.select(
            F.col(self.id_col).alias("conv"), F.col(self.turn_col).alias("turn"), given(self.role_col).alias("role"),
            given(self.text_col).alias("text"),
        )
        coded = named.withColumns({
            "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "kind": (kind + blank + truncated).cast("int"),
            "tie": F.monotonically_increasing_id(),
        })
        order = ["conv", "turn", "role", "digest", "tie"]
        placed = coded.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
        return self.scratch.save(placed.withColumn("pos", F.monotonically_increasing_id()), "rows")

    @cached_property
    def segments(self) -> DataFrame:
        seg = F.shiftright("pos", SEGMENT_BITS).alias("seg")
        firsts = self.rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos"))
        entries = self.rows.select("conv", seg, "pos", "kind").unionAll(
            firsts.select("conv", seg, "pos", F.lit(-1).alias("kind"))
        )
        return self.scratch.save(
            entries.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("entries")),
            "segments",
        )

    def _by_conversation(self, parts: DataFrame, *columns: str) -> DataFrame:
        """One row a conversation, with one entry for each of its segments in order."""
        return parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", *columns))).alias("parts"))

    @cached_property
    def edits(self) -> DataFrame:
        """One row a segment: faults, cost, the edits' initials and, for each, its row's place and new role."""
        conv = T.StructType([T.StructField("conv", self.rows.schema["conv"].dataType)])
        # Only conversations that reach over the end of a segment need states from outside it.
        several = self.segments.groupBy("conv").agg(F.count("seg").alias("n")).where("n > 1").select(F.col("conv").alias("c"))
        split = self.scratch.save(self.segments.join(several, F.col("conv").eqNullSafe(F.col("c"))).drop("c"), "split")
        ends = self._by_conversation(
            split.mapInArrow(_transfers, _with(conv, "seg long, costs array<long>")), "costs"
        ).mapInArrow(_ends, _with(conv, "seg long, behind array<long>"))
        exits = split.join(self._other(ends), self._same()).drop("c", "s").mapInArrow(
            _exits, _with(conv, "seg long, behind array<long>, exits array<int>")
        )
        states = self.scratch.save(
            self._by_conversation(exits, "behind", "exits").mapInArrow(
                _entries, _with(conv, "seg long, behind array<long>, entry int, last boolean")
            ),
            "states",
        )
        whole = self.segments.join(self._other(states), self._same(), "left").drop("c", "s")
        return self.scratch.save(
            whole.mapInArrow(
                _edits,
                _with(conv, "seg long, faults array<long>, ends array<int>, cost long, audit string, pos array<long>, role array<string>"),
            ),
            "edits",
        )

    def _other(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("conv", "c").withColumnRenamed("seg", "s")

    def _same(self) -> Column:
        return F.col("conv").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))

    def steps(self) -> DataFrame:
        """One row an edit, in the order of (``pos``, ``step``): id, edit, and the role and text it leaves (null if deleted)."""
        each = self.edits.select("conv", "seg", "audit", F.posexplode(F.arrays_zip("pos", "role")).alias("step", "x")).select(
            "conv", "step", F.expr("substring(audit, step + 1, 1)").alias("edit"), F.col("x.pos").alias("pos"),
            F.col("x.role").alias("new_role"),
        )
        old = self.rows.select("pos", "role", "text")
        kept = each.where("edit <> 'I'").join(old, "pos").select(
            "conv", "pos", "step", "edit", F.when(F.col("edit") != "D", F.coalesce("new_role", "role")).alias("role"),
            F.when(F.col("edit") != "D", F.col("text")).alias("text"),
        )
        made = each.where("edit = 'I'").select("conv", "pos", "step", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
        return kept.unionByName(made).withColumnRenamed("conv", self.id_col)

    def repaired(self) -> DataFrame:
        """The rows of the repaired conversations: id, ``pos`` and ``step`` (their order), edit, role, text."""
        return self.steps().where("edit <> 'D'")

    def digests(self) -> DataFrame:
        """(id, ``repaired_sha256``): one digest a conversation over its repaired ``role:text``, joined by line ends.

        A digest reads its rows one after another, so a conversation's repaired rows pass through one task, one batch at a time.
        """
        rows = self.repaired().withColumnRenamed(self.id_col, "conv").select("conv", "pos", "step", "role", "text")
        schema = _with(T.StructType([rows.schema["conv"]]), "repaired_sha256 string")
        ordered = rows.repartition(task_count(rows.sparkSession), "conv").sortWithinPartitions("conv", "pos", "step")
        return ordered.mapInArrow(_digests, schema).withColumnRenamed("conv", self.id_col)

    def summary(self) -> DataFrame:
        """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
        turns = self.rows.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
        )
        parts = self.edits.groupBy("conv").agg(
            *[F.sum(F.col("faults")[i]).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "inner"))],
            F.sum("cost").alias("cost"),
            F.array_sort(F.collect_list(F.struct("seg", "audit", "ends"))).alias("x"),
        )
        # Neighbours on both sides of a segment's end.
        sound = F.array(*[F.lit(a * 4 + b) for a in range(4) for b in range(4) if not unsound(a, b)])
        across = F.aggregate(
            F.col("x"), F.struct(F.lit(-1).alias("role"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(
                p["ends"][1].alias("role"),
                (acc["n"] + F.when((acc["role"] >= 0) & ~F.array_contains(sound, acc["role"] * 4 + p["ends"][0]), 1).otherwise(0))
                .cast("long").alias("n"),
            ),
        )["n"]
        both = parts.select(
            F.col("conv").alias("c"), "blank", "duplicate", "truncated", (F.col("inner") + across).alias("illegal"), "cost",
            F.array_join(F.col("x.audit"), "").alias("audit"),
        )
        return turns.join(both, F.col("conv").eqNullSafe(F.col("c"))).select(
            self._named(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
        )


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults for trials, by ``crc32("id:turn") % 20`` (nulls as one blank): 0 drops the row, 1 empties its text,
    2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's. Other columns stay as they are.
    """
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col, role_col, text_col))
    case = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    changed = {
        role_col: F.when(case == 4, "user").otherwise(role),
        text_col: F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text),
    }
    row = F.struct(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in turns.columns])
    times = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return turns.select(F.explode(F.array_repeat(row, times)).alias("row")).select("row.*")
