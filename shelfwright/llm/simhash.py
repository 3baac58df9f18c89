"""SimHash near-duplicates by a pigeonhole over correlated bit groups with unequal thresholds."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.components import components, local_roots
from shelfwright.llm.groups import whole_groups
from shelfwright.llm.scratch import Scratch, task_count, tidied

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 64
#: Rows of one tile side; larger buckets are cut into tiles.
TILE = 1024
#: A generated row costs about as much as this many compared pairs.
ROW_COST = 200


def fingerprint(text: bytes, words: int = 4) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles, repeats included; 0 without words."""
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, last, 1 << 16):
        hashes = np.array(
            [digest(b" ".join(found[i : i + words]), 42) for i in range(start, min(last, start + (1 << 16)))],
            dtype="<u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > last)))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            prints = [fingerprint(t.as_py() or b"", words) for t in texts]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=[*batch.schema.names[:-1], "fp"],
            )

    return run


def fingerprints(docs: DataFrame, text_col: str, *keep: Column, words: int = 4) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long; a null text has no words."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("simhash_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(tidied(_fingerprints(words)), ", ".join([*fields, "fp long"]))


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each two bits are set together (the diagonal: how often one is set)."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        bits = np.unpackbits(prints.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
        total += bits.T @ bits
    yield pa.record_batch({"cell": np.arange(BITS * BITS), "n": total.ravel().astype(np.int64)})


@dataclass(frozen=True)
class Part:
    """A group of bits, and how many of them may differ in a candidate pair (-1: it fetches none)."""

    bits: tuple[int, ...]
    allowed: int

    def masks(self) -> list[tuple[int, ...]]:
        """The bits kept in each key: all sets that leave ``allowed`` bits out."""
        if self.allowed < 0:
            return []
        return [tuple(b for b in self.bits if b not in out) for out in itertools.combinations(self.bits, self.allowed)]


def group_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits dealt into groups of (nearly) equal size, each grown by the bit that correlates most with it."""
    free, groups = set(range(BITS)), []
    for k in range(parts):
        room = (BITS - sum(map(len, groups))) // (parts - k)
        rest = sorted(free)
        weight = correlation[np.ix_(rest, rest)].sum(axis=1)
        group = [rest[int(np.argmax(weight))]]
        free.remove(group[0])
        while len(group) < room:
            rest = sorted(free)
            group.append(rest[int(np.argmax(correlation[np.ix_(rest, group)].sum(axis=1)))])
            free.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 of least total cost with sum(t_i + 1) = distance + 1; ``costs[i][t]`` is for t >= 0.

    If every group differed in more than its threshold, a pair would differ in at least sum(t_i + 1) bits, so each
    pair within the distance is within the threshold of some group.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        following: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in enumerate([0.0, *row]):
                now = used + t
                if now <= distance + 1 and (now not in following or cost + more < following[now][0]):
                    following[now] = (cost + more, (*chosen, t - 1))
        best = following
    return list(best[distance + 1][1])


def _key(bits: tuple[int, ...], fp: Column) -> Column:
    """The chosen bits next to each other, as a whole number."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long"))


def plan(prints: DataFrame, distance: int) -> list[Part]:
    """The parts to probe: for several numbers of groups, thresholds by dynamic programming; the cheapest wins.

    Candidates are estimated from all fingerprints: the pairs that agree in a whole group are counted from its
    key counts, and those that differ in one or two of its bits follow from how often each bit differs. Only
    the bit counts (64 x 64) and one number per group come to the driver.
    """
    cells = prints.select("fp").mapInArrow(_bit_sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    together = np.zeros(BITS * BITS)
    for cell, n in cells.collect():
        together[cell] = n
    together = together.reshape(BITS, BITS)
    total = max(1.0, float(prints.count()))
    share = np.diag(together) / total
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs(together / total - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    differ = 2 * share * (1 - share)
    odds = differ / np.maximum(1 - differ, 1e-9)
    layouts = {m: group_bits(correlation, m) for m in range(2, distance + 2)}
    groups = [(m, i, g) for m, gs in layouts.items() for i, g in enumerate(gs)]
    keyed = prints.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("n"), _key(g, F.col("fp")).alias("key")) for n, (_, _, g) in enumerate(groups)])
        ).alias("x")
    ).select("x.n", "x.key")
    agree = {
        n: float(pairs or 0)
        for n, pairs in keyed.groupBy("n", "key").agg(F.count("*").cast("double").alias("c"))
        .groupBy("n").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect()
    }
    best: tuple[float, list[Part]] | None = None
    for m, gs in layouts.items():
        costs = []
        for i, g in enumerate(gs):
            base = agree.get(groups.index((m, i, g)), 0.0)
            o = odds[list(g)]
            one, two = o.sum(), (o.sum() ** 2 - (o**2).sum()) / 2
            fetched = [base, base * (len(g) + one), base * (len(g) * (len(g) - 1) / 2 + (len(g) - 1) * one + two)]
            rows = [1, len(g), len(g) * (len(g) - 1) / 2]
            costs.append([f + ROW_COST * total * r for f, r in zip(fetched, rows, strict=True)])
        if sum(len(c) for c in costs) < distance + 1:
            continue
        chosen = allocate(costs, distance)
        cost = sum(c[t] for c, t in zip(costs, chosen, strict=True) if t >= 0)
        if best is None or cost < best[0]:
            best = (cost, [Part(g, t) for g, t in zip(gs, chosen, strict=True)])
    return best[1]


def _near(distance: int):
    """Star edges between fingerprints of one tile that differ in at most ``distance`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["mask", "bucket", "tile_a", "tile_b"]
        for batch, bounds in whole_groups(batches, keys, 1 << 15):
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            prints = signed.view(np.uint64)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            starts = np.array([s for s, _ in bounds])
            sizes = np.array([e - s for s, e in bounds])
            left, right = [], []
            small = sizes <= 64
            end = np.repeat(np.where(small, starts + sizes, 0), sizes)
            at = np.arange(len(prints))
            step = 1
            while len(at := at[at + step < end[at]]):
                hit = np.bitwise_count(prints[at] ^ prints[at + step]) <= distance
                left.append(at[hit])
                right.append(at[hit] + step)
                step += 1
            for s, e in (b for b, few in zip(bounds, small, strict=True) if not few):
                first = s + np.flatnonzero(part[s:e] == batch.column("tile_a")[s].as_py())
                second = s + np.flatnonzero(part[s:e] == batch.column("tile_b")[s].as_py())
                for k in range(0, len(first), 256):
                    some = first[k : k + 256]
                    i, j = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[second][None, :]) <= distance)
                    # pairs within one block reduce to its roots before the next is compared
                    roots = local_roots(len(some) + len(second), i, len(some) + j)
                    node = np.concatenate([some, second])
                    moved = roots != np.arange(len(roots))
                    left.append(node[roots[moved]])
                    right.append(node[moved])
            a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
            b = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
            if not len(a):
                continue
            values, place = np.unique(signed, return_inverse=True)
            root = local_roots(len(values), place[a], place[b])
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.record_batch({"u": values[moved], "v": values[root[moved]]})

    return run


def link(prints: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (distinct longs ``fp``) within the distance of each other."""
    parts = plan(prints, distance)
    masks = [kept for p in parts for kept in p.masks()]
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("mask"), _key(kept, F.col("fp")).alias("bucket")) for n, kept in enumerate(masks)])
        ).alias("x"),
    ).select("fp", "x.mask", "x.bucket")
    sizes = scratch.save(
        keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
        .select("mask", "bucket", F.ceil(F.col("n") / TILE).cast("int").alias("parts")),
        "sizes",
    )
    dealt = (
        keyed.join(sizes, ["mask", "bucket"])
        .withColumn("part", F.pmod(F.hash("fp"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "mask", "bucket", "part", "fp",
            F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"),
        )
    )
    keys = ["mask", "bucket", "tile_a", "tile_b"]
    return (
        dealt.repartition(task_count(prints.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(tidied(_near(distance)), "u long, v long")
    )


def _groups(rows: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(fp, root) of all fingerprints in rows (fp, ...)."""
    nodes = scratch.save(rows.select("fp").distinct(), "nodes")
    roots = components(link(nodes, distance, scratch), scratch).withColumnRenamed("node", "fp")
    return scratch.save(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def representatives(
    docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of ``near_texts``, with all its columns: the one with the smallest id, null ids last.

    Equal ids go by their place in the input, which is a stored table, so each row has one place in every scan.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    placed = docs.withColumn("llm_place", F.monotonically_increasing_id())
    rows = scratch.save(
        fingerprints(placed, text_col, F.col(id_col).alias("id"), F.col("llm_place").alias("place"), words=words), "prints"
    )
    grouped = _groups(rows, distance, scratch)
    firsts = scratch.save(
        rows.join(grouped, "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"))
        .select(F.col("first.place").alias("llm_place")),
        "firsts",
    )
    return placed.join(firsts, "llm_place", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def near_texts(
    docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Equal fingerprints become one node first, so copies cost nothing beyond their fingerprint. Each group of
    bits gives keys that leave its allowed number of bits out; nodes that share a key are compared. Buckets of
    over 1,024 nodes are cut into tiles, and a tile returns a spanning star, not its pairs.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an id are rows of
    their own; a component's id is the smallest of its ids, null if all are null. An empty table gives an
    empty table; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, text_col, F.col(id_col).alias("id"), words=words), "prints")
    grouped = _groups(rows, distance, scratch)
    # stored, so that a frequent root or fingerprint is split in the joins
    least = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("least")), "least")
    rooted = scratch.save(grouped.join(least, "fp"), "least-rooted")
    smallest = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    by_print = scratch.save(rooted.join(smallest, "root").select("fp", "component_id"), "by-print")
    return rows.join(by_print, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
