"""Near-duplicate texts by the exact similarity of their sets of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm import windows as W
from shelfwright.llm.components import components, local_roots
from shelfwright.llm.groups import whole_groups
from shelfwright.llm.scratch import Scratch, task_count, tidied
from shelfwright.llm.substrings import word_units

#: Shingles of one tile side; larger buckets are cut into tiles.
TILE = 1 << 18
#: Shingles of all sets that one round may ship, as a multiple.
ROUND = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def least_common(n):
    """What a set of ``n`` shares at least with any set of a similarity of 0.8 or more."""
    return (4 * n + 4) // 5


def _extra(n: int) -> int:
    """How many more of its smallest shingles a set of ``n`` shows than one common shingle needs."""
    return max(1, n // 16)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text, the sorted identifiers of its shingles; a shorter text is one shingle, one without words none."""
    data, offsets = W.raw(texts)
    edges, (units,) = word_units(_LOWER[data], offsets, 0)
    sums = W.prefix(units)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        start = np.arange(low, max(low + 1, high - words + 1) if high > low else low)
        yield np.unique(W.ids_of(sums, start, np.minimum(start + words, high)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    stops = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(flat.view(np.int64)))


def _sketches(words: int, names: list[str]):
    """Size, a digest of the set, and the smallest shingles; see ``near_places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, firsts = [], [], []
            for mine in shingle_sets(batch.column("text"), words):
                n = len(mine)
                sizes.append(n)
                digests.append(hashlib.blake2b(mine.tobytes(), digest_size=16).digest())
                firsts.append(mine[: n - least_common(n) + _extra(n)] if n else mine)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(firsts)], names=names
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [batch.column("node"), _lists(list(shingle_sets(batch.column("text"), words)))], names=["node", "shingles"]
            )

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by node, count and shingle: each node's shared shingles, the rarest first; the count 0 marks its size.

    Nodes that share less than a partner needs are left out.
    """
    for batch, bounds in whole_groups(batches, ["node"], 1 << 16):
        node, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "h"))
        kept = [(s, e) for s, e in bounds if e - s > 1 and e - s - 1 >= least_common(h[s])]
        heads = [s for s, _ in kept]
        lists = _lists([h[s + 1 : e] for s, e in kept])
        yield pa.record_batch({"node": node[heads], "n": h[heads], "shingles": lists})


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges between the nodes of one tile whose sets have a similarity of 0.8 or more.

    ``n`` is the size of a set; its list need not name shingles that no other set has. Nodes of one root are connected
    already, and come one after the other.
    """
    for batch, bounds in whole_groups(batches, ["bucket", "tile_a", "tile_b"], 256):
        node, part, whole, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "part", "n", "root"))
        lists = batch.column("shingles")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        stops = np.cumsum(sizes)
        for s, e in bounds:
            tile_a, tile_b = batch.column("tile_a")[s].as_py(), batch.column("tile_b")[s].as_py()
            names, ids = np.unique(flat[stops[s] - sizes[s] : stops[e - 1]], return_inverse=True)
            size, mine, n = sizes[s:e], part[s:e], whole[s:e]
            begin = np.cumsum(size) - size
            after = np.searchsorted(known[s:e], known[s:e], "right")
            left, right = [], []
            for i in range(e - s):
                # those of the first tile meet all that follow their root, or all of the second tile
                first = after[i] if tile_a == tile_b else 0
                if mine[i] != tile_a or first == e - s:
                    continue
                marked = np.zeros(len(names), dtype=bool)
                marked[ids[begin[i] : begin[i] + size[i]]] = True
                common = np.add.reduceat(marked[ids[begin[first] :]], begin[first:] - begin[first], dtype=np.int64)
                hit = 5 * common >= 4 * (n[i] + n[first:] - common)
                if tile_a != tile_b:
                    hit &= mine == tile_b
                j = first + np.flatnonzero(hit)
                left.append(np.full(len(j), i))
                right.append(j)
            if left:
                root = local_roots(e - s, np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(root != np.arange(e - s))
                yield pa.record_batch({"u": node[s:e][moved], "v": node[s:e][root[moved]]})


def _compare(dealt: DataFrame, shared: DataFrame) -> DataFrame:
    """Star edges (u, v) of the nodes dealt (h, node, root) to one bucket; large buckets are cut into tiles."""
    sizes = shared.select("node", F.size("shingles").alias("size"))
    buckets = dealt.join(sizes, "node").groupBy("h").agg(F.ceil(F.sum("size") / TILE).cast("int").alias("parts"))
    keys = ["bucket", "tile_a", "tile_b"]
    return (
        dealt.join(buckets, "h")
        .withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.col("h").alias("bucket"), "part", "node", "root",
            F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"),
        )
        .join(shared, "node")
        .repartition(task_count(dealt.sparkSession), *keys)
        .sortWithinPartitions(*keys, "root")
        .mapInArrow(tidied(_similar), "u long, v long")
    )


def link(nodes: DataFrame, texts: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect all nodes of a similarity of 0.8 or more; nodes (node, n, firsts), texts (node, text).

    Sets of that similarity share four fifths of either. Of ``n`` shingles in any fixed order, the first
    ``n - least_common(n) + m`` of both sets then hold the first m they share. Once by hash, with several such
    shingles asked for, which leaves few nodes; of these again from the rarest on, with m = 1, for buckets.

    Sets travel without the shingles that no other set has. First a node meets those of its largest bucket only. A bucket
    whose nodes are all connected by then has nothing to add. Others are compared whole, those of the same roots as one, in as
    many rounds as keep what a round ships to ``ROUND`` times all sets.
    """
    shown = nodes.select("node", F.explode("firsts").alias("h"))
    often = scratch.save(shown.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "often")
    least = F.expr("greatest(1L, ((4 * n + 4) div 5) div 16)")  # a partner may be the smaller one
    left = scratch.save(
        shown.join(often, "h", "left_semi").groupBy("node").agg(F.count("*").alias("c"))
        .join(nodes.select("node", "n"), "node").where(F.col("c") >= least).select("node"),
        "left",
    )
    scratch.drop(nodes, often)
    sets = scratch.save(
        texts.join(left, "node", "left_semi").mapInArrow(tidied(_sets(words)), "node long, shingles array<long>"), "sets"
    )
    each = sets.select("node", F.explode("shingles").alias("h"))
    counts = scratch.save(each.groupBy("h").agg(F.count("*").cast("int").alias("c")).where("c > 1"), "counts")
    # shingles of one set alone come first in its order, and lead to no other
    sizes = sets.select("node", F.size("shingles").cast("long").alias("h"), F.lit(0).alias("c"))
    shared = scratch.save(
        each.join(counts, "h").select("node", "h", "c").unionByName(sizes)
        .repartition("node").sortWithinPartitions("node", "c", "h")
        .mapInArrow(tidied(_ranked), "node long, n long, shingles array<long>"),
        "shared",
    )
    scratch.drop(sets, counts)
    shown = F.size("shingles") - F.expr("(4 * n + 4) div 5").cast("int") + 1
    kept = scratch.save(
        shared.select("node", "n", F.explode(F.slice("shingles", F.lit(1), shown)).alias("h")), "firsts"
    )
    # buckets of the same nodes are one
    buckets = scratch.save(
        kept.groupBy("h")
        .agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
        .where("c > 1")
        .groupBy("c", "total", "all").agg(F.min("h").alias("h"))
        .select("h", "c"),
        "buckets",
    )
    dealt = scratch.save(kept.join(buckets, "h").select("h", "node", "c"), "dealt")
    scratch.drop(kept, buckets)
    largest = dealt.groupBy("node").agg(F.max(F.struct("c", "h")).alias("most"))
    near = scratch.save(_compare(largest.select("most.h", "node", F.col("node").alias("root")), shared), "near")
    known = scratch.save(components(near, scratch), "known")
    rooted = scratch.save(dealt.join(known, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root")), "rooted")
    scratch.drop(dealt, near)
    mixed = (
        rooted.select("h", "root").distinct()
        .groupBy("h").agg(F.count("*").alias("c"), F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("all"))
        .where("c > 1")
        .select("h", F.xxhash64("c", "all").alias("same"))
    )
    rest = scratch.save(rooted.join(mixed, "h").select(F.col("same").alias("h"), "node", "root").distinct(), "rest")
    scratch.drop(rooted)
    shipped = rest.join(shared, "node").agg(F.sum(F.size("shingles"))).first()[0] or 0
    whole = shared.agg(F.sum(F.size("shingles"))).first()[0] or 1
    rounds = int(-(-shipped // (ROUND * whole)))
    found = known.select(F.col("node").alias("u"), F.col("root").alias("v"))
    for turn in range(rounds):
        dealt = rest.where(F.pmod(F.xxhash64("h"), F.lit(rounds)) == turn)
        found = found.unionByName(scratch.save(_compare(dealt, shared), "found"))
    return found


def _between_nodes(near: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between the nodes of rows (place) and of the row that names their group (component_id)."""
    named = scratch.save(
        near.where("place <> component_id").select("place", "component_id")
        .join(members, "place").select(F.col("node").alias("u"), F.col("component_id").alias("place")).distinct(),
        "named",
    )
    return scratch.save(
        named.join(members.select("place", F.col("node").alias("v")), "place").where("u <> v").select("u", "v").distinct(),
        "near-nodes",
    )


def representatives(
    docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text",
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row of each group of near-duplicate texts, with all its columns: the one with the smallest id, null ids last.

    Texts whose sets of word shingles (ASCII letters in lower case) have a Jaccard similarity of 0.8 or more are linked,
    all of them; groups are the connected texts. Texts without words are alike. Equal ids go by their place in
    the input, which is a stored table, so each row has one place in every scan.

    ``near`` may link more: it gets the rows (place, text) and returns each ``place`` with its ``component_id``, the
    place that names its group.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("text")
    rows = placed.select("place", F.col(f"row.`{id_col}`").alias("id"), text)
    names = ["place", "id", "n", "digest", "firsts"]
    kind = rows.schema["id"].dataType.simpleString()
    sketches = scratch.save(
        rows.mapInArrow(tidied(_sketches(words, names)), f"place long, id {kind}, n long, digest binary, firsts array<long>"), "sketches"
    )
    of_set = scratch.save(sketches.groupBy("digest").agg(F.min("place").alias("node")), "sets")
    nodes = scratch.save(
        sketches.select(F.col("place").alias("node"), "n", "firsts").join(of_set.select("node"), "node", "left_semi"), "nodes"
    )
    members = scratch.save(sketches.select("digest", "id", "place").join(of_set, "digest").select("place", "id", "node"), "members")
    scratch.drop(sketches, of_set)
    edges = scratch.save(link(nodes, rows.select(F.col("place").alias("node"), "text"), words, scratch), "links")
    if near is not None:
        edges = edges.unionByName(_between_nodes(near(rows.select("place", "text")), members, scratch))
    roots = components(edges, scratch)
    firsts = scratch.save(
        members.join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"))
        .select("first.place"),
        "firsts",
    )
    return placed.join(firsts, "place", "left_semi").select("row.*")
