"""Near-duplicate vectors: int8 tile products with error bounds, exact where a pair may qualify."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.components import components, local_roots
from shelfwright.llm.groups import whole_groups
from shelfwright.llm.scratch import Scratch, task_count

TILE = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers to ±127), scales, norms of the decoded rows and norms of what decoding misses."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    decoded = codes * scale[:, None]
    return (
        codes.astype(np.int8), scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)
    )


def close_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs with cosine of at least the threshold.

    With x = x' + dx and y = y' + dy, <x,y> differs from <x',y'> by at most |x'||dy| + |dx||y'| + |dx||dy|. Pairs
    that this bound leaves open are computed again in double precision from the given rows. Products of codes
    are whole numbers below 2**24 for up to 1,000 components, so float32 adds them without rounding; for longer
    rows double is used.
    """
    norms = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (left, right)]
    (ca, sa, na, ea), (cb, sb, nb, eb) = (
        quantise(m / n[:, None]) for m, n in zip((left, right), norms, strict=True)
    )
    kind = np.float32 if left.shape[1] <= 1000 else np.float64
    about = (ca.astype(kind) @ cb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    slack = na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :] + 1e-9
    i, j = np.nonzero(about + slack >= threshold)
    exact = np.einsum("ij,ij->i", left[i], right[j]) / (norms[0][i] * norms[1][j])
    hit = exact >= threshold
    return i[hit], j[hit]


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, ["label", "dim", "tile_a", "tile_b"]):
            ids = batch.column("cid").to_numpy(zero_copy_only=False)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            tile_a = batch.column("tile_a").to_numpy(zero_copy_only=False)
            tile_b = batch.column("tile_b").to_numpy(zero_copy_only=False)
            column = batch.column("vector")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            for s, e in bounds:
                rows = values[at[s] : at[e]].reshape(e - s, -1)
                one, two = (np.flatnonzero(part[s:e] == t[s]) for t in (tile_a, tile_b))
                if not len(one) or not len(two):
                    continue
                a, b = close_pairs(rows[one], rows[two], threshold)
                a, b = one[a], two[b]
                if tile_a[s] == tile_b[s]:
                    keep = a < b
                    a, b = a[keep], b[keep]
                if not len(a):
                    continue
                links = np.zeros(e - s, dtype=np.int64)
                np.add.at(links, a, copies[s:e][b])
                np.add.at(links, b, copies[s:e][a])
                order = np.argsort(ids[s:e], kind="stable")
                place = np.empty(e - s, dtype=np.int64)
                place[order] = np.arange(e - s)
                root = ids[s:e][order][local_roots(e - s, place[a], place[b])[place]]
                hit = links > 0
                yield pa.record_batch(
                    {"cid": ids[s:e][hit], "links": links[hit], "root": root[hit]}
                )

    return run


def near_vectors(
    table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", tile: int = TILE,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label (and one length) are compared by cosine. Equal vectors become one class first, which
    counts for each of its copies. A label's classes are dealt into parts of about ``tile`` rows by a hash of
    their number, and each two parts make one tile, so no label is gathered in one task. A tile returns a count
    and a local root per class, never its pairs.

    Null labels, null or zero vectors, vectors with null or non-finite components and empty vectors link with
    nothing and are their own component. Rows that repeat an id count as vectors of their own; the component is
    the smallest id among its rows, null if they have none. An empty table gives an empty table.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(
        F.col("label").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    rows = rows.select(
        "id", "label", "vector", good.alias("good"), F.xxhash64("label", "vector").alias("vkey")
    )
    classes = scratch.save(
        rows.where("good")
        .groupBy("vkey", "label", "vector")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vector"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    parts = classes.groupBy("label", "dim").agg(
        F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts")
    )
    dealt = (
        classes.select("cid", "label", "dim", "vector", "copies")
        .join(parts, ["label", "dim"])
        .withColumn("part", F.pmod(F.hash("cid"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "cid", "label", "dim", "vector", "copies", "part",
            F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"),
        )
    )
    keys = ["label", "dim", "tile_a", "tile_b"]
    found = scratch.save(
        dealt.repartition(task_count(spark), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_tiles(threshold), "cid long, links long, root long"),
        "links",
    )
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = scratch.save(
        classes.select("cid", "vkey", "label", "vector", "least", "copies")
        .join(links, "cid", "left")
        .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .select(
            "vkey", "label", "vector", "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "cid").alias("root"),
        ),
        "linked",
    )
    # stored, so that a frequent root or vector is split in the joins
    smallest = scratch.save(linked.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    by_class = scratch.save(
        linked.join(smallest, "root").select("vkey", "label", "vector", "n_links", "component_id"), "by-class"
    )
    good_rows = rows.where("good").join(by_class, ["vkey", "label", "vector"])
    lone = rows.where(~F.col("good"))
    return good_rows.select("id", "n_links", "component_id").unionByName(
        lone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    ).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
