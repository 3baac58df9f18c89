"""Dimension lookups with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Above this many rows a dimension is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000
# And above this many bytes, as text.
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and is short as text; reads one row beyond at most."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, text = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and text <= BROADCAST_BYTES


def spread_scan(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over all cores when it has fewer splits than that.

    For steps that do much work per byte. A large input has more splits than cores and is read as
    it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` hashed by a key into the session's full number of shuffle partitions.

    A grouping on the key that follows needs no shuffle of its own, and its partitions are not
    merged for being small in bytes, which suits steps that do much work per byte.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism), key)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its size is proven small, else unchanged (shuffle join)."""
    return F.broadcast(df) if is_small(df, max_rows) else df
