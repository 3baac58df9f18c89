"""Stored intermediate tables, and helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.session import checkpoint_dir, configure

#: An Arrow batch ends at whichever comes first; Python workers hold one batch and what they make of it.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


class Scratch:
    """A folder below the shared checkpoint folder, for tables that cut lineage.

    ``save`` writes and reads back, so later steps survive lost executors without running earlier steps again.
    ``drop`` deletes what no later step reads. What a result still reads stays; the folder belongs to whoever
    owns the checkpoint folder, and may be emptied after the result is stored.
    """

    def __init__(self, spark: SparkSession, name: str):
        configure(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df
        self.release()
        read = self.spark.read.schema(schema).parquet(path)
        read._scratch_path = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps now instead of at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; a worker, which outlives its task, hands the task's memory back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # no such function outside the GNU library
                pass

    return task


def task_count(spark: SparkSession) -> int:
    """Tasks for a step that does much work per byte."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(rid, th, text): texts with a key that equal rows share.

    ``rid`` is the id (0 if null), ``th`` a hash of the text; rows that agree in both have equal texts, hence
    equal results, so repeated rows need no number of their own. A null text is empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("rid"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
        *[F.col(c) for c in keep],
    )
