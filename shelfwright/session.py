"""Session settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Where this package lies; Python workers look here too, whatever folder they start in.
HOME = str(Path(__file__).resolve().parents[1])

# Runtime settings that decide results (time zone, map keys) or keep plans adaptive.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Validation filters sit on many computed columns; deriving further filters from them costs
    # seconds of planning and gains nothing, as no operator joins on null keys.
    "spark.sql.constraintPropagation.enabled": "false",
    # Python workers hold one batch of pages at a time: few rows, and few bytes where rows are large.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # A rank is limited before its shuffle for large batches as well as for small ones.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}

# Settings that only a new session can take; they change no result.
START_CONF = {
    # Call-site capture costs more than building the large page expressions themselves.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, and let its workers find this package."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *paths])
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "shelfwright", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session, or take the running one; ``master`` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    A folder is chosen here only when the session names none, which is the case in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = configured or tempfile.mkdtemp(prefix="shelfwright-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
