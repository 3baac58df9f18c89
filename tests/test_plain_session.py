"""The queries on a session that this library did not build, as a caller of its own would have."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry

assert entry.entry(spark).count() > 0
queries = entry.queries()
for name in ("url_normalize", "page_types", "rate_audit", "product_merge"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_plain_session():
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=ROOT, capture_output=True, text=True, timeout=600
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]
