"""Product files and fetched pages."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright import schemas
from shelfwright.operators.lookup import spread_scan
from shelfwright.operators.relational import TABLES, flatten_for_csv
from shelfwright.session import checkpoint_dir
from shelfwright.sources.store import ProductStore


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_products_json(
    spark: SparkSession, path: str, schema: T.StructType = schemas.PRODUCT, array_file: bool = True
) -> DataFrame:
    """Products of JSON files; a missing path gives an empty table.

    ``array_file`` reads files that hold one JSON array each. Such a file is one task's work, so
    large tables belong in JSON lines, which is what ``write_products_json`` writes.
    """
    try:
        return spark.read.schema(schema).option("multiLine", array_file).json(path)
    except AnalysisException as error:
        if _is_missing(error):
            return spark.createDataFrame([], schema)
        raise


def write_products_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_products_csv(
    df: DataFrame, path: str, delimiter: str = ",", header: bool = True,
    include_variants: bool = False, include_images: bool = True,
) -> None:
    """Flat export; quotes inside a value are doubled."""
    flat = flatten_for_csv(df, include_variants, include_images)
    (
        flat.write.mode("overwrite")
        .option("sep", delimiter)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_relational(tables: dict[str, DataFrame], directory: str, mode: str = "overwrite") -> None:
    """One Parquet table each; products are laid out by site, so site filters prune files."""
    for name, table in tables.items():
        writer = table.write.mode(mode)
        if name == "products":
            writer = writer.partitionBy("site")
        writer.parquet(f"{directory.rstrip('/')}/{name}")


def read_relational(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{directory.rstrip('/')}/{name}") for name in TABLES}


def read_stored(spark: SparkSession, directory: str) -> dict[str, DataFrame] | None:
    """The five tables as the last finished ``add_to_stored`` left them; None before the first."""
    return ProductStore(spark, directory).read()


def add_to_stored(df: DataFrame, directory: str, order: str | None = None) -> None:
    """Add products to the stored tables; those stored under the same id are replaced (see ``ProductStore``)."""
    ProductStore(df.sparkSession, directory).add(df, order)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html), over all cores, as parsing them is heavy."""
    return spread_scan(spark.read.parquet(path))


def store_products(
    df: DataFrame, fmt: str, directory: str, filename: str | None = None,
    append_timestamp: bool = True, as_of: datetime | None = None,
) -> DataFrame:
    """Store in ``json``, ``csv``, ``tables`` or ``all``; one result row per format.

    Empty input stores nothing. Names carry a UTC time unless told otherwise. Tables are added to
    what earlier runs stored under the same name.
    """
    spark = df.sparkSession
    result = "format string, path string, count bigint, success boolean, error string"
    kinds = ["json", "tables", "csv"] if fmt == "all" else [fmt]
    now = (as_of or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H-%M-%S")
    stamp = f"_{now}" if append_timestamp else ""
    base = f"{directory.rstrip('/')}/{filename or 'products'}"
    # Stored once: all formats hold the same rows, and a lost executor costs no second reading of pages.
    batch = f"{checkpoint_dir(spark).rstrip('/')}/batch-{uuid.uuid4().hex}"
    df.write.parquet(batch)
    kept = spark.read.schema(df.schema).parquet(batch)
    rows = []
    try:
        count = kept.count()
        if count == 0:
            return spark.createDataFrame([], result)
        for kind in kinds:
            path = f"{base}.tables" if kind == "tables" else f"{base}{stamp}.{kind}"
            try:
                if kind == "json":
                    write_products_json(kept, path)
                elif kind == "csv":
                    write_products_csv(kept, path)
                elif kind == "tables":
                    add_to_stored(kept, path)
                else:
                    raise ValueError(f"unknown format: {kind}")
                rows.append((kind, path, count, True, None))
            except Exception as error:  # noqa: BLE001 - the failure is the result row
                rows.append((kind, "", 0, False, str(error)))
    finally:
        made = spark._jvm.org.apache.hadoop.fs.Path(batch)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)
    return spark.createDataFrame(rows, result)


def _listing(spark: SparkSession, directory: str) -> DataFrame:
    """Path, size and time of all files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(directory)
        .select("path", "length", "modificationTime")
    )


def storage_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Number and total bytes of files by extension."""
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return (
        _listing(spark, directory)
        .groupBy(ext.alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("total_size"))
    )


def stale_files(
    spark: SparkSession, directory: str, as_of, max_age_hours: int = 24 * 7
) -> DataFrame:
    """Files older than an age at a time; what to do with them is up to the caller."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    return _listing(spark, directory).filter(F.col("modificationTime") < limit)
