"""Image jobs and manifests. Content columns are read only where a digest is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import text
from shelfwright.operators.dedup import first_per_key


def image_jobs(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").alias("product_id"), F.explode("images").alias("url"))


def check_images(
    df: DataFrame, types: list[str] = K.IMAGE_TYPES, max_size: int = K.IMAGE_MAX_BYTES
) -> DataFrame:
    """Add ``reason``: null for accepted images (url, content_type, size)."""
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    reason = (
        F.when(
            ~F.coalesce(text.is_image_url(F.col("url")), F.lit(False)), F.lit("Invalid image URL")
        )
        .when(~kind.isin(types), F.concat(F.lit("Unsupported image type "), kind))
        .when(
            F.col("size") > max_size,
            F.concat(F.lit("Image too large ("), F.col("size").cast("string"), F.lit(" bytes)")),
        )
    )
    return df.withColumn("reason", reason)


def accept_images(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    checked = check_images(df, **limits)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def image_manifest(df: DataFrame, directory: str, as_of) -> DataFrame:
    """One row per image (product_id, url, content_type, content): digest, file name, size."""
    digest = F.md5("content")
    filename = F.concat(
        F.col("product_id"), F.lit("_"), digest, text.mime_ext(F.col("content_type"))
    )
    return df.select(
        "product_id",
        F.col("url").alias("original_url"),
        F.concat(F.lit(directory.rstrip("/") + "/"), filename).alias("local_path"),
        filename.alias("filename"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.col("content_type").alias("mime_type"),
        digest.alias("hash"),
        F.lit(as_of).cast("timestamp").alias("downloaded_at"),
    )


def new_images(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Images whose file is not stored yet; equal files inside one batch count once."""
    fresh = manifest.join(existing.select("filename"), "filename", "left_anti")
    order = [F.col("original_url").asc()]
    return first_per_key(fresh, ["filename"], order).select(*manifest.columns)
