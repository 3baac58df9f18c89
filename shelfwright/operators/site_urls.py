"""URL operators that need the site table or produce several rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import urls
from shelfwright.operators.lookup import bounded_broadcast


def normalize_urls(
    df: DataFrame, url_col: str, site_col: str, sites: DataFrame, strict: bool = False
) -> DataFrame:
    """Add ``normalized_url`` and ``error`` by the base URL of the row's site.

    ``sites`` has name and base_url. An unknown site gives an error text, or fails when strict.
    """
    dim = sites.select(F.col("name").alias("_site"), F.col("base_url").alias("_base"))
    joined = df.join(bounded_broadcast(dim), F.col(site_col) == F.col("_site"), "left")
    known = F.col("_base").isNotNull()
    message = F.concat(F.lit("Unknown site: "), F.coalesce(F.col(site_col), F.lit("undefined")))
    failure = F.raise_error(message).cast("string") if strict else message
    return (
        joined.withColumn(
            "normalized_url", F.when(known, urls.normalize_url(F.col(url_col), F.col("_base")))
        )
        .withColumn("error", F.when(~known, failure))
        .drop("_site", "_base")
    )


def collection_urls(
    df: DataFrame, url_col: str, max_pages: int | Column, bare_first: bool = False
) -> DataFrame:
    """Pages 1..N of each collection; ``bare_first`` leaves page 1 without a parameter."""
    last = max_pages if isinstance(max_pages, Column) else F.lit(max_pages)
    first = F.lit(1)
    wanted = df if bare_first else df.filter(last >= 1)
    paged = wanted.withColumn("page", F.explode(F.sequence(first, F.greatest(last, first))))
    url = urls.with_query(F.col(url_col), {"page": F.col("page").cast("string")})
    if bare_first:
        url = F.when(F.col("page") == 1, F.col(url_col)).otherwise(url)
    return paged.withColumn("page_url", url)


def category_urls(
    sites: DataFrame, base_col: str, categories_col: str, pattern: str = "/collections/{category}"
) -> DataFrame:
    """One URL per site and category; the first ``{category}`` of the pattern is filled in."""
    before, mark, after = pattern.partition("{category}")
    exploded = sites.withColumn("category", F.explode(categories_col))
    path = F.concat(F.lit(before), F.col("category"), F.lit(after)) if mark else F.lit(pattern)
    return exploded.withColumn("category_url", urls.join_url(F.col(base_col), path))


def sitemap_urls(df: DataFrame, base_col: str) -> DataFrame:
    candidates = F.array(*[urls.join_url(F.col(base_col), F.lit(p)) for p in K.SITEMAP_PATHS])
    return df.withColumn("sitemap_url", F.explode(candidates))


def site_base_urls(df: DataFrame, site_col: str, sites: DataFrame) -> DataFrame:
    """Add ``base_url`` of the row's site, null for a site that is not configured."""
    dim = sites.select(F.col("name").alias("_site"), "base_url")
    return df.join(
        bounded_broadcast(dim), F.col(site_col) == F.col("_site"), "left"
    ).drop("_site")
