"""Brands of product names by a dictionary table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.operators.lookup import bounded_broadcast

_WORD = "[0-9A-Za-z_]+"


def _pattern(brand: Column) -> Column:
    """The brand as a whole word, whatever characters it has."""
    quoted = F.replace(F.upper(brand), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\b\\Q"), quoted, F.lit("\\E\\b"))


def infer_brands(
    df: DataFrame, brands: DataFrame, name_col: str = "name", out_col: str = "brand", brand_col: str = "brand", order_col: str = "pos"
) -> DataFrame:
    """Add the first brand, by the dictionary's order, that stands in the name as a whole word, in any case; null if none does.

    The same answer as ``text.infer_brand`` gives on its list, for a dictionary that is a table. A brand can only stand in a name
    that has the brand's first word as a word of its own, so the dictionary is indexed by first words; the words of a
    name fetch candidates, and only those are tested. Brands without a word character are tested by their first character.
    Each different name is looked up once, so a name that many products share costs no more than any other.

    Null names and brands match nothing; of equal places in the order the lesser brand counts.
    """
    upper = F.upper(F.col(brand_col))
    word = F.nullif(F.regexp_extract(upper, _WORD, 0), F.lit(""))
    index = brands.where(F.col(brand_col).isNotNull() & (F.col(brand_col) != "")).select(
        F.col(brand_col).alias("_brand"), F.col(order_col).alias("_place"),
        F.coalesce(F.concat(F.lit("w"), word), F.concat(F.lit("c"), F.substring(upper, 1, 1))).alias("_key"),
    )
    names = df.select(F.col(name_col).alias("_name")).where("_name IS NOT NULL").distinct()
    shown = F.upper("_name")
    words = F.transform(F.regexp_extract_all(shown, F.lit(f"({_WORD})"), F.lit(1)), lambda w: F.concat(F.lit("w"), w))
    signs = F.transform(
        F.split(F.regexp_replace(shown, _WORD, ""), ""), lambda c: F.concat(F.lit("c"), c)
    )
    found = (
        names.withColumn("_key", F.explode(F.array_distinct(F.concat(words, signs))))
        .join(bounded_broadcast(index), "_key")
        .where(F.regexp_like(shown, _pattern(F.col("_brand"))))
        .groupBy("_name").agg(F.min(F.struct("_place", "_brand")).alias("_first"))
        .select("_name", F.col("_first._brand").alias("_found"))
    )
    kept = [F.col(f"`{c}`") for c in df.columns if c != out_col]
    return df.join(found, F.col(name_col) == F.col("_name"), "left").select(*kept, F.col("_found").alias(out_col))
