"""De-duplication, merging and unions.

``row_number() = 1`` filters are planned with a partial group limit before the shuffle, so a key
that holds a large share of all rows sends one row per map task, not all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.functions import js


def first_per_key(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of every key; nulls are equal to each other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dedup_by_key(df: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    direction = F.col(order).asc() if keep == "first" else F.col(order).desc()
    return first_per_key(df, [key], [direction])


def dedup_content(df: DataFrame, order: str) -> DataFrame:
    """First of the products that agree on name, brand, price and sku."""
    return first_per_key(df, ["name", "brand", "price", "sku"], [F.col(order).asc()])


def dedup_variants(variants: Column) -> Column:
    """First of the variants of one product that agree on type and value."""
    return js.distinct_by(variants, lambda v: F.struct(v["type"], v["value"]))


def union_products(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def append_products(existing: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Existing and new products; the first per id stays, existing ones before new ones.

    ``order`` names a column that gives the position within one side; without it, rows count in the
    order of their files.
    """
    ranked = union_products(
        *[
            side.withColumns({"_side": F.lit(n), "_place": F.monotonically_increasing_id()})
            for n, side in enumerate((existing, new))
        ]
    )
    by = ["_side", *([order] if order else []), "_place"]
    return first_per_key(ranked, ["id"], [F.col(c).asc() for c in by]).drop("_side", "_place")


def merge_partials(df: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key from partial ones.

    For every leaf the earliest non-null value wins; arrays are joined, earlier ones in front;
    maps are merged, the earlier value of a key wins.
    """

    def leaf(c: Column, dtype: T.DataType) -> Column:
        position = F.when(c.isNotNull(), F.col(order))
        if isinstance(dtype, T.StructType):
            merged = F.struct(*[leaf(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(F.count(c) > 0, merged)
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            is_map = isinstance(dtype, T.MapType)
            value = F.map_entries(c) if is_map else c
            gathered = F.collect_list(
                F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))
            )
            joined = F.flatten(F.transform(F.array_sort(gathered), lambda x: x["v"]))
            if is_map:
                joined = F.map_from_entries(js.distinct_by(joined, lambda e: e["key"]))
            return F.when(F.count(c) > 0, joined)
        return F.min_by(c, position)

    fields = [f for f in df.schema.fields if f.name not in (key, order)]
    return df.groupBy(key).agg(*[leaf(F.col(f.name), f.dataType).alias(f.name) for f in fields])
