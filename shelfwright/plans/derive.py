"""Raw records, products and sites that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.operators.lookup import spread_by
from shelfwright.operators.normalize import normalize_products
from shelfwright.plans.registry import busy_table, table

AS_OF = "2025-01-15 10:00:00"
SITE = "acme"
SHOP = "https://shop.example.com"


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def raw_parts(spark: SparkSession, sf: str) -> DataFrame:
    """One raw record per part, with fields under changing names and some of them absent."""
    k, size = F.col("p_partkey"), F.col("p_size")
    key = k.cast("string")
    unnamed = k % 28 == 0
    status = (
        F.when(size % 5 == 0, F.lit("available"))
        .when(size % 5 == 1, F.lit("Out of stock"))
        .when(size % 5 == 2, F.lit("On Backorder"))
        .when(size % 5 == 3, F.lit("preorder"))
    )
    images = F.array(
        F.concat(F.lit("https://img.example.com/part-"), key, F.lit(".jpg")),
        F.lit("  "),
        F.concat(F.lit("HTTPS://IMG.example.com:443/a/../part-"), key, F.lit(".jpg")),
        F.concat(F.lit("https://img.example.com/big/part "), key, F.lit(".png")),
        F.lit("not an address"),
    )
    return busy_table(spark, sf, "part").select(
        "p_partkey",
        "p_size",
        F.when(~unnamed & (k % 7 != 3), F.col("p_name")).alias("name"),
        F.when(~unnamed & (k % 7 == 3), F.concat(F.initcap("p_name"), F.lit(" +"))).alias("title"),
        F.when(size % 5 != 0, F.col("p_brand")).alias("brand"),
        F.when(size % 10 == 0, F.upper("p_brand")).alias("vendor"),
        F.when(
            size % 6 != 0, F.concat(F.lit("AUD "), money_text(F.col("p_retailprice")))
        ).alias("price"),
        F.when(size % 6 == 0, F.col("p_retailprice")).alias("cost"),
        F.when(size % 3 == 0, money_text(F.col("p_retailprice") * 0.8)).alias("sale_price"),
        F.when(size % 10 != 0, F.concat("p_type", F.lit(" & Co"))).alias("category"),
        F.when(
            size % 8 != 0, F.repeat(F.concat("p_name", F.lit(".  ")), size.cast("int"))
        ).alias("description"),
        F.when(size % 4 != 0, images).alias("images"),
        F.when(k % 2 == 0, F.concat(F.lit("SKU-"), key)).alias("sku"),
        status.alias("stock_status"),
        F.concat(F.lit(f"{SHOP}/products/"), key).alias("source_url"),
    )


RAW_SQL = """
raw AS (
  SELECT p_partkey, p_size, p_brand, p_retailprice,
    CASE WHEN p_partkey % 28 <> 0 AND p_partkey % 7 <> 3 THEN p_name END AS name,
    CASE WHEN p_partkey % 28 <> 0 AND p_partkey % 7 = 3 THEN
      array_to_string(list_transform(string_split(p_name, ' '),
        lambda w: upper(w[1]) || substr(w, 2)), ' ') || ' +' END AS title,
    CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand,
    CASE WHEN p_size % 10 = 0 THEN upper(p_brand) END AS vendor,
    CASE WHEN p_size % 3 = 0 THEN floor(p_retailprice * 0.8 * 100 + 0.5) / 100 END AS sale,
    CASE WHEN p_size % 10 <> 0 THEN p_type || ' & Co' END AS category,
    CASE WHEN p_size % 8 <> 0 THEN repeat(p_name || '.  ', p_size) END AS description,
    CASE WHEN p_size % 4 <> 0 THEN
      ['https://img.example.com/part-' || p_partkey || '.jpg', '  ',
       'HTTPS://IMG.example.com:443/a/../part-' || p_partkey || '.jpg',
       'https://img.example.com/big/part ' || p_partkey || '.png', 'not an address'] END AS images,
    CASE WHEN p_partkey % 2 = 0 THEN 'SKU-' || p_partkey END AS sku,
    CASE p_size % 5 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'backorder'
      WHEN 3 THEN 'preorder' ELSE 'in_stock' END AS stock_status,
    p_size % 5 IN (0, 4) AS in_stock,
    'https://shop.example.com/products/' || p_partkey AS source_url
  FROM part),
norm AS (
  SELECT *, coalesce(name, title, 'Unknown Product') AS full_name,
    coalesce(brand, vendor, 'Unknown') AS full_brand,
    coalesce(category, 'uncategorized') AS full_category,
    'acme-' || coalesce(sku, regexp_replace(regexp_replace(lower(coalesce(name, title)),
      '[^a-z0-9]', '-', 'g'), '-+', '-', 'g')) AS id,
    coalesce(description, '') AS full_text,
    (CASE WHEN coalesce(name, title) IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN p_size % 6 <> 0 THEN 2 ELSE 0 END
      + CASE WHEN brand IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN description IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN images IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN category IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN sku IS NOT NULL THEN 1 ELSE 0 END) / 10.0 AS score
  FROM raw)
"""


def normalized_parts(spark: SparkSession, sf: str, keep: list[str] = ()) -> DataFrame:
    return normalize_products(raw_parts(spark, sf), SITE, AS_OF, keep)


def raw_orders(spark: SparkSession, sf: str, every: int = 1) -> DataFrame:
    """One raw record per order, or per order whose key ``every`` divides; its lines, in a fixed order, are the raw variants.

    Lines are gathered as the few numbers that order them and that their texts are made of.
    """
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    line = F.struct(
        F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"),
        F.col("l_suppkey").alias("k3"), F.col("l_extendedprice").alias("k4"),
        F.col("l_quantity").alias("k5"), F.col("l_tax").alias("k6"),
        sure(flag == "A").alias("titled"), sure(status == "O").alias("colored"), sure(flag == "R").alias("sized"),
        sure(flag != "N").alias("counted"), (status == "O").alias("open"),
    )

    def variant(x: Column) -> Column:
        n = x["k1"].cast("string")
        return F.struct(
            F.when(x["k1"] > 1, F.concat(F.lit("v"), n)).alias("id"),
            F.when(x["titled"], F.concat(F.lit("Line "), n)).alias("title"),
            money_text(x["k4"]).alias("price"),
            F.when(x["colored"], F.concat(F.lit("C"), n)).alias("color"),
            F.when(x["sized"], F.concat(F.lit("S"), n)).alias("size"),
            F.concat(F.lit("P"), x["k2"].cast("string")).alias("option2"),
            F.when(x["counted"], x["k5"]).alias("inventory_quantity"),
            F.when(x["k6"] > 0.04, x["open"]).alias("available"),
        )

    chosen = F.lit(True) if every == 1 else F.col("o_orderkey") % every == 0
    keyed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), line.alias("line")).where(chosen)
    lines = spread_by(keyed, "o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").where(chosen)
    return orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey",
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("Acme").alias("brand"),
        F.col("o_totalprice").alias("price"),
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("sku"),
        F.transform("lines", variant).alias("variants"),
    )


# Lines of orders as raw variants, with their position.
LINES_SQL = """
lines AS (
  SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey,
      l_suppkey, l_extendedprice, l_quantity, l_tax) - 1 AS INT) AS pos, l_linenumber, l_partkey, l_quantity,
    l_extendedprice, l_returnflag, l_linestatus, l_tax,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
variants AS (
  SELECT o_orderkey, pos,
    CASE WHEN l_linenumber > 1 THEN 'v' || l_linenumber ELSE 'variant-' || pos END AS id,
    CASE WHEN l_returnflag = 'A' THEN 'Line ' || l_linenumber
      ELSE 'Variant ' || (pos + 1) END AS name,
    CASE WHEN l_linestatus = 'O' THEN 'color' WHEN l_returnflag = 'R' THEN 'size'
      ELSE 'style' END AS type,
    CASE WHEN l_linestatus = 'O' THEN 'C' || l_linenumber WHEN l_returnflag = 'R'
      THEN 'S' || l_linenumber ELSE 'P' || l_partkey END AS value,
    l_extendedprice AS regular,
    CASE WHEN l_tax > 0.04 THEN l_linestatus = 'O' ELSE quantity > 0 END AS in_stock,
    quantity,
    CASE WHEN l_tax > 0.04 AND l_linestatus <> 'O' THEN 'out_of_stock' WHEN quantity > 0
      THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status
  FROM lines)
"""


def order_products(spark: SparkSession, sf: str, keep: list[str] = (), every: int = 1) -> DataFrame:
    return normalize_products(raw_orders(spark, sf, every), SITE, AS_OF, keep)
