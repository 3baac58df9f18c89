"""Products as five flat tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright import constants as K
from shelfwright import schemas
from shelfwright.functions import js
from shelfwright.operators.dedup import first_per_key

TABLES = [
    "products", "product_images", "product_specifications", "product_variants", "variant_images",
]


def _nonzero(c: Column) -> Column:
    """Zero, NaN and false are stored as null."""
    return F.when(js.is_truthy(c, T.DoubleType()), c)


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def to_relational(df: DataFrame) -> dict[str, DataFrame]:
    """Five tables keyed by product id, and variant id within it; ``image_order`` is the position."""
    products = df.select(
        "id", "name", "brand", js.blank_to_null(F.col("sku")).alias("sku"), "category",
        js.blank_to_null(F.col("subcategory")).alias("subcategory"),
        F.col("price.regular").alias("regular_price"),
        _nonzero(F.col("price.sale")).alias("sale_price"),
        F.col("price.currency").alias("currency"),
        _nonzero(F.col("price.discount_percentage")).cast("int").alias("discount_percentage"),
        F.col("availability.in_stock").alias("in_stock"),
        F.col("availability.stock_status").alias("stock_status"),
        _nonzero(F.col("availability.quantity")).cast("int").alias("quantity"),
        js.blank_to_null(F.col("description.short")).alias("short_description"),
        js.blank_to_null(F.col("description.full")).alias("full_description"),
        _list(F.col("certifications")).alias("certifications"),
        F.when(F.col("compliance.adr"), F.lit(True)).alias("compliance_adr"),
        _list(F.col("compliance.australian_standards")).alias("compliance_standards"),
        _list(F.col("compatibility.vehicle_types")).alias("vehicle_types"),
        _list(F.col("compatibility.makes")).alias("makes"),
        _list(F.col("compatibility.models")).alias("models"),
        F.col("metadata.site").alias("site"),
        F.col("metadata.source_url").alias("source_url"),
        F.col("metadata.scraped_at").alias("scraped_at"),
        _nonzero(F.col("metadata.scrape_quality_score")).alias("quality_score"),
    )
    images = df.select(
        F.col("id").alias("product_id"), F.posexplode("images").alias("image_order", "image_url")
    )
    specs = df.select(
        F.col("id").alias("product_id"),
        F.explode("description.specifications").alias("spec_key", "spec_value"),
    )
    each = df.select(F.col("id").alias("product_id"), F.explode("variants").alias("v"))
    variants = each.select(
        "v.id", "product_id", "v.name", js.blank_to_null(F.col("v.sku")).alias("sku"), "v.type",
        "v.value",
        F.col("v.price.regular").alias("regular_price"),
        _nonzero(F.col("v.price.sale")).alias("sale_price"),
        F.col("v.price.currency").alias("currency"),
        _nonzero(F.col("v.price.discount_percentage")).cast("int").alias("discount_percentage"),
        F.col("v.availability.in_stock").alias("in_stock"),
        F.col("v.availability.stock_status").alias("stock_status"),
        _nonzero(F.col("v.availability.quantity")).cast("int").alias("quantity"),
    )
    variant_images = each.select(
        "product_id", F.col("v.id").alias("variant_id"),
        F.posexplode("v.images").alias("image_order", "image_url"),
    )
    parts = [products, images, specs, variants, variant_images]
    return dict(zip(TABLES, parts, strict=True))


def latest_products(df: DataFrame, order: str | None = None) -> DataFrame:
    """The last product of each id, by ``order`` or else by its place in the input."""
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    by = [F.col(order).desc()] if order else []
    return first_per_key(placed, ["id"], [*by, F.col("_place").desc()]).drop("_place")


def upsert_relational(
    old: dict[str, DataFrame], new: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Stored products that come again are replaced with all their children.

    ``new`` holds each product once: cut it from ``latest_products``, so that of a repeated key the
    last write stays, with its children and no others. Variant ids need to be unique only within
    their product.
    """
    ids = new["products"].select("id").distinct()
    as_product = ids.withColumnRenamed("id", "product_id")
    return {
        name: old[name]
        .join(ids if name == "products" else as_product, "id" if name == "products" else "product_id", "left_anti")
        .unionByName(new[name])
        for name in TABLES
    }


def from_relational(tables: dict[str, DataFrame], newest_first: bool = False) -> DataFrame:
    """Nested products, on demand the newest first. Children without a parent drop out.

    Children, variant images as well, are gathered per product before the joins; all joins are on the
    product id, so one shuffle per table serves aggregation and join.
    """
    variant_images = (
        tables["variant_images"]
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(F.struct("variant_id", "image_order", "image_url"))).alias("_vi"))
    )
    no_list = F.array().cast("array<string>")
    variant = F.struct(
        "id", "name", "sku", "type", "value",
        F.struct(
            F.col("regular_price").alias("regular"), F.col("sale_price").alias("sale"), "currency",
            F.col("discount_percentage").cast("double").alias("discount_percentage"),
        ).alias("price"),
        F.struct(
            "in_stock", F.col("quantity").cast("double").alias("quantity"), "stock_status"
        ).alias("availability"),
        no_list.alias("images"),
    )
    variants = (
        tables["product_variants"]
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(variant)).alias("_variants"))
    )
    images = (
        tables["product_images"]
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(F.struct("image_order", "image_url"))).alias("_images"))
    )
    specs = (
        tables["product_specifications"]
        .groupBy("product_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("spec_key").alias("key"), F.col("spec_value").alias("value")))
            ).alias("_specs")
        )
    )
    joined = tables["products"]
    for child in [images, specs, variants, variant_images]:
        joined = joined.join(
            child.withColumnRenamed("product_id", "id"), "id", "left"
        )

    def with_images(v: Column) -> Column:
        own = F.filter("_vi", lambda x: x["variant_id"] == v["id"])
        return v.withField("images", F.coalesce(F.transform(own, lambda x: x["image_url"]), no_list))

    none = F.lit(None)
    columns = {
        "id": F.col("id"), "name": F.col("name"), "brand": F.col("brand"), "sku": F.col("sku"),
        "category": F.col("category"), "subcategory": F.col("subcategory"),
        "price": F.struct(
            "regular_price", "sale_price", "currency", F.col("discount_percentage").cast("double")
        ),
        "availability": F.struct("in_stock", F.col("quantity").cast("double"), "stock_status"),
        "variants": F.coalesce(F.transform("_variants", with_images), F.array().cast(T.ArrayType(schemas.VARIANT))),
        "images": F.coalesce(F.transform("_images", lambda x: x["image_url"]), no_list),
        "description": F.struct(
            "short_description", "full_description", none.cast("array<string>"),
            F.coalesce(js.last_wins_map(F.col("_specs")), F.create_map().cast("map<string,string>")),
        ),
        "certifications": F.col("certifications"),
        "compliance": F.struct("compliance_adr", "compliance_standards"),
        "compatibility": F.struct("vehicle_types", "makes", "models", none.cast("array<double>")),
        "metadata": F.struct(
            "scraped_at", "source_url", "site", none.cast("timestamp"), "quality_score"
        ),
    }
    out = [
        columns.get(f.name, none).cast(f.dataType).alias(f.name) for f in schemas.PRODUCT.fields
    ]
    products = joined.select(*out)
    return products.orderBy(F.col("metadata.scraped_at").desc(), "id") if newest_first else products


def flatten_for_csv(
    df: DataFrame, include_variants: bool = False, include_images: bool = True
) -> DataFrame:
    """Products in the flat export shape; a row per variant when asked and present."""

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    def joined(c: Column) -> Column:
        return F.coalesce(F.array_join(c, "; "), F.lit(""))

    specs = F.transform(
        F.map_entries("description.specifications"),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
    )
    values = {
        "id": F.col("id"), "name": F.col("name"), "brand": F.col("brand"),
        "sku": shown(F.col("sku")), "category": F.col("category"),
        "subcategory": shown(F.col("subcategory")),
        "regular_price": js.number_text(F.col("price.regular")),
        "sale_price": shown(js.number_text(F.col("price.sale"))),
        "currency": F.col("price.currency"),
        "discount_percentage": shown(js.number_text(F.col("price.discount_percentage"))),
        "in_stock": F.col("availability.in_stock").cast("string"),
        "stock_status": F.col("availability.stock_status"),
        "quantity": shown(js.number_text(F.col("availability.quantity"))),
        "short_description": shown(F.col("description.short")),
        "full_description": shown(F.col("description.full")),
        "specifications": joined(specs),
        "certifications": joined(F.col("certifications")),
        "compliance_adr": shown(F.col("compliance.adr").cast("string")),
        "compliance_standards": joined(F.col("compliance.australian_standards")),
        "vehicle_types": joined(F.col("compatibility.vehicle_types")),
        "makes": joined(F.col("compatibility.makes")),
        "models": joined(F.col("compatibility.models")),
        "site": F.col("metadata.site"),
        "source_url": F.col("metadata.source_url"),
        "scraped_at": js.iso_utc(F.col("metadata.scraped_at")),
        "quality_score": shown(js.number_text(F.col("metadata.scrape_quality_score"))),
    }
    out = [values[name].alias(name) for name in K.CSV_COLUMNS]
    if include_images:
        out.append(joined(F.col("images")).alias("images"))
    if not include_variants:
        return df.select(*out)
    v = F.col("v")
    variant_values = [
        v["id"], v["name"], v["type"], v["value"], v["sku"],
        js.number_text(v["price"]["regular"]), js.number_text(v["price"]["sale"]),
        v["availability"]["in_stock"].cast("string"), v["availability"]["stock_status"],
        joined(v["images"]),
    ]
    out += [
        shown(value).alias(name)
        for name, value in zip(K.CSV_VARIANT_COLUMNS, variant_values, strict=True)
    ]
    return df.withColumn("v", F.explode_outer("variants")).select(*out)
