"""Raw alias records to products, and projections of products."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright import constants as K
from shelfwright import schemas
from shelfwright.functions import js, text


class _Raw:
    """Raw columns by alias; an absent column reads as null text."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def dtype(self, name: str) -> T.DataType:
        return self.types.get(name, T.StringType())

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name in self.types else F.lit(None).cast("string")

    def has(self, name: str) -> bool:
        return name in self.types

    def truthy(self, *names: str) -> Column:
        test = F.lit(False)
        for name in names:
            if self.has(name):
                test = test | js.is_truthy(self[name], self.dtype(name))
        return test

    def text(self, *names: str, default: str | None = None) -> Column:
        cols = []
        for name in names:
            if self.has(name):
                value = self[name].cast("string")
                cols.append(F.when(js.is_truthy(self[name], self.dtype(name)), value))
        return js.first_truthy(*cols, default=default)


def pick(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*[f for f in fields if f in df.columns])


def _number(raw: _Raw, name: str) -> Column:
    if isinstance(raw.dtype(name), T.NumericType):
        return raw[name].cast("double")
    return text.numeric_price(raw[name])


def normalize_price(raw: _Raw) -> Column:
    regular = F.lit(0.0)
    for name in ["amount", "cost", "regular_price", "price"]:
        regular = F.when(raw.truthy(name), _number(raw, name)).otherwise(regular)
    return F.struct(
        regular.alias("regular"),
        F.when(raw.truthy("sale_price"), _number(raw, "sale_price")).alias("sale"),
        F.lit(K.CURRENCY).alias("currency"),
        F.lit(None).cast("double").alias("discount_percentage"),
    )


def normalize_image_list(raw: _Raw) -> Column:
    """First of the three image fields: non-blank strings of an array, or one string."""
    images = F.array().cast("array<string>")
    for name in ["image_urls", "photos", "images"]:
        if not raw.has(name):
            continue
        if isinstance(raw.dtype(name), T.ArrayType):
            value = F.filter(raw[name], lambda x: js.trim(x) != "")
            images = F.when(raw[name].isNotNull(), value).otherwise(images)
        else:
            images = F.when(raw.truthy(name), F.array(raw[name])).otherwise(images)
    return images


def normalize_description(raw: _Raw) -> Column:
    full = raw.text("description", "desc", "product_description", "summary", default="")
    short = F.when(
        F.length(full) > 150, F.concat(F.substring(full, 1, 150), F.lit("..."))
    ).otherwise(full)
    return F.struct(
        short.alias("short"),
        full.alias("full"),
        F.lit(None).cast("array<string>").alias("features"),
        F.lit(None).cast("map<string,string>").alias("specifications"),
    )


def variant_type(v: Column, fields: set[str]) -> Column:
    kind = F.lit("style")
    for name in ["material", "size", "color"]:
        if name in fields:
            kind = F.when(js.blank_to_null(v[name]).isNotNull(), F.lit(name)).otherwise(kind)
    return kind


def variant_value(v: Column, fields: set[str]) -> Column:
    order = ["color", "size", "material", "option1", "option2", "option3"]
    return js.first_truthy(*[v[n] for n in order if n in fields], default="Default")


def _quantity(v: Column, fields: set[str]) -> Column:
    if "inventory_quantity" not in fields:
        return F.lit(0.0)
    return F.coalesce(v["inventory_quantity"].cast("double"), F.lit(0.0))


def variant_stock(v: Column, fields: set[str]) -> Column:
    status = F.when(_quantity(v, fields) > 0, F.lit("in_stock")).otherwise(F.lit("out_of_stock"))
    if "available" in fields:
        status = F.when(v["available"].eqNullSafe(F.lit(False)), F.lit("out_of_stock")).otherwise(
            status
        )
    return status


def normalize_variants(variants: Column, element: T.StructType) -> Column:
    """Raw variants to variants. Fields outside the known raw list are not looked at."""
    types = {f.name: f.dataType for f in element.fields if f.name in K.RAW_VARIANT_FIELDS}
    fields = set(types)

    def price(v: Column) -> Column:
        value = F.lit(0.0)
        for name in ["sale_price", "price"]:
            if name in fields:
                number = (
                    v[name].cast("double")
                    if isinstance(types[name], T.NumericType)
                    else text.numeric_price(v[name])
                )
                value = F.when(js.is_truthy(v[name], types[name]), number).otherwise(value)
        return value

    def build(v: Column, i: Column) -> Column:
        quantity = _quantity(v, fields)
        in_stock = quantity > 0
        if "available" in fields:
            in_stock = F.coalesce(v["available"], in_stock)
        names = [v[n] for n in ["title", "name"] if n in fields]
        ids = [v[n].cast("string") for n in ["id"] if n in fields]
        skus = [v[n].cast("string") for n in ["sku"] if n in fields]
        return F.struct(
            F.coalesce(
                js.first_truthy(*ids), F.concat(F.lit("variant-"), i.cast("string"))
            ).alias("id"),
            F.coalesce(
                js.first_truthy(*names), F.concat(F.lit("Variant "), (i + 1).cast("string"))
            ).alias("name"),
            js.first_truthy(*skus, default="").alias("sku"),
            variant_type(v, fields).alias("type"),
            variant_value(v, fields).alias("value"),
            F.struct(
                price(v).alias("regular"),
                F.lit(None).cast("double").alias("sale"),
                F.lit(K.CURRENCY).alias("currency"),
                F.lit(None).cast("double").alias("discount_percentage"),
            ).alias("price"),
            F.struct(
                in_stock.alias("in_stock"),
                quantity.alias("quantity"),
                variant_stock(v, fields).alias("stock_status"),
            ).alias("availability"),
            F.lit(None).cast("array<string>").alias("images"),
        )

    return F.coalesce(
        F.transform(variants, build), F.array().cast(T.ArrayType(schemas.VARIANT))
    )


def normalize_availability(raw: _Raw, use_quantity: bool = False) -> Column:
    """Availability, then in_stock, then stock_status; a quantity overrides when used.

    Product records never carry the quantity field into this step, so ``use_quantity`` is off
    in ``normalize_products``.
    """
    in_stock, status = F.lit(True), F.lit("in_stock")
    if raw.has("stock_status"):
        given = raw["stock_status"]
        in_stock = F.when(given.isNotNull(), given.isin("in_stock", "available")).otherwise(in_stock)
        status = F.when(given.isNotNull(), text.map_stock_status(given)).otherwise(status)
    for name in ["in_stock", "availability"]:
        if raw.has(name):
            in_stock = F.when(raw[name].isNotNull(), raw.truthy(name)).otherwise(in_stock)
            status = F.when(raw[name].isNotNull(), F.lit("in_stock")).otherwise(status)
    quantity = F.lit(0.0)
    if use_quantity and raw.has("inventory_quantity"):
        given = raw["inventory_quantity"]
        quantity = F.coalesce(given.try_cast("double"), F.lit(0.0))
        in_stock = F.when(given.isNotNull(), quantity > 0).otherwise(in_stock)
    return F.struct(
        in_stock.alias("in_stock"), quantity.alias("quantity"), status.alias("stock_status")
    )


def normalizer_id(raw: _Raw, site: Column) -> Column:
    """``site-sku``, else ``site-name-slug``, else ``site-`` and a hash of the content."""
    sku = raw.text("sku", "product_id", "handle")
    name = raw.text("name", "title", "product_title")
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", "-"), "-+", "-")
    hashed = [raw[n].cast("string").alias(n) for n in ["name", "title", "price", "brand"]]
    digest = F.sha2(F.to_json(F.struct(*hashed)), 256)
    return F.concat(site, F.lit("-"), F.coalesce(sku, slug, digest))


def quality_score(raw: _Raw) -> Column:
    """Completeness in tenths over seven raw fields."""
    has_images = F.lit(False)
    if isinstance(raw.dtype("images"), T.ArrayType):
        has_images = F.coalesce(F.size(raw["images"]) > 0, F.lit(False))
    parts = [
        (raw.truthy("name", "title"), 2),
        (raw.truthy("price", "regular_price"), 2),
        (raw.truthy("brand"), 1),
        (raw.truthy("description"), 1),
        (has_images, 2),
        (raw.truthy("category"), 1),
        (raw.truthy("sku"), 1),
    ]
    score = F.lit(0)
    for test, points in parts:
        score = score + F.when(test, points).otherwise(0)
    return score / F.lit(10.0)


def normalize_products(
    df: DataFrame, site: Column | str, as_of: Column | datetime | str, keep: list[str] = ()
) -> DataFrame:
    """Raw alias records to the product model. ``keep`` names extra columns to carry along."""
    raw = _Raw(df)
    site = site if isinstance(site, Column) else F.lit(site)
    scraped = as_of if isinstance(as_of, Column) else F.lit(as_of)
    no_variants = F.array().cast(T.ArrayType(schemas.VARIANT))
    variants = no_variants
    if isinstance(raw.dtype("variants"), T.ArrayType):
        variants = normalize_variants(raw["variants"], raw.dtype("variants").elementType)
    columns = {
        "id": normalizer_id(raw, site),
        "name": raw.text(
            "name", "title", "product_title", "product_name", default="Unknown Product"
        ),
        "brand": raw.text("brand", "manufacturer", "vendor", default="Unknown"),
        "sku": raw.text("sku", "product_id", "handle"),
        "category": raw.text("category", "product_type", "collection", default="uncategorized"),
        "price": normalize_price(raw),
        "availability": normalize_availability(raw),
        "variants": variants,
        "images": normalize_image_list(raw),
        "description": normalize_description(raw),
        "metadata": F.struct(
            scraped.cast("timestamp").alias("scraped_at"),
            raw.text("url", "source_url", "_source_url", default="").alias("source_url"),
            site.alias("site"),
            F.lit(None).cast("timestamp").alias("last_updated"),
            quality_score(raw).alias("scrape_quality_score"),
        ),
    }
    return to_product_schema(df, columns, keep)


def to_product_schema(df: DataFrame, columns: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """One projection to the product model; attributes not given are null."""
    out = [F.col(name) for name in keep]
    for field in schemas.PRODUCT.fields:
        value = columns.get(field.name, F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def flatten_variants(df: DataFrame) -> DataFrame:
    """One row per variant with its position; products without variants keep one row."""
    carried = [c for c in df.columns if c != "variants"]
    return df.select(*carried, F.posexplode_outer("variants").alias("variant_pos", "variant"))


def flatten_paths(df: DataFrame, key: str) -> DataFrame:
    """Every leaf of a nested record as (key, path, value), such as ``variants[0].price.regular``.

    Null leaves count as absent. Paths come from the schema; only array positions and map keys
    come from the data. An empty array shows as ``[]`` and an empty map as ``{}``.
    """

    def entry(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"))

    none = F.array().cast("array<struct<path:string,value:string>>")

    def walk(path: Column, c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            parts = [
                walk(F.concat(path, F.lit(f".{f.name}")), c[f.name], f.dataType)
                for f in dtype.fields
            ]
            return F.concat(*parts) if parts else none
        if isinstance(dtype, T.ArrayType):
            nested = F.flatten(
                F.transform(
                    c,
                    lambda x, i: walk(
                        F.concat(path, F.lit("["), i.cast("string"), F.lit("]")),
                        x,
                        dtype.elementType,
                    ),
                )
            )
            empty = F.array(entry(path, F.lit("[]")))
            return F.when(c.isNull(), none).when(F.size(c) == 0, empty).otherwise(nested)
        if isinstance(dtype, T.MapType):
            nested = F.flatten(
                F.transform(
                    F.map_entries(c),
                    lambda e: walk(F.concat(path, F.lit("."), e["key"]), e["value"], dtype.valueType),
                )
            )
            empty = F.array(entry(path, F.lit("{}")))
            return F.when(c.isNull(), none).when(F.size(c) == 0, empty).otherwise(nested)
        if isinstance(dtype, T.TimestampType):
            value = js.iso_utc(c)
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = js.number_text(c)
        else:
            value = c.cast("string")
        return F.when(c.isNull(), none).otherwise(F.array(entry(path, value)))

    parts = [walk(F.lit(f.name), F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.col(key).alias("key"), F.explode(F.concat(*parts)).alias("e")).select(
        "key", "e.path", "e.value"
    )


def product_summary(df: DataFrame) -> DataFrame:
    return df.select(*schemas.SUMMARY_FIELDS)
