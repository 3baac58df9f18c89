"""Expressions that read prices, stock, brands and marks out of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import js


def numeric_price(c: Column) -> Column:
    """Number in a price text: digits, dots and commas kept, the first comma dropped."""
    kept = F.regexp_replace(c.cast("string"), "[^0-9.,]", "")
    no_comma = F.regexp_replace(kept, "^([^,]*),", "$1")
    prefix = F.regexp_extract(no_comma, r"^(\d+\.?\d*|\.\d+)", 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0))


def parse_price(c: Column) -> Column:
    """All dollar amounts of a text: the first is regular, the second the sale price."""
    amounts = F.transform(
        F.regexp_extract_all(c, F.lit(r"(\$[\d,]+\.?\d*)"), F.lit(1)),
        lambda m: F.coalesce(F.regexp_replace(m, "[$,]", "").try_cast("double"), F.lit(0.0)),
    )
    return js.let(
        amounts,
        lambda a: F.struct(
            F.coalesce(F.get(a, F.lit(0)), F.lit(0.0)).alias("regular"),
            F.get(a, F.lit(1)).alias("sale"),
        ),
    )


def normalize_category(c: Column) -> Column:
    """Kebab case: only a-z, 0-9 and single inner hyphens."""
    kept = F.regexp_replace(js.trim(F.lower(c)), f"[^a-z0-9\\-{js.SPACE[1:-1]}]", "")
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(kept, f"{js.SPACE}+", "-"), "-+", "-"), "^-|-$", ""
    )


def discount_pct(regular: Column, sale: Column, mode: str = "validator") -> Column:
    """Whole percentage off.

    ``validator`` needs 0 < sale < regular; ``mcas`` does not look at regular <= 0;
    ``shopify`` has no guard but a truthy sale.
    """
    if mode == "shopify":
        ratio = (F.lit(1.0) - F.try_divide(sale, regular)) * 100.0
        return F.when(sale != 0, js.round_half_up(ratio))
    ratio = F.try_divide(regular - sale, regular) * 100.0
    guard = (sale != 0) & (sale < regular)
    if mode == "validator":
        guard = guard & (regular > 0)
    return F.when(guard, js.round_half_up(ratio))


def map_stock_status(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.contains("in_stock") | low.contains("available"), F.lit("in_stock"))
        .when(low.contains("backorder"), F.lit("backorder"))
        .when(low.contains("preorder"), F.lit("preorder"))
        .otherwise(F.lit("out_of_stock"))
    )


def parse_stock_text(c: Column) -> Column:
    """Stock notice to in_stock, stock_status and quantity; no notice means in stock."""
    low = F.lower(F.coalesce(c, F.lit("")))
    status = (
        F.when(low.contains("out of stock") | low.contains("sold out"), F.lit("out_of_stock"))
        .when(low.contains("backorder"), F.lit("backorder"))
        .when(low.contains("preorder") | low.contains("pre-order"), F.lit("preorder"))
        .otherwise(F.lit("in_stock"))
    )
    count = F.regexp_extract(
        F.coalesce(c, F.lit("")), r"(?i)(\d+)\s*(in stock|available)", 1
    ).try_cast("double")
    return F.struct(
        (status == "in_stock").alias("in_stock"),
        F.when(status == "in_stock", count).alias("quantity"),
        status.alias("stock_status"),
    )


def schemaorg_status(c: Column) -> Column:
    return (
        F.when(c.contains("InStock"), F.lit("in_stock"))
        .when(c.contains("OutOfStock"), F.lit("out_of_stock"))
        .when(c.contains("PreOrder"), F.lit("preorder"))
        .when(c.contains("BackOrder"), F.lit("backorder"))
        .otherwise(F.lit("in_stock"))
    )


def infer_brand(name: Column, brands: list[str] | None = None) -> Column:
    """First dictionary brand that starts the name or stands in it as a whole word.

    The dictionary is a short fixed list, so it is written into the expression: no join. One
    test over all brands comes first, because most names hold none of them.
    """
    words = list(dict.fromkeys(brands or K.BRANDS))

    def pattern(*names: str) -> str:
        return rf"\b(?:{'|'.join(re.escape(n.upper()) for n in names)})\b"

    any_brand = pattern(*words)

    def found(upper: Column) -> Column:
        each = [F.when(upper.rlike(pattern(w)), F.lit(w)) for w in words]
        return F.when(upper.rlike(any_brand), F.coalesce(*each))

    return js.let(F.upper(name), found)


def sku_from_text(c: Column) -> Column:
    return js.blank_to_null(F.regexp_extract(c, rf"SKU:{js.SPACE}*([^\s]+)", 1))


def extract_certifications(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    hits = [
        F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)) for p in K.CERTIFICATION_PATTERNS
    ]
    return F.array_distinct(F.transform(F.concat(*hits), F.upper))


def _words(c: Column, words: list[str]) -> Column:
    hits = F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit(rf"(?i)\b({'|'.join(words)})\b"), F.lit(1)
    )
    return js.first_nonempty(F.array_distinct(F.transform(hits, F.lower)))


def extract_compatibility(c: Column) -> Column:
    return F.struct(
        _words(c, K.VEHICLE_TYPES).alias("vehicle_types"), _words(c, K.VEHICLE_MAKES).alias("makes")
    )


def page_product_id(site: Column, url: Column, sku: Column | None = None) -> Column:
    """``site-sku``, else ``site-`` and the last path segment without its query."""
    last = F.element_at(F.split(url, "/"), -1)
    slug = js.first_truthy(F.element_at(F.split(last, r"\?"), 1), default="unknown")
    tail = slug if sku is None else F.coalesce(js.blank_to_null(sku), slug)
    return F.concat(site, F.lit("-"), tail)


def completeness_score(name: Column, price: Column, n_images: Column, description: Column) -> Column:
    """0.3 name, 0.3 price, 0.2 images, 0.2 description; the sum is kept at one decimal."""
    tenths = (
        F.when(F.length(name) > 5, 3).otherwise(0)
        + F.when(price > 0, 3).otherwise(0)
        + F.when(n_images > 0, 2).otherwise(0)
        + F.when(F.length(description) > 20, 2).otherwise(0)
    )
    return tenths / F.lit(10.0)


def is_blocked(title: Column, url: Column) -> Column:
    """Struct (is_blocked, reason) from page title and URL."""
    t, u = F.lower(F.coalesce(title, F.lit(""))), F.lower(url)
    reason = F.lit(None).cast("string")
    challenge = F.lit(False)
    for word in K.CHALLENGE_WORDS:
        challenge = challenge | url.contains(word)
    reason = F.when(challenge, F.lit("Challenge/verification page detected"))
    found = F.coalesce(
        *[
            F.when(
                t.contains(w) | u.contains(w), F.lit(f"Detected blocking indicator: {w}")
            )
            for w in K.BLOCK_WORDS
        ]
    )
    reason = F.coalesce(found, reason)
    return F.struct(reason.isNotNull().alias("is_blocked"), reason.alias("reason"))


def is_image_url(url: Column) -> Column:
    """A web address whose path ends like an image or speaks of one."""
    from shelfwright.functions import urls

    path = F.lower(urls.url_path(url))
    endings = "|".join(e.replace(".", r"\.") for e in K.IMAGE_EXTENSIONS)
    words = "|".join(K.IMAGE_PATH_WORDS)
    return urls.is_valid_url(url) & path.rlike(f"({endings})$|{words}")


def mime_ext(c: Column) -> Column:
    ext = F.lit(".jpg")
    for mime, value in K.MIME_EXTENSIONS.items():
        ext = F.when(c == mime, F.lit(value)).otherwise(ext)
    return ext
