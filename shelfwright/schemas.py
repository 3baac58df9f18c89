"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


STR, DBL, LNG, INT, BOOL, TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(STR)
STRING_MAP = T.MapType(STR, STR)

PRICE = _struct(regular=DBL, sale=DBL, currency=STR, discount_percentage=DBL)
AVAILABILITY = _struct(in_stock=BOOL, quantity=DBL, stock_status=STR)
VARIANT = _struct(
    id=STR, name=STR, sku=STR, type=STR, value=STR, price=PRICE, availability=AVAILABILITY,
    images=STRINGS,
)
DESCRIPTION = _struct(short=STR, full=STR, features=STRINGS, specifications=STRING_MAP)
COMPLIANCE = _struct(adr=BOOL, australian_standards=STRINGS)
COMPATIBILITY = _struct(
    vehicle_types=STRINGS, makes=STRINGS, models=STRINGS, years=T.ArrayType(DBL)
)
DIMENSIONS = _struct(length=DBL, width=DBL, height=DBL, unit=STR)
SHIPPING = _struct(
    weight=DBL, dimensions=DIMENSIONS, restrictions=STRINGS, free_shipping_eligible=BOOL
)
REVIEWS = _struct(
    average_rating=DBL, review_count=DBL, rating_distribution=T.MapType(STR, DBL)
)
METADATA = _struct(
    scraped_at=TS, source_url=STR, site=STR, last_updated=TS, scrape_quality_score=DBL
)

PRODUCT = _struct(
    id=STR, name=STR, brand=STR, sku=STR, category=STR, subcategory=STR,
    price=PRICE, availability=AVAILABILITY, variants=T.ArrayType(VARIANT), images=STRINGS,
    description=DESCRIPTION, certifications=STRINGS, compliance=COMPLIANCE,
    compatibility=COMPATIBILITY, shipping=SHIPPING, reviews=REVIEWS, metadata=METADATA,
)

SUMMARY_FIELDS = [
    "id", "name", "brand", "category", "price", "availability", "images", "metadata",
]

SITE_CONFIG = _struct(
    name=STR, base_url=STR, adapter_type=STR,
    rate_limit=_struct(
        requests_per_minute=DBL, delay_between_requests=DBL, concurrent_requests=DBL
    ),
    categories=STRINGS,
    selectors=_struct(
        product_container=STR, product_name=STR, price=STR, sale_price=STR, stock_status=STR,
        brand=STR, images=STR, description=STR, specifications=STR, variants=STR,
    ),
    navigation=_struct(
        product_list_pattern=STR, product_page_pattern=STR, pagination_selector=STR,
        category_urls=STRING_MAP, sitemap_url=STR,
    ),
    anti_detection=_struct(
        use_stealth=BOOL, rotate_user_agents=BOOL, simulate_human_behavior=BOOL,
        block_images=BOOL, block_css=BOOL,
    ),
    custom_headers=STRING_MAP,
    cookies=T.ArrayType(_struct(name=STR, value=STR, domain=STR, path=STR)),
)

RAW_VARIANT = _struct(
    id=STR, title=STR, name=STR, price=STR, sale_price=STR, sku=STR, barcode=STR,
    inventory_quantity=DBL, available=BOOL, weight=STR, size=STR, color=STR,
    option1=STR, option2=STR, option3=STR,
)

LOG_ENTRY = _struct(timestamp=TS, level=STR, message=STR, context=STR, source=STR)
METRIC_POINT = _struct(name=STR, type=STR, value=DBL, timestamp=TS, tags=STRING_MAP)
REQUEST = _struct(site=STR, success=BOOL, response_ms=DBL, data_extracted=LNG, ts=TS)

# An element of a page that a selector fits, with its place in the document. ``last`` is its last descendant; its text is the
# slice [t0, t1) of the page text, and those of the siblings before and behind it are [p0, p1) and [n0, n1).
HIT = _struct(i=INT, last=INT, attrs=STRING_MAP, t0=INT, t1=INT, p0=INT, p1=INT, n0=INT, n1=INT)
# One list of elements for each selector.
PARSED_PAGE = _struct(text=STR, hits=T.ArrayType(T.ArrayType(HIT)))
