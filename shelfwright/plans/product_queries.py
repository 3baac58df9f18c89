"""Normalisation, validation, cleaning, de-duplication and merging of product records."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import js, text
from shelfwright.operators import dedup, normalize, validate
from shelfwright.operators.brands import infer_brands
from shelfwright.plans.derive import (
    LINES_SQL, RAW_SQL, normalized_parts, order_products, raw_parts,
)
from shelfwright.plans.registry import busy_table, query, table

FLAT = [
    "id", "name", "brand", "sku", "category", "price.regular", "price.sale", "price.currency",
    "availability.in_stock", "availability.stock_status", "availability.quantity",
]


def _mean(c, unit: int):
    """Mean to four decimals, summed in whole units so that the order of rows cannot show."""
    whole = F.sum(F.floor(c * float(unit) + 0.5))
    return F.floor(whole * F.lit(10000.0 / unit) / F.count(c) + 0.5) / F.lit(10000.0)


# Wide white space, for the SQL side.
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def tidy(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


def kebab(c: str) -> str:
    kept = f"regexp_replace(lower(trim({c})), '[^a-z0-9\\s-]', '', 'g')"
    dashed = f"regexp_replace(regexp_replace({kept}, '\\s+', '-', 'g'), '-+', '-', 'g')"
    return f"regexp_replace({dashed}, '^-|-$', '', 'g')"


def cents(c: str) -> str:
    return f"floor(({c}) * 100 + 0.5) / 100"


@query(f"""
WITH {RAW_SQL}, good AS (
  SELECT *, row_number() OVER (PARTITION BY full_name, full_brand, p_retailprice, sale, sku
    ORDER BY p_partkey) AS rn FROM norm)
SELECT full_brand AS brand, count(*) AS products,
  floor(sum(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)) * 100.0::DOUBLE / count(*) + 0.5) / 10000 AS mean_price,
  floor(sum(CAST(floor(score * 10 + 0.5) AS BIGINT)) * 1000.0::DOUBLE / count(*) + 0.5) / 10000 AS mean_score
FROM good WHERE rn = 1 GROUP BY full_brand
""")
def catalogue_by_brand(spark, sf):
    """Raw records, normalised, validated, cleaned, de-duplicated, then summed up by brand."""
    products = normalized_parts(spark, sf, keep=["p_partkey"])
    clean = products.transform(validate.validated)
    return (
        dedup.dedup_content(clean, "p_partkey")
        .groupBy("brand")
        .agg(
            F.count(F.lit(1)).alias("products"),
            _mean(F.col("price.regular"), 100).alias("mean_price"),
            _mean(F.col("metadata.scrape_quality_score"), 10).alias("mean_score"),
        )
    )


@query(f"""
WITH {RAW_SQL}
SELECT p_partkey, id, full_name AS name, full_brand AS brand, sku, full_category AS category,
  p_retailprice AS regular, sale, 'AUD' AS currency, in_stock, stock_status,
  CAST(0 AS DOUBLE) AS quantity,
  coalesce(array_to_string(list_filter(images, lambda x: trim(x) <> ''), '|'), '') AS images,
  CASE WHEN length(full_text) > 150 THEN substr(full_text, 1, 150) || '...' ELSE full_text END AS short,
  full_text, source_url, 'acme' AS site, CAST(score AS DOUBLE) AS score
FROM norm
""")
def product_normalize(spark, sf):
    return normalized_parts(spark, sf, keep=["p_partkey"]).select(
        "p_partkey",
        *FLAT,
        F.array_join("images", "|").alias("images"),
        F.col("description.short").alias("short"),
        F.col("description.full").alias("full_text"),
        "metadata.source_url",
        "metadata.site",
        F.col("metadata.scrape_quality_score").alias("score"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size % 5 = 1 WHEN p_partkey % 4 = 1 THEN false ELSE p_size % 5 > 0 END AS in_stock,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE p_size % 5 END AS DOUBLE) AS quantity,
  CASE WHEN p_size % 5 = 1 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status FROM part
""")
def availability_by_quantity(spark, sf):
    """A stock quantity, where given, decides over the status; a text that is no number counts as none."""
    k = F.col("p_partkey") % 4
    raw = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 5 == 1, "in_stock").otherwise("out_of_stock").alias("stock_status"),
        F.when(k == 1, "many").when(k > 1, (F.col("p_size") % 5).cast("string")).alias("inventory_quantity"),
    )
    made = normalize.normalize_availability(normalize._Raw(raw), use_quantity=True)
    return raw.select("p_partkey", made.alias("a")).select("p_partkey", "a.in_stock", "a.quantity", "a.stock_status")


@query(f"""
WITH {LINES_SQL}
SELECT o_orderkey, pos, id, name, type, value, regular, in_stock, quantity, stock_status FROM variants
""")
def variant_normalize(spark, sf):
    flat = normalize.flatten_variants(order_products(spark, sf, keep=["o_orderkey"]))
    v = "variant"
    return flat.filter(F.col(v).isNotNull()).select(
        "o_orderkey", F.col("variant_pos").alias("pos"), f"{v}.id", f"{v}.name", f"{v}.type",
        f"{v}.value", f"{v}.price.regular", f"{v}.availability.in_stock",
        f"{v}.availability.quantity", f"{v}.availability.stock_status",
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_text,
  coalesce(try_cast(regexp_extract(regexp_replace(regexp_replace(price_text, '[^0-9.,]', '', 'g'),
    ',', ''), '^([0-9]+\\.?[0-9]*|\\.[0-9]+)', 1) AS DOUBLE), 0) AS amount
FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN format('AUD ${:,.2f}', l_extendedprice)
    WHEN 1 THEN format('{:,.2f}', l_extendedprice * 100) WHEN 2 THEN 'from ' || l_quantity || ' to '
    || l_extendedprice ELSE 'Free' END AS price_text FROM lineitem)
""".replace("\\\\", "\\"))
def price_numeric(spark, sf):
    n, price = F.col("l_linenumber") % 4, F.col("l_extendedprice")
    shown = (
        F.when(n == 0, F.concat(F.lit("AUD $"), F.format_number(price, 2)))
        .when(n == 1, F.format_number(price * 100, 2))
        .when(
            n == 2,
            F.concat(
                F.lit("from "), F.col("l_quantity").cast("string"), F.lit(" to "),
                price.cast("string"),
            ),
        )
        .otherwise(F.lit("Free"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("price_text")
    ).withColumn("amount", text.numeric_price(F.col("price_text")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE floor(l_extendedprice * 100 + 0.5) / 100 END AS regular,
  CASE WHEN l_linenumber < 5 THEN floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 END AS sale
FROM lineitem
""")
def price_parse(spark, sf):
    was = F.format_number(js.cents(F.col("l_extendedprice")), 2)
    now = F.format_number(js.cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    n = F.col("l_linenumber")
    shown = (
        F.when(n == 7, F.lit("Call us"))
        .when(n < 5, F.concat(F.lit("Was $"), was, F.lit(" now $"), now))
        .otherwise(F.concat(F.lit("$"), was))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.parse_price(shown).alias("p")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.regular", "p.sale")


@query("""
WITH d AS (SELECT *, l_extendedprice - 50000 AS r, l_extendedprice * (1 - l_discount) - 50000 AS s
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net,
  CASE WHEN s <> 0 AND s < r AND r > 0 THEN floor((r - s) / r * 100 + 0.5) END AS checked,
  CASE WHEN s <> 0 AND s < r THEN floor((r - s) / r * 100 + 0.5) END AS loose,
  CASE WHEN s <> 0 THEN floor((1 - s / r) * 100 + 0.5) END AS unchecked
FROM d
""")
def price_discount(spark, sf):
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    regular, sale = price - 50000, price * (1 - off) - 50000
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        js.cents(price * (1 - off)).alias("net"),
        text.discount_pct(regular, sale).alias("checked"),
        text.discount_pct(regular, sale, "mcas").alias("loose"),
        text.discount_pct(regular, sale, "shopify").alias("unchecked"),
    )


@query(f"""
SELECT doc_id, {tidy('text')} AS tidy, {kebab("source || ' & ' || lang || ' -Co'")} AS kebab,
  CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS short
FROM documents
""")
def text_normalize(spark, sf):
    raw = busy_table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("text").alias("desc"))
    short = normalize.normalize_description(normalize._Raw(raw))["short"]
    return raw.select(
        "doc_id",
        js.collapse_space(F.col("desc")).alias("tidy"),
        text.normalize_category(
            F.concat("source", F.lit(" & "), "lang", F.lit(" -Co"))
        ).alias("kebab"),
        short.alias("short"),
    )


def _broken(spark, sf):
    """Normalised parts with some rules broken."""
    size = F.col("p_size")
    bad_variant = F.when(
        size % 19 == 0,
        F.transform(
            F.array(F.lit("shape")),
            lambda t: F.struct(
                F.lit("v1").alias("id"), F.lit(None).cast("string").alias("name"),
                F.lit(None).cast("string").alias("sku"), t.alias("type"), t.alias("value"),
                F.col("price"), F.col("availability"),
                F.lit(None).cast("array<string>").alias("images"),
            ),
        ),
    )
    products = normalized_parts(spark, sf, keep=["p_partkey", "p_size"])
    price = F.col("price")
    regular = F.when(size % 17 == 0, F.lit(float("nan"))).otherwise(price["regular"])
    currency = F.when(size % 11 == 0, F.lit("USD")).otherwise(price["currency"])
    status = F.when(size % 7 == 0, F.lit("gone")).otherwise(F.col("availability.stock_status"))
    return products.withColumns(
        {
            "name": F.when(size % 13 != 0, F.col("name")),
            "price": price.withField("regular", regular).withField("currency", currency),
            "availability": F.col("availability").withField("stock_status", status),
            "variants": bad_variant,
        }
    )


_STATUS_RULE = 'Invalid option: expected one of "in_stock"|"out_of_stock"|"backorder"|"preorder"'
_TYPE_RULE = 'Invalid option: expected one of "size"|"color"|"style"|"material"'
_STRING_RULE = "Invalid input: expected string, received undefined"
ERRORS_SQL = f"""
errs AS (
  SELECT p_partkey, list_filter([
    CASE WHEN p_size % 13 = 0 THEN 'name: {_STRING_RULE}' END,
    CASE WHEN p_size % 17 = 0 THEN 'price.regular: Invalid input: expected number, received NaN' END,
    CASE WHEN p_size % 11 = 0 THEN 'price.currency: Invalid input: expected "AUD"' END,
    CASE WHEN p_size % 7 = 0 THEN 'availability.stock_status: {_STATUS_RULE}' END,
    CASE WHEN p_size % 19 = 0 THEN 'variants.0.name: {_STRING_RULE}' END,
    CASE WHEN p_size % 19 = 0 THEN 'variants.0.type: {_TYPE_RULE}' END,
    CASE WHEN p_size % 19 = 0 AND p_size % 17 = 0
      THEN 'variants.0.price.regular: Invalid input: expected number, received NaN' END,
    CASE WHEN p_size % 19 = 0 AND p_size % 11 = 0
      THEN 'variants.0.price.currency: Invalid input: expected "AUD"' END,
    CASE WHEN p_size % 19 = 0 AND p_size % 7 = 0
      THEN 'variants.0.availability.stock_status: {_STATUS_RULE}' END
    ], lambda e: e IS NOT NULL) AS errors
  FROM part)
"""


@query(f"WITH {ERRORS_SQL} SELECT p_partkey, array_to_string(errors, '; ') AS errors FROM errs")
def product_errors(spark, sf):
    return validate.with_product_errors(_broken(spark, sf)).select(
        "p_partkey", validate.error_report(F.col("errors")).alias("errors")
    )


@query(f"""
WITH {ERRORS_SQL}
SELECT p_partkey, array_to_string(errors, '; ') AS errors FROM errs WHERE len(errors) > 0
""")
def product_rejects(spark, sf):
    _, rejects = validate.validate_products(_broken(spark, sf))
    return rejects.select("p_partkey", validate.error_report(F.col("errors")).alias("errors"))


@query(f"""
WITH {ERRORS_SQL}
SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid,
  count(*) FILTER (len(errors) > 0) AS invalid FROM errs
""")
def product_validation_stats(spark, sf):
    return validate.validation_stats(validate.with_product_errors(_broken(spark, sf)))


@query(f"""
WITH {ERRORS_SQL}
SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM errs) GROUP BY error
""")
def product_error_counts(spark, sf):
    return validate.validation_error_counts(validate.with_product_errors(_broken(spark, sf)))


@query(f"""
WITH {RAW_SQL}
SELECT p_partkey, {tidy('full_name')} AS name, {kebab('full_category')} AS category,
  {cents('p_retailprice')} AS regular, {cents('sale')} AS sale,
  CASE WHEN sale <> 0 AND sale < p_retailprice
    THEN floor((p_retailprice - sale) / p_retailprice * 100 + 0.5) END AS discount,
  CASE WHEN images IS NULL THEN '' ELSE 'https://img.example.com/part-' || p_partkey
    || '.jpg|https://img.example.com/big/part%20' || p_partkey || '.png' END AS images,
  CASE WHEN full_text = '' THEN NULL ELSE {tidy('full_text')} END AS full_text
FROM norm
""")
def product_clean(spark, sf):
    clean = validate.validated(normalized_parts(spark, sf, keep=["p_partkey"]))
    return clean.select(
        "p_partkey", "name", "category", "price.regular", "price.sale",
        F.col("price.discount_percentage").alias("discount"),
        F.array_join("images", "|").alias("images"),
        F.col("description.full").alias("full_text"),
    )


@query(f"""
WITH d AS (SELECT doc_id, {tidy('text')} AS t, lang, source FROM documents)
SELECT doc_id, md5(t) AS digest, 'Language=' || lang || ';Source=' || upper(source) AS specs,
  upper(lang) || ';CE' AS certifications
FROM d
""")
def product_clean_lists(spark, sf):
    """Specifications and certifications over whole document texts."""

    def entry(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    pairs = F.array(
        entry(" Language ", F.col("lang")),
        entry("Source", F.col("source")),
        entry("Source\t", F.upper("source")),
        entry("Blank", F.lit("  ")),
        entry(" ", F.col("text")),
    )
    specs = validate.clean_specs(F.map_from_entries(pairs))
    marks = F.array(F.col("lang"), F.lit(" ce "), F.lit("CE"), F.lit("  "))
    return busy_table(spark, sf, "documents").select(
        "doc_id",
        F.md5(js.collapse_space(F.col("text"))).alias("digest"),
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries(specs)),
                lambda e: F.concat(e["key"], F.lit("="), e["value"]),
            ),
            ";",
        ).alias("specs"),
        F.array_join(validate.clean_certifications(marks), ";").alias("certifications"),
    )


@query(f"""
WITH {LINES_SQL}
SELECT o_orderkey, id, name, type, value, {cents('regular')} AS regular FROM variants
WHERE NOT (type = 'style' AND quantity > 40)
""")
def variant_validate(spark, sf):
    """Variants with a broken type are dropped, the others cleaned."""
    wrong = F.transform(
        "variants",
        lambda v: v.withField(
            "type",
            F.when(
                (v["type"] == "style") & (v["availability"]["quantity"] > 40), F.lit("shape")
            ).otherwise(v["type"]),
        ),
    )
    kept = validate.validate_variants(wrong)
    return order_products(spark, sf, keep=["o_orderkey"]).select(
        "o_orderkey", F.explode(kept).alias("v")
    ).select("o_orderkey", "v.id", "v.name", "v.type", "v.value", "v.price.regular")


@query(f"""
WITH {RAW_SQL}
SELECT id, {tidy('full_name')} AS name, {kebab('full_category')} AS category,
  {cents('p_retailprice')} AS regular,
  CASE WHEN images IS NULL THEN 0 ELSE 2 END AS n_images, in_stock
FROM norm
""")
def product_preview(spark, sf):
    return validate.product_preview(normalized_parts(spark, sf)).select(
        "id", "name", "category", "price.regular", F.size("images").alias("n_images"),
        "availability.in_stock",
    )


@query(f"""
WITH {RAW_SQL}
SELECT id, full_name AS name, full_brand AS brand, full_category AS category, p_retailprice AS regular,
  stock_status, 'acme' AS site FROM norm
""")
def product_summary(spark, sf):
    return normalize.product_summary(normalized_parts(spark, sf)).select(
        "id", "name", "brand", "category", "price.regular", "availability.stock_status",
        "metadata.site",
    )


@query(f"""
WITH {RAW_SQL}
SELECT total, a AS unknown_brand, b AS no_images, c AS no_variants, d AS no_short_description,
  floor(a / total * 100.0 + 0.5) AS unknown_brand_pct, floor(b / total * 100.0 + 0.5) AS no_images_pct,
  floor(c / total * 100.0 + 0.5) AS no_variants_pct,
  floor(d / total * 100.0 + 0.5) AS no_short_description_pct
FROM (SELECT count(*) AS total, count(*) FILTER (full_brand = 'Unknown') AS a,
  count(*) FILTER (images IS NULL) AS b, count(*) AS c, count(*) FILTER (full_text = '') AS d FROM norm)
""")
def product_data_quality(spark, sf):
    return validate.data_quality_report(normalized_parts(spark, sf))


@query("""
SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN c_custkey % 6 = 0 THEN 'At least one URL must be provided' END,
  CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 4 = 0 THEN 'Invalid URL: no address' END,
  CASE WHEN c_custkey % 5 <> 0 AND (c_acctbal < 1 OR c_acctbal > 5000)
    THEN 'maxProducts must be between 1 and 10000' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'Category names cannot be empty' END],
  lambda e: e IS NOT NULL), '; ') AS errors
FROM customer
""")
def job_requests(spark, sf):
    k = F.col("c_custkey")
    good = F.concat(F.lit("https://shop.example.com/"), k.cast("string"))
    urls = (
        F.when(k % 6 == 0, F.array().cast("array<string>"))
        .when(k % 4 == 0, F.array(good, F.lit("no address")))
        .otherwise(F.array(good))
    )
    limit = F.when(
        k % 5 != 0, F.when(F.col("c_acctbal") < 1, 0).when(F.col("c_acctbal") > 5000, 10001).otherwise(9)
    )
    requests = table(spark, sf, "customer").select(
        "c_custkey",
        urls.alias("urls"),
        limit.alias("max_products"),
        F.when(k % 7 == 0, F.array("c_mktsegment", F.lit(" "))).alias("categories"),
    )
    return validate.validate_job_requests(requests).select(
        "c_custkey", F.array_join("errors", "; ").alias("errors")
    )


@query(f"""
WITH {LINES_SQL}, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey, type, value ORDER BY pos) AS rn FROM variants)
SELECT o_orderkey, count(*) AS n FROM firsts WHERE rn = 1 GROUP BY o_orderkey
""")
def variant_dedup(spark, sf):
    kept = dedup.dedup_variants(F.col("variants"))
    return order_products(spark, sf, keep=["o_orderkey"]).filter(F.size("variants") > 0).select(
        "o_orderkey",
        F.size(kept).cast("bigint").alias("n"),
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS rn
  FROM documents)
SELECT doc_id, lang, source FROM r WHERE rn = 1
""")
def product_dedup_content(spark, sf):
    """Documents as products: the first of equal whole texts stays."""
    products = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("name"), F.col("lang").alias("brand"),
        F.lit(1.0).alias("price"), F.col("source").alias("sku"),
    )
    return dedup.dedup_content(products, "doc_id").select(
        "doc_id", F.col("brand").alias("lang"), F.col("sku").alias("source")
    )


@query("""
SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM orders GROUP BY o_custkey
""")
def dedup_first_and_last(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    first = dedup.dedup_by_key(orders, "o_custkey", "o_orderkey", "first")
    last = dedup.dedup_by_key(orders, "o_custkey", "o_orderkey", "last")
    return first.withColumnRenamed("o_orderkey", "first_key").join(
        last.withColumnRenamed("o_orderkey", "last_key"), "o_custkey"
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'part ' || p_partkey END AS name,
  CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS brand,
  CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE p_retailprice * 2 END AS regular,
  'AUD' AS currency, p_type || '|' || p_name || '|' || p_brand AS images,
  'brand=' || p_brand || ';size=' || p_size AS specs
FROM part
""")
def product_merge(spark, sf):
    """Two partial records per part, merged."""
    size, part = F.col("p_size"), table(spark, sf, "part")
    none = F.lit(None).cast("string")
    brand_entry = F.create_map(F.lit("brand"), F.col("p_brand"))
    first = part.select(
        "p_partkey",
        F.lit(1).alias("ord"),
        F.when(size % 2 == 0, F.col("p_name")).alias("name"),
        F.when(size % 3 == 0, F.col("p_brand")).alias("brand"),
        F.struct(
            F.when(size % 5 == 0, F.col("p_retailprice")).alias("regular"), none.alias("currency")
        ).alias("price"),
        F.array("p_type").alias("images"),
        brand_entry.alias("specs"),
    )
    second = part.select(
        "p_partkey",
        F.lit(2).alias("ord"),
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_type").alias("brand"),
        F.struct((F.col("p_retailprice") * 2).alias("regular"), F.lit("AUD").alias("currency")).alias(
            "price"
        ),
        F.array("p_name", "p_brand").alias("images"),
        F.create_map(F.lit("brand"), F.lit("other"), F.lit("size"), size.cast("string")).alias("specs"),
    )
    merged = dedup.merge_partials(dedup.union_products(second, first), "p_partkey", "ord")
    return merged.select(
        "p_partkey", "name", "brand", "price.regular", "price.currency",
        F.array_join("images", "|").alias("images"),
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("specs")),
                lambda e: F.concat(e["key"], F.lit("="), e["value"]),
            ),
            ";",
        ).alias("specs"),
    )


@query("""
SELECT p_partkey AS id, 'old' AS batch, p_name AS name FROM part WHERE p_size <= 30
UNION ALL SELECT p_partkey, 'new', upper(p_name) FROM part WHERE p_size > 30
""")
def product_append(spark, sf):
    """Products of up to size 30 are there already; all parts come in again."""
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    old = part.filter("p_size <= 30").select("id", F.lit("old").alias("batch"), F.col("p_name").alias("name"))
    new = part.select("id", F.lit("new").alias("batch"), F.upper("p_name").alias("name"))
    return dedup.append_products(old, new)


_ANY_BRAND = list(dict.fromkeys(K.BRANDS))
_BRAND_CASES = " ".join(
    "WHEN regexp_matches(u, '\\b{}\\b') THEN '{}'".format(
        b.upper().replace("'", "''"), b.replace("'", "''")
    )
    for b in _ANY_BRAND
)


@query(f"""
WITH d AS (SELECT doc_id, coalesce(list_extract(['Shoei X-15 ', 'Genuine agv ', 'Rev''it! ', 'Bellow ',
    'Bull-it jeans ', 'Race Tech '], CAST(doc_id % 7 + 1 AS INT)), '') || text || ' SKU: A' || doc_id || ' CE'
  AS t FROM documents), e AS (SELECT doc_id, t, upper(t) AS u FROM d)
SELECT doc_id, CASE {_BRAND_CASES} END AS brand,
  nullif(regexp_extract(t, 'SKU:\\s*(\\S+)', 1), '') AS sku
FROM e
""")
def text_brand_and_sku(spark, sf):
    heads = ["Shoei X-15 ", "Genuine agv ", "Rev'it! ", "Bellow ", "Bull-it jeans ", "Race Tech "]
    head = F.get(F.array(*map(F.lit, heads)), (F.col("doc_id") % 7).cast("int"))
    told = F.concat(
        F.coalesce(head, F.lit("")), "text", F.lit(" SKU: A"), F.col("doc_id").cast("string"),
        F.lit(" CE"),
    )
    return busy_table(spark, sf, "documents").select("doc_id", told.alias("t")).select(
        "doc_id",
        text.infer_brand(F.col("t")).alias("brand"),
        text.sku_from_text(F.col("t")).alias("sku"),
    )


@query(r"""
WITH w AS (
  SELECT p_name AS brand, min(p_partkey) * 2 AS pos FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name
  UNION ALL SELECT word, min(p_partkey) * 2 + 1 FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word
), n AS (SELECT p_partkey, 'The ' || p_name || '/' || p_type || ' x' || p_partkey AS name FROM part),
hit AS (
  SELECT p_partkey, min_by(brand, pos) AS brand FROM n JOIN w ON regexp_matches(upper(name), '\b' || upper(brand) || '\b') GROUP BY p_partkey
)
SELECT p_partkey, brand FROM n LEFT JOIN hit USING (p_partkey)
""")
def text_brand_table(spark, sf):
    """Brands by a dictionary that is a table: names of parts, and the words they are made of."""
    parts = table(spark, sf, "part")
    whole = parts.where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("brand")).agg((F.min("p_partkey") * 2).alias("pos"))
    words = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("brand"))
    single = words.groupBy("brand").agg((F.min("p_partkey") * 2 + 1).alias("pos"))
    name = F.concat(F.lit("The "), "p_name", F.lit("/"), "p_type", F.lit(" x"), F.col("p_partkey").cast("string"))
    named = parts.select("p_partkey", name.alias("name"))
    return infer_brands(named, whole.unionByName(single)).select("p_partkey", "brand")


def _hits(patterns: str) -> str:
    return f"list_transform(regexp_extract_all(t, '(?i)\\b(?:{patterns})\\b'), lambda m: upper(m))"


def _ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


_ALL_CERTS = " || ".join(
    _hits(p) for p in ["CE", "DOT", "ECE", "SNELL", "ADR", r"AS/NZS\s*\d+(?:\.\d+)?"]
)


@query(f"""
WITH d AS (SELECT doc_id, text || ' fits Honda bike, BMW quad, honda. ECE 22.05, as/nzs 1698 dot'
    || CASE WHEN doc_id % 3 = 0 THEN ' CE ce' ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, t, {_ALL_CERTS} AS certs,
  list_transform(regexp_extract_all(t, '(?i)\\b(?:motorcycle|bike|scooter|atv|quad)\\b'),
    lambda m: lower(m)) AS types,
  list_transform(regexp_extract_all(t,
    '(?i)\\b(?:yamaha|honda|kawasaki|suzuki|ducati|bmw|harley|triumph|ktm)\\b'), lambda m: lower(m)) AS makes
  FROM d)
SELECT doc_id, array_to_string({_ordered_distinct('certs')}, ';') AS certifications,
  array_to_string({_ordered_distinct('types')}, ';') AS vehicle_types,
  array_to_string({_ordered_distinct('makes')}, ';') AS makes
FROM c
""")
def text_marks(spark, sf):
    told = F.concat(
        "text",
        F.lit(" fits Honda bike, BMW quad, honda. ECE 22.05, as/nzs 1698 dot"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" CE ce")).otherwise(F.lit("")),
    )
    fits = text.extract_compatibility(F.col("t"))
    return busy_table(spark, sf, "documents").select("doc_id", told.alias("t")).select(
        "doc_id",
        F.array_join(text.extract_certifications(F.col("t")), ";").alias("certifications"),
        F.array_join(fits["vehicle_types"], ";").alias("vehicle_types"),
        F.array_join(fits["makes"], ";").alias("makes"),
    )


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  n IN (4, 5, 6, 7) AS in_stock, CASE WHEN n IN (5, 6) THEN l_quantity END AS quantity,
  CASE n WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'backorder' WHEN 3 THEN 'preorder' ELSE 'in_stock' END
    AS stock_status,
  CASE n WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'preorder' WHEN 3 THEN 'backorder' ELSE 'in_stock' END
    AS schema_status,
  CASE n WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'backorder' WHEN 3 THEN 'out_of_stock'
    WHEN 7 THEN 'out_of_stock' WHEN 4 THEN 'out_of_stock' WHEN 5 THEN 'out_of_stock'
    ELSE 'in_stock' END AS mapped
FROM t
""")
def stock_texts(spark, sf):
    n = F.col("l_linenumber")
    count = F.col("l_quantity").cast("int").cast("string")
    shown = (
        F.when(n == 1, F.lit("SOLD OUT"))
        .when(n == 2, F.lit("On backorder"))
        .when(n == 3, F.lit("Pre-order now"))
        .when(n == 5, F.concat(count, F.lit(" In Stock")))
        .when(n == 6, F.concat(F.lit("only "), count, F.lit("  available")))
        .when(n == 7, F.lit("ready"))
    )
    linked = F.concat(
        F.lit("https://schema.org/"),
        F.when(n == 1, F.lit("OutOfStock")).when(n == 2, F.lit("PreOrder"))
        .when(n == 3, F.lit("BackOrder")).otherwise(F.lit("InStock")),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.parse_stock_text(shown).alias("s"),
        text.schemaorg_status(linked).alias("schema_status"),
        text.map_stock_status(F.coalesce(shown, F.lit("none"))).alias("mapped"),
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.in_stock", "s.quantity",
        "s.stock_status", "schema_status", "mapped",
    )


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS key, path, value FROM (
  SELECT p_partkey, 'name' AS path, p_name AS value FROM part
  UNION ALL SELECT p_partkey, 'price.regular',
    regexp_replace(regexp_replace(printf('%.6f', p_retailprice), '0+$', ''), '\\.$', '') FROM part
  UNION ALL SELECT p_partkey, 'images[0]', p_type FROM part
  UNION ALL SELECT p_partkey, 'images[1]', p_brand FROM part
  UNION ALL SELECT p_partkey, 'specs.size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'key', CAST(p_partkey AS VARCHAR) FROM part)
""".replace("\\\\", "\\"))
def record_paths(spark, sf):
    nested = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("key"),
        F.col("p_name").alias("name"),
        F.struct(F.col("p_retailprice").alias("regular"), F.lit(None).cast("double").alias("sale")).alias(
            "price"
        ),
        F.array("p_type", "p_brand").alias("images"),
        F.create_map(F.lit("size"), F.col("p_size")).alias("specs"),
    )
    return normalize.flatten_paths(nested, "key")


@query("SELECT p_partkey, p_name, p_brand FROM part")
def record_pick(spark, sf):
    return normalize.pick(table(spark, sf, "part"), ["p_partkey", "p_name", "missing", "p_brand"])


@query("""
SELECT p_partkey, 'acme-' || CASE WHEN p_size % 3 = 0 THEN 'S' || p_partkey ELSE 'part-' || p_partkey END
  AS page_id,
  (CASE WHEN length(p_name) > 5 THEN 3 ELSE 0 END + 3 + CASE WHEN p_size % 2 > 0 THEN 2 ELSE 0 END
    + CASE WHEN length(repeat(p_name, p_size % 4)) > 20 THEN 2 ELSE 0 END) / 10 AS score
FROM part
""")
def page_ids_and_scores(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    url = F.concat(F.lit("https://shop.example.com/p/part-"), key, F.lit("?page=2"))
    sku = F.when(size % 3 == 0, F.concat(F.lit("S"), key)).otherwise(F.lit(""))
    return table(spark, sf, "part").select(
        "p_partkey",
        text.page_product_id(F.lit("acme"), url, sku).alias("page_id"),
        text.completeness_score(
            F.col("p_name"), F.col("p_retailprice"), size % 2,
            F.repeat("p_name", (size % 4).cast("int")),
        ).alias("score"),
    )
