"""Fetched pages: the page table itself, and shop pages that Spark writes from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright.functions import nodes, urls
from shelfwright.operators import pages as ops
from shelfwright.operators.adapters.base import extract_specs
from shelfwright.operators.adapters.generic import USUAL_LIMITS, GenericAdapter
from shelfwright.operators.adapters.mcas import McasAdapter
from shelfwright.operators.adapters.shopify import (
    ShopifyAdapter, page_description, page_in_stock, page_variants, raw_images, raw_variants,
)
from shelfwright.operators.html import parse_pages
from shelfwright.operators.lookup import spread_by
from shelfwright.operators.normalize import normalize_products
from shelfwright.operators.validate import validated
from shelfwright.plans.derive import AS_OF, money_text
from shelfwright.plans.registry import busy_table, query, table
from shelfwright.plans.store_queries import scratch
from shelfwright.sources.products import read_pages


def fetched(spark, sf):
    return read_pages(spark, f"{sf.rstrip('/')}/pages.parquet")


def read(df, build):
    """``build`` makes the result columns of a parsed page; their selectors run at the parse."""
    page = nodes.Page()
    columns = build(page)
    return parse_pages(df, page).select(*columns)


def _decode(c: str) -> str:
    return f"replace({c}, '&amp;', '&')"


@query(f"""
SELECT page_id, trim({_decode("regexp_extract(html, '<title>([^<]*)', 1)")}) AS title,
  trim({_decode("regexp_extract(html, '<h1>([^<]*)', 1)")}) AS heading,
  array_to_string(regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), 'href="([^"]*)"', 1), '|') AS links,
  array_to_string(regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), '">([^<]+)</a>', 1), '|') AS labels
FROM pages
""")
def page_select(spark, sf):
    """First text, all texts and all attribute values of selectors."""
    return read(fetched(spark, sf), lambda p: [
        "page_id",
        nodes.select_text(p, "title").alias("title"),
        nodes.select_text(p, "article h1").alias("heading"),
        F.array_join(nodes.select_attrs(p, "nav a", "href"), "|").alias("links"),
        F.array_join(nodes.select_texts(p, "nav ul li a"), "|").alias("labels"),
    ])


@query("""
SELECT page_id, nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS first_link,
  len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<li[ >]')) AS items,
  len(regexp_extract_all(html, 'class="ad"')) AS ads
FROM pages
""")
def page_counts(spark, sf):
    return read(fetched(spark, sf), lambda p: [
        "page_id",
        nodes.select_attr(p, "a", "href").alias("first_link"),
        F.size(nodes.select(p, "p")).cast("bigint").alias("paragraphs"),
        F.size(nodes.select(p, "nav > ul > li")).cast("bigint").alias("items"),
        F.size(nodes.select(p, "div.ad")).cast("bigint").alias("ads"),
    ])


_BLOCK_SQL = " ".join(
    f"WHEN contains(t, '{w}') OR contains(u, '{w}') THEN 'Detected blocking indicator: {w}'"
    for w in [
        "access denied", "blocked", "rate limit", "too many requests", "captcha", "bot detection",
        "suspicious activity", "403", "429", "cloudflare",
    ]
)


@query(f"""
WITH p AS (SELECT page_id, lower({_decode("regexp_extract(html, '<title>([^<]*)', 1)")}) AS t, lower(url) AS u
  FROM pages)
SELECT page_id, CASE {_BLOCK_SQL} WHEN contains(u, 'challenge') OR contains(u, 'verify')
  THEN 'Challenge/verification page detected' END AS reason FROM p
""")
def page_blocked(spark, sf):
    titled = read(fetched(spark, sf), lambda p: ["page_id", "url", nodes.select_text(p, "title").alias("title")])
    return ops.detect_blocked(titled, F.col("title")).select("page_id", "reason")


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
    regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), 'href="([^"]*)"', 1) AS links FROM pages),
l AS (SELECT page_id, origin || unnest(links) AS link FROM p)
SELECT page_id, count(DISTINCT link) AS n_links FROM l
WHERE regexp_matches(lower(link), '/product|/item|/p/|/shop/.+/.+') GROUP BY page_id
""")
def page_product_links(spark, sf):
    """Product links of fetched pages by the generic rules."""
    site = F.concat(urls.url_protocol(F.col("url")), F.lit("//"), urls.url_host(F.col("url")))
    reader = GenericAdapter(site=F.lit("any"), base_url=F.col("base_url"))
    return read(fetched(spark, sf).withColumn("base_url", site), lambda p: [
        "page_id", F.size(reader.discover(F.col("url"), p)["product_urls"]).cast("bigint").alias("n_links")
    ]).filter("n_links > 0")


def _join(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _present(record):
    """The record as a row of its own, no row for null.

    A filter on the record would be pushed below the projection and extract every page twice.
    """
    return F.explode(F.array_compact(F.array(record)))


def _extracted(pages, reader):
    """The product of each page by a reader, where it finds one."""
    as_of = F.lit(AS_OF).cast("timestamp")
    return read(pages, lambda p: ["p_partkey", _present(reader.extract(F.col("url"), p, as_of)).alias("p")])


# --- product pages written from parts ------------------------------------------------------------


def shopify_pages(spark, sf):
    """A product page per part in the hosted-shop style."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    brand = F.when(size % 2 == 0, _join('<span class="product-vendor">', F.col("p_brand"), "</span>"))
    brand = F.coalesce(brand, F.lit(""))
    sale = F.when(size % 3 == 0, _join(" now ", money_text(F.col("p_retailprice") / 2)))
    button = F.when(size % 5 == 0, F.lit('<button type="submit" disabled>Sold</button>')).otherwise(
        F.lit('<button type="submit">Add to cart</button>')
    )
    described = F.when(
        size % 4 > 0, _join('<div class="product-description"> All about ', F.col("p_name"), " </div>")
    ).otherwise(_join("<p>", F.repeat(_join("The ", F.col("p_name"), " helmet. "), F.lit(9)), "</p>"))
    html = _join(
        "<html><head><title>", F.col("p_name"), '</title></head><body><div class="breadcrumbs">Home > ',
        F.col("p_type"), " > ", F.col("p_name"),
        '</div><form class="product-form" data-product-id="', key, '"><h1> Shoei ', F.col("p_name"),
        " </h1>", brand, '<span class="price">', money_text(F.col("p_retailprice")),
        F.coalesce(sale, F.lit("")), '</span><div class="product-form__input"><label>Size</label>'
        '<select name="id"><option value="">Select one</option><option value="s">Small $5.50</option>'
        '<option value="l">Large<option value="s2">Small $5.50</select></div>', button,
        "</form><div class=\"product-images\"><img src='//cdn.shop.example.com/product-", key,
        ".jpg'><img src='/helmet-", key, ".png'><img src='/logo-helmet.png'><img src='/helmet-", key,
        ".png'></div><table class=\"spec-table\"><tr><th>Size<td>", size.cast("string"),
        "<tr><td>Type</td><td>", F.col("p_type"), "</td></tr><tr><td>Lone</td></tr></table>", described,
        "<button>XL</button><p>SKU: K", key, "</p></body></html>",
    )
    return busy_table(spark, sf, "part").select(
        "p_partkey", "p_size",
        _join("https://acme.example.com/products/part-", key, "?ref=feed").alias("url"),
        F.lit("acme").alias("site"),
        html.alias("html"),
    )


@query("""
SELECT p_partkey, 'acme-K' || p_partkey AS id, 'Shoei ' || p_name AS name,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Shoei' END AS brand, 'K' || p_partkey AS sku,
  p_type AS category, p_retailprice AS regular,
  CASE WHEN p_size % 3 = 0 THEN floor(p_retailprice / 2 * 100 + 0.5) / 100 END AS sale,
  CASE WHEN p_size % 3 = 0 THEN 50 END::DOUBLE AS discount, p_size % 5 > 0 AS in_stock,
  'size:Small $5.50:5.5|size:Large:0.0|size:XL:0.0' AS variants,
  'https://acme.example.com//cdn.shop.example.com/product-' || p_partkey || '.jpg|https://acme.example.com/helmet-'
    || p_partkey || '.png' AS images,
  CASE WHEN p_size % 4 > 0 THEN 'All about ' || p_name ELSE trim(repeat('The ' || p_name || ' helmet. ', 9)) END
    AS full_text,
  'Size=' || p_size || ';Type=' || p_type AS specs,
  CAST(CASE WHEN p_size % 4 > 0 AND length('All about ' || p_name) <= 20 THEN 0.8 ELSE 1 END AS DOUBLE) AS score
FROM part
""")
def extract_shopify(spark, sf):
    reader = ShopifyAdapter({}, {}, F.col("site"), F.lit("https://acme.example.com"))
    found = _extracted(shopify_pages(spark, sf), reader)
    return found.select(
        "p_partkey", "p.id", "p.name", "p.brand", "p.sku", "p.category", "p.price.regular", "p.price.sale",
        F.col("p.price.discount_percentage").alias("discount"), "p.availability.in_stock",
        F.array_join(
            F.transform(
                "p.variants",
                lambda v: F.concat_ws(":", v["type"], v["value"], v["price"]["regular"].cast("string")),
            ),
            "|",
        ).alias("variants"),
        F.array_join("p.images", "|").alias("images"),
        F.col("p.description.full").alias("full_text"),
        _map_text("p.description.specifications").alias("specs"),
        F.col("p.metadata.scrape_quality_score").alias("score"),
    )


def _map_text(c: str):
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        ),
        ";",
    )


@query("""
SELECT p_partkey, 'acme-' || p_partkey AS id, 'Shoei ' || p_name AS name,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Unknown' END AS brand,
  CASE WHEN p_size % 3 = 0 THEN CAST(format('{:.2f}', p_retailprice)
    || CAST(floor(floor(p_retailprice / 2 * 100 + 0.5) / 100) AS BIGINT) AS DOUBLE) ELSE p_retailprice END AS regular,
  p_size % 5 > 0 AS in_stock, ':Select one|s:Small $5.50|l:Large|s2:Small $5.50' AS variants,
  'https://cdn.shop.example.com/product-' || p_partkey || '.jpg|https://acme.example.com/helmet-' || p_partkey
    || '.png|https://acme.example.com/logo-helmet.png' AS images
FROM part
""")
def extract_raw_shopify(spark, sf):
    """Raw records of product pages, then the normaliser."""
    reader = ShopifyAdapter({}, {}, F.col("site"), F.lit("https://acme.example.com"))
    raw = read(shopify_pages(spark, sf), lambda p: [
        "p_partkey", _present(reader.extract_raw(F.col("url"), p)).alias("r")
    ])
    records = raw.select("p_partkey", "r.*")
    # Two amounts in one price text run together in the numeric price, up to the second point.
    products = normalize_products(records, "acme", AS_OF, ["p_partkey"])
    shown = F.transform(
        "variants",
        lambda v: F.concat(
            F.when(v["id"].startswith("variant-"), F.lit("")).otherwise(v["id"]), F.lit(":"), v["value"]
        ),
    )
    return products.select(
        "p_partkey", "id", "name", "brand", "price.regular", "availability.in_stock",
        F.array_join(shown, "|").alias("variants"), F.array_join("images", "|").alias("images"),
    )


@query("""
SELECT p_partkey, p_size % 5 > 0 AS in_stock, 3 AS n_variants, 3 AS n_images, 4 AS n_raw, 2 AS n_specs,
  p_size % 4 = 0 AS long_text FROM part
""")
def page_parts(spark, sf):
    """Stock, variants, images, specifications and description of a page, each on its own."""
    u = F.col("url")

    def n(c):
        return F.size(c).cast("bigint")

    return read(shopify_pages(spark, sf), lambda p: [
        "p_partkey",
        page_in_stock(p).alias("in_stock"),
        n(page_variants(p, F.lit("x"))).alias("n_variants"),
        n(raw_images(p, u)).alias("n_images"),
        n(raw_variants(p)).alias("n_raw"),
        n(extract_specs(p)).alias("n_specs"),
        (F.length(page_description(p)) > 100).alias("long_text"),
    ])


def mcas_pages(spark, sf):
    """A product page per part in the custom-shop style."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    name = F.when(
        size % 9 > 0, _join('<h2 class="product-name">', F.col("p_name"), "</h2>")
    ).otherwise(F.lit('<h2 class="product-name"> </h2>'))
    sale = F.when(
        size % 3 == 0,
        _join('<b class="sale-price">', money_text(F.col("p_retailprice") * 0.9), "</b>"),
    ).otherwise(F.lit(""))
    stock = (
        F.when(size % 4 == 0, F.lit("Sold out"))
        .when(size % 4 == 1, _join(size.cast("string"), " in stock"))
        .when(size % 4 == 2, F.lit("Backorder"))
        .otherwise(F.lit("Pre-order"))
    )
    html = _join(
        '<body><ul><li class="breadcrumb-item">Home<li class="breadcrumb-item">Big  ', F.col("p_type"),
        '<li class="breadcrumb-item">This</ul><div class="product-details">', name,
        '<i class="brand-name">', F.col("p_brand"), '</i><i class="current-price">',
        money_text(F.col("p_retailprice")), "</i>", sale, '<p class="stock-indicator">', stock,
        '<p class="product-sku">M', key, '<div class="product-image"><img src="/i/', key,
        '.jpg"><img alt="none"></div><p class="product-summary">Short ', F.col("p_name"),
        '<div class="product-description">Long <b>', F.col("p_name"),
        '</b></div><ul class="feature-list"><li>Light<li> <li>Strong</ul>'
        '<p class="certifications">ECE 22.05, dot and AS/NZS 1698</p>'
        '<p class="fits">Honda motorcycle, honda bike</p></div></body>',
    )
    return busy_table(spark, sf, "part").select(
        "p_partkey",
        _join("https://mega.example.com/product/part-", key, "?x=1").alias("url"),
        F.lit("mega").alias("site"),
        html.alias("html"),
    )


@query("""
SELECT p_partkey, 'mega-part-' || p_partkey AS id,
  CASE WHEN p_size % 9 > 0 THEN p_name ELSE 'Unknown Product' END AS name, p_brand AS brand,
  'M' || p_partkey AS sku, 'big-' || lower(p_type) AS category, p_retailprice AS regular,
  CASE WHEN p_size % 3 = 0 THEN floor(p_retailprice * 0.9 * 100 + 0.5) / 100 END AS sale,
  p_size % 4 = 1 AS in_stock, CASE WHEN p_size % 4 = 1 THEN p_size END AS quantity,
  CASE p_size % 4 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'in_stock' WHEN 2 THEN 'backorder' ELSE 'preorder' END
    AS stock_status,
  '/i/' || p_partkey || '.jpg' AS images, 'Short ' || p_name AS short, 'Long ' || p_name AS full_text,
  'Light|Strong' AS features, 'DOT|ECE|AS/NZS 1698' AS certifications, 'motorcycle|bike' AS vehicle_types,
  'honda' AS makes
FROM part
""")
def extract_mcas(spark, sf):
    reader = McasAdapter({}, {}, F.col("site"), F.lit("https://mega.example.com"))
    found = _extracted(mcas_pages(spark, sf), reader)
    return found.select(
        "p_partkey", "p.id", "p.name", "p.brand", "p.sku", "p.category", "p.price.regular", "p.price.sale",
        "p.availability.in_stock", F.col("p.availability.quantity").cast("int").alias("quantity"),
        "p.availability.stock_status",
        F.array_join("p.images", "|").alias("images"),
        F.col("p.description.short").alias("short"),
        F.col("p.description.full").alias("full_text"),
        F.array_join("p.description.features", "|").alias("features"),
        F.array_join("p.certifications", "|").alias("certifications"),
        F.array_join("p.compatibility.vehicle_types", "|").alias("vehicle_types"),
        F.array_join("p.compatibility.makes", "|").alias("makes"),
    )


def generic_pages(spark, sf):
    """A page per part of an unknown shop: structured data, loose markup, or nothing to find."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    offer = F.when(
        size % 4 == 0,
        _join('{"lowPrice":"', F.col("p_retailprice").cast("string"), '","highPrice":1234.5}'),
    ).otherwise(
        _join('{"price":', F.col("p_retailprice").cast("string"),
              ',"availability":"https://schema.org/InStock"}')
    )
    data = _join(
        '{"@type":"Product","name":"', F.col("p_name"), '","brand":{"name":"', F.col("p_brand"),
        '"},"mpn":"P', key, '","image":["https://x.example.com/a.jpg","https://x.example.com/b.jpg"],',
        '"offers":', offer, ',"description":"Fine ', F.col("p_name"),
        '","additionalProperty":[{"name":"size","value":', size.cast("string"), "}]}",
    )
    structured = _join(
        '<script type="application/ld+json">{broken</script><script type="application/ld+json">',
        F.when(size % 2 == 0, _join('[{"@type":"WebPage"},', data, "]")).otherwise(data), "</script>",
    )
    loose = _join(
        '<h1 class="title">', F.col("p_name"), '</h1><em class="vendor">', F.col("p_brand"),
        '</em><span class="price-box">Free</span><span class="amount">',
        money_text(F.col("p_retailprice")), '</span><div class="gallery-main">'
        "<img src='https://x.example.com/1.jpg'><img src='rel.jpg'><img src='https://x.example.com/1.jpg'></div>"
        '<div class="description">tiny</div><div class="item-details">A rather long text on ',
        F.col("p_name"), "</div>",
    )
    body = F.when(size % 3 == 0, structured).when(size % 3 == 1, loose).otherwise(
        F.lit("<p>nothing here</p>")
    )
    return busy_table(spark, sf, "part").select(
        "p_partkey",
        _join("https://other.example.com/item/part-", key).alias("url"),
        F.lit("other").alias("site"),
        _join("<html><body>", body, "</body></html>").alias("html"),
    )


GENERIC_SQL = """
SELECT p_partkey, 'other-part-' || p_partkey AS id, p_name AS name, p_brand AS brand,
  CASE WHEN p_size % 3 = 0 THEN 'P' || p_partkey END AS sku, p_retailprice AS regular,
  CASE WHEN p_size % 12 = 0 THEN 1234.5 END::DOUBLE AS sale, p_size % 12 > 0 AS in_stock,
  CASE WHEN p_size % 3 = 0 THEN 'https://x.example.com/a.jpg|https://x.example.com/b.jpg'
    ELSE 'https://x.example.com/1.jpg' END AS images,
  CASE WHEN p_size % 3 = 0 THEN 'Fine ' || p_name ELSE 'A rather long text on ' || p_name END AS full_text,
  CASE WHEN p_size % 3 = 0 THEN 'size: ' || p_size ELSE '' END AS features
FROM part WHERE p_size % 3 < 2
"""


@query(GENERIC_SQL)
def extract_generic(spark, sf):
    reader = GenericAdapter({}, {}, F.col("site"), F.lit("https://other.example.com"))
    found = _extracted(generic_pages(spark, sf), reader)
    return found.select(
        "p_partkey", "p.id", "p.name", "p.brand", "p.sku", "p.price.regular", "p.price.sale",
        "p.availability.in_stock",
        F.array_join("p.images", "|").alias("images"),
        F.col("p.description.full").alias("full_text"),
        F.array_join("p.description.features", "|").alias("features"),
    )


@query("""
SELECT p_partkey, p_size % 3 = 0 AS structured, p_size % 3 = 1 AS loose FROM part
""")
def extract_generic_parts(spark, sf):
    """Which of the two generic ways finds a product."""
    reader = GenericAdapter({}, {}, F.col("site"), F.lit("https://other.example.com"))
    u, now = F.col("url"), F.lit(AS_OF).cast("timestamp")
    return read(generic_pages(spark, sf), lambda p: [
        "p_partkey",
        reader.extract_jsonld(u, p, now).isNotNull().alias("structured"),
        reader.extract_heuristic(u, p, now).isNotNull().alias("loose"),
    ])


# --- listing pages written from orders -----------------------------------------------------------

LISTS_SQL = """
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity) AS n, l_partkey, l_extendedprice FROM lineitem)
"""


def listing_pages(spark, sf):
    """A listing page per order; its lines are the products. The order picks the shop style."""
    line = F.struct(
        F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("c"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("e"),
    )
    lists = spread_by(table(spark, sf, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(line)).alias("lines")
    )
    style = F.col("l_orderkey") % 3
    word = F.when(style == 0, F.lit("products")).otherwise(F.lit("product"))
    boxes = F.array_join(
        F.transform(
            "lines",
            lambda x: F.concat(
                F.lit('<div class="product-grid-item product-item"><a href="/'), word, F.lit("/part-"),
                x["part"].cast("string"), F.lit('?utm_source=grid"><i class="product-image"><img src="https://x.example.com/'),
                x["part"].cast("string"), F.lit('.jpg"></i></a><div class="product-name">Part '),
                x["part"].cast("string"), F.lit('</div><span class="brand-name">Acme</span>'),
                F.lit('<span class="current-price price">'), money_text(x["price"]), F.lit("</span></div>"),
            ),
        ),
        "",
    )
    host = (
        F.when(style == 0, F.lit("acme")).when(style == 1, F.lit("mega")).otherwise(F.lit("other"))
    )
    path = (
        F.when(style == 0, F.lit("/collections/o-"))
        .when(style == 1, F.lit("/category/o-"))
        .otherwise(F.lit("/browse/o-"))
    )
    key = F.col("l_orderkey").cast("string")
    after = F.when(
        F.col("l_orderkey") % 2 == 0,
        _join('<a class="pagination__next pagination-next" rel="next" href="', path, key, '?page=2">Next</a>'),
    ).otherwise(F.lit(""))
    html = _join(
        '<html><body><a href="/collections/other">Other</a><div class="collection product-grid">', boxes,
        "</div>", after, "</body></html>",
    )
    return lists.select(
        F.col("l_orderkey").alias("key"), host.alias("site"),
        _join("https://", host, ".example.com", path, key).alias("url"), html.alias("html"),
    )


CONFIGS = [
    {"name": "acme", "base_url": "https://acme.example.com", "adapter_type": "shopify",
     "selectors": {"product_container": ".product-item"}},
    {"name": "mega", "base_url": "https://mega.example.com", "adapter_type": "mcas"},
    {"name": "other", "base_url": "https://other.example.com", "adapter_type": "generic",
     "limits": USUAL_LIMITS},
]

LINKS_SQL = f"""
{LISTS_SQL}, o AS (SELECT DISTINCT l_orderkey, l_orderkey % 3 AS style,
    'https://' || list_extract(['acme', 'mega', 'other'], CAST(l_orderkey % 3 + 1 AS INT)) || '.example.com' AS base,
    list_extract(['/collections/o-', '/category/o-', '/browse/o-'], CAST(l_orderkey % 3 + 1 AS INT)) AS path
  FROM lineitem),
links AS (
  SELECT base || path || l_orderkey AS page_url, 'product' AS kind,
    base || CASE WHEN style = 0 THEN '/products/part-' ELSE '/product/part-' END || l_partkey
      || CASE WHEN style = 0 THEN '?utm_source=grid' ELSE '' END AS link, style, n
  FROM o JOIN l USING (l_orderkey)
  UNION ALL
  SELECT base || path || l_orderkey, 'collection', base || '/collections/other', style, 0 FROM o WHERE style = 0
  UNION ALL
  SELECT base || path || l_orderkey, 'next', base || path || l_orderkey || '?page=2', style, 0 FROM o
  WHERE l_orderkey % 2 = 0)
"""


def _typed_listings(spark, sf):
    routed = ops.route_by_site(listing_pages(spark, sf), ops.site_table(spark, CONFIGS))
    return ops.with_page_type(ops.parse_for(routed, CONFIGS, ("page_type", "discover")), CONFIGS)


@query(f"""
WITH {LINKS_SQL}
SELECT page_url, kind, link, count(*) AS n FROM (
  SELECT DISTINCT page_url, kind, link, CASE WHEN kind = 'product' AND style = 1 THEN n END FROM links)
GROUP BY page_url, kind, link
""")
def discover_links(spark, sf):
    """Product, collection and next-page links of listing pages in three shop styles."""
    found = ops.discover_links(_typed_listings(spark, sf), CONFIGS)
    return ops.explode_links(found).groupBy("page_url", "kind", "link").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"""
WITH {LISTS_SQL}
SELECT l_orderkey AS key, 'Part ' || l_partkey AS name, l_extendedprice AS regular,
  'https://x.example.com/' || l_partkey || '.jpg' AS image, count(*) AS n
FROM l WHERE l_orderkey % 3 = 1 OR (l_orderkey % 3 = 2 AND n <= 20) GROUP BY ALL
""")
def listing_summaries(spark, sf):
    """Product summaries of listing pages; the hosted-shop style has none."""
    return _summaries(spark, sf, CONFIGS)


@query(f"""
WITH {LISTS_SQL}
SELECT l_orderkey AS key, 'Part ' || l_partkey AS name, l_extendedprice AS regular,
  'https://x.example.com/' || l_partkey || '.jpg' AS image, count(*) AS n
FROM l WHERE l_orderkey % 3 > 0 GROUP BY ALL
""")
def listing_summaries_unlimited(spark, sf):
    """All boxes of listing pages, where no site asks for a limit."""
    return _summaries(spark, sf, [{**c, "limits": {}} for c in CONFIGS])


def _summaries(spark, sf, configs):
    outcomes = ops.process_pages(listing_pages(spark, sf), configs, AS_OF)
    return (
        # For the inner form the optimizer would test the list in a filter of its own, which makes all summaries anew.
        outcomes.select("key", F.explode_outer("summaries").alias("s")).where("s IS NOT NULL")
        .groupBy(
            "key", "s.name", F.col("s.price.regular").alias("regular"),
            F.element_at("s.images", 1).alias("image"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def all_pages(spark, sf):
    """Product pages of three shops, listing pages, and a page of an unknown site per nation."""
    stray = table(spark, sf, "nation").select(
        F.lower("n_name").alias("site"),
        _join("https://", F.lower("n_name"), ".example.com/").alias("url"),
        F.lit("<p>hello</p>").alias("html"),
    )
    parts = [
        df.select("site", "url", "html")
        for df in [
            shopify_pages(spark, sf), mcas_pages(spark, sf), generic_pages(spark, sf),
            listing_pages(spark, sf),
        ]
    ]
    out = stray
    for part in parts:
        out = out.unionByName(part)
    return out


def _outcomes(spark, sf):
    """Outcomes of all pages, stored once and read back."""
    path = scratch(spark, "outcomes")
    ops.process_pages(all_pages(spark, sf), CONFIGS, AS_OF).write.parquet(path)
    return spark.read.parquet(path)


@query("""
SELECT site, page_type, success, count(*) AS pages, CAST(sum(p) AS BIGINT) AS products FROM (
  SELECT 'acme' AS site, 'product' AS page_type, true AS success, 1 AS p FROM part
  UNION ALL SELECT 'mega', 'product', true, 1 FROM part
  UNION ALL SELECT 'other', 'product', true, CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END FROM part
  UNION ALL SELECT DISTINCT ON (l_orderkey) list_extract(['acme', 'mega', 'other'],
    CAST(l_orderkey % 3 + 1 AS INT)), 'collection', true, 0 FROM lineitem
  UNION ALL SELECT lower(n_name), NULL, false, 0 FROM nation)
GROUP BY site, page_type, success
""")
def process_all_pages(spark, sf):
    """Routing, page type and extraction of every page in one job, with a result per page."""
    results = ops.results_of(_outcomes(spark, sf))
    return results.groupBy("site", "page_type", "success").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n_products").alias("products")
    )


@query("""
SELECT site, count(*) AS products, CAST(sum(cents) AS BIGINT) AS cents FROM (
  SELECT 'acme' AS site, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM part
  UNION ALL SELECT 'mega', CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) FROM part
  UNION ALL SELECT 'other', CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) FROM part WHERE p_size % 3 < 2)
GROUP BY site
""")
def process_products(spark, sf):
    """Validated products of all pages; listing summaries are never complete, so add none."""
    outcomes = _outcomes(spark, sf)
    partial = ops.complete_summaries(ops.summaries_of(outcomes))
    products = validated(ops.products_of(outcomes)).select("metadata.site", "price.regular")
    both = products.unionByName(partial.select("metadata.site", "price.regular"))
    return both.groupBy("site").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum(F.floor(F.col("regular") * 100 + 0.5)).alias("cents"),
    )


@query("""
SELECT p_partkey, 'p' || p_partkey AS id FROM part
WHERE p_partkey % 8 > 0 AND p_partkey % 7 <> 1 AND p_partkey % 7 <> 2
""")
def summaries_complete(spark, sf):
    """Summaries of parts; those that lack one of the seven fields, or have an empty one, drop out."""
    k = F.col("p_partkey")

    def unless(test, value):
        return F.when(~test, value)

    price = F.struct(F.col("p_retailprice").alias("regular"))
    summaries = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.when(k % 7 == 1, "").otherwise(F.col("p_name")).alias("name"),
        unless(k % 7 == 2, F.col("p_brand")).alias("brand"), F.col("p_type").alias("category"),
        unless(k % 8 == 0, price).alias("price"), F.struct(F.lit(True).alias("in_stock")).alias("availability"),
        F.struct(F.lit("acme").alias("site")).alias("metadata"),
    )
    return ops.complete_summaries(summaries).select("p_partkey", "id")


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'product' WHEN 1 THEN 'collection' WHEN 2 THEN 'search'
    ELSE 'unknown' END AS shopify,
  CASE page_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'search' ELSE 'unknown' END AS mcas,
  CASE page_id % 4 WHEN 0 THEN 'product' WHEN 1 THEN 'collection' WHEN 2 THEN 'search' ELSE 'unknown' END AS generic
FROM pages
""")
def page_types(spark, sf):
    """Page types of the fetched pages by the rules of three platforms."""
    origin = urls.url_origin(F.col("url"))
    path = F.element_at(
        F.array(*map(F.lit, ["/products/x", "/collections/x", "/search?q=x", "/x"])),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    df = fetched(spark, sf).select(
        "page_id", "html", F.concat(origin, path).alias("url"), origin.alias("base_url")
    )
    readers = {"shopify": ShopifyAdapter, "mcas": McasAdapter, "generic": GenericAdapter}
    return read(df, lambda p: [
        "page_id", *[cls().page_type(F.col("url"), p).alias(name) for name, cls in readers.items()]
    ])


@query("""
SELECT page_id, CASE WHEN contains(url, 'http://ththan.example.org') THEN 'a'
    WHEN contains(url, 'https://thther.example.org/en') THEN 'b' ELSE 'rest' END AS site,
  CASE WHEN contains(url, 'http://ththan.example.org') THEN 'shopify'
    WHEN contains(url, 'https://thther.example.org/en') THEN 'mcas' ELSE 'generic' END AS adapter_type
FROM pages
""")
def route_by_url(spark, sf):
    """The first site that can handle a page address; the generic site takes the rest."""
    configs = [
        {"name": "a", "base_url": "http://ththan.example.org", "adapter_type": "shopify"},
        {"name": "b", "base_url": "https://thther.example.org/en", "adapter_type": "mcas"},
        {"name": "rest", "base_url": "https://example.com", "adapter_type": "generic"},
    ]
    pages = table(spark, sf, "pages").select("page_id", "url")
    return ops.route_by_url(pages, ops.site_table(spark, configs), "url", ["page_id"]).select(
        "page_id", "site", "adapter_type"
    )


@query("""
WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages),
s AS (SELECT origin, min(page_id) AS pos, min(page_id) % 3 AS style FROM h GROUP BY origin),
b AS (SELECT pos, origin AS name, CASE style WHEN 0 THEN origin WHEN 1 THEN regexp_replace(origin, '^[a-z]+://', '')
  ELSE substr(regexp_replace(origin, '^[a-z]+://', ''), 2) || '/' END AS base FROM s
  UNION ALL VALUES (100000000000, 'by path', '/es/'), (100000000001, 'by end', 'html'))
SELECT p.page_id, min_by(b.name, b.pos) AS site FROM pages p LEFT JOIN b ON contains(p.url, b.base) GROUP BY p.page_id
""")
def route_by_url_many_sites(spark, sf):
    """Every page origin is a site, with its scheme, without it, or as the end of a host; two are bits of paths."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    origin = urls.url_origin(F.col("url"))
    bare = F.regexp_replace("name", "^[a-z]+://", "")
    style = F.col("pos") % 3
    sites = pages.groupBy(origin.alias("name")).agg(F.min("page_id").alias("pos"))
    base = F.when(style == 0, F.col("name")).when(style == 1, bare).otherwise(F.concat(F.substr(bare, F.lit(2)), F.lit("/")))
    more = spark.createDataFrame(
        [(10**11, "by path", "/es/"), (10**11 + 1, "by end", "html")], "pos long, name string, base_url string"
    )
    dim = sites.select("pos", "name", base.alias("base_url")).unionByName(more)
    routed = ops.route_by_url(pages, dim.withColumn("adapter_type", F.lit("mcas")), "url", ["page_id"], inline_sites=0)
    return routed.select("page_id", "site")
