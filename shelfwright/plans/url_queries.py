"""Queries over page addresses and addresses derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import urls
from shelfwright.operators import site_urls
from shelfwright.plans.registry import query, table


# Parts of an absolute address, for the SQL side.
PARTS = r"""
parts AS (
  SELECT page_id, url,
    regexp_extract(url, '^([a-z]+:)//', 1) AS protocol,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pathname,
    regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS search,
    regexp_extract(url, '^[^#]*(#.*)$', 1) AS hash
  FROM pages)
"""

_TRACKING = ", ".join(f"'{p}'" for p in K.TRACKING_PARAMS)
_KEPT = f"""
kept AS (
  SELECT *, protocol || '//' || host || pathname AS head,
    list_filter(string_split(substr(search, 2), '&'),
      lambda p: p <> '' AND NOT list_contains([{_TRACKING}], string_split(p, '=')[1])) AS params
  FROM parts),
stripped AS (
  SELECT *, CASE WHEN search = '' THEN url ELSE head
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END || hash
    END AS clean
  FROM kept)
"""


@query(f"""
WITH {PARTS}
SELECT page_id, protocol, host, pathname, search, hash, protocol || '//' || host AS origin
FROM parts
""")
def url_components(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.url_components(F.col("url")).alias("c")
    ).select("page_id", "c.*")


@query(rf"""
WITH {PARTS}
SELECT page_id, host AS domain, protocol <> '' AND host <> '' AS valid,
  regexp_matches(pathname, '/products/|/product/|/item/|/p/|/gear/') AS is_product,
  regexp_matches(pathname,
    '/collections/|/collection/|/category/|/categories/|/shop/|/browse/') AS is_collection,
  host <> regexp_replace(host, '^(www|blog|m)\.', '') AS is_external
FROM parts
""")
def url_flags(spark, sf):
    plain = F.regexp_replace(F.col("url"), r"//(www|blog|m)\.", "//")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.url_domain(F.col("url")).alias("domain"),
        urls.is_valid_url(F.col("url")).alias("valid"),
        urls.is_product_url(F.col("url")).alias("is_product"),
        urls.is_collection_url(F.col("url")).alias("is_collection"),
        urls.is_external_url(F.col("url"), plain).alias("is_external"),
    )


# Addresses of many forms, one per customer.
_PATHS = [
    "/collections/helmets", "/category/jackets?page=2", "/shop/boots/item-1", "/browse/gear#top",
    "/products/helmet", "/p/12", "/gear/gloves", "/about",
]


def _customer_urls(spark, sf):
    key = F.col("c_custkey")
    hosts = [*K.HOST_SITES, "shop.example.com", "www.example.org:8080"]
    pick_host = F.element_at(F.array(*map(F.lit, hosts)), (key % len(hosts) + 1).cast("int"))
    pick_path = F.element_at(
        F.array(*map(F.lit, _PATHS)), (F.floor(key / len(hosts)) % len(_PATHS) + 1).cast("int")
    )
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("https://"), pick_host, pick_path).alias("url")
    )


_HOSTS_SQL = ", ".join(f"'{h}'" for h in [*K.HOST_SITES, "shop.example.com", "www.example.org:8080"])
_PATHS_SQL = ", ".join(f"'{p}'" for p in _PATHS)
CUSTOMER_URLS = f"""
urls AS (
  SELECT c_custkey,
    list_extract([{_HOSTS_SQL}], CAST(c_custkey % 10 + 1 AS INT)) AS host,
    list_extract([{_PATHS_SQL}], CAST((c_custkey // 10) % 8 + 1 AS INT)) AS tail
  FROM customer)
"""
_SITES_SQL = " ".join(f"WHEN '{h}' THEN '{s}'" for h, s in K.HOST_SITES.items())


@query(rf"""
WITH {CUSTOMER_URLS}
SELECT c_custkey, CASE host {_SITES_SQL} ELSE 'unknown' END AS site,
  regexp_matches(tail, '^[^?#]*(/products/|/product/|/item/|/p/|/gear/)') AS is_product,
  regexp_matches(tail,
    '^[^?#]*(/collections/|/collection/|/category/|/categories/|/shop/|/browse/)') AS is_collection,
  coalesce(nullif(regexp_extract(tail, '/collections/([^/?#]+)', 1), ''),
    nullif(regexp_extract(tail, '/category/([^/?#]+)', 1), ''),
    nullif(regexp_extract(tail, '/shop/([^/?#]+)', 1), ''),
    nullif(regexp_extract(tail, '/browse/([^/?#]+)', 1), ''), 'unknown') AS category
FROM urls
""")
def url_site_and_category(spark, sf):
    return _customer_urls(spark, sf).select(
        "c_custkey",
        urls.site_from_url(F.col("url")).alias("site"),
        urls.is_product_url(F.col("url")).alias("is_product"),
        urls.is_collection_url(F.col("url")).alias("is_collection"),
        urls.category_from_url(F.col("url")).alias("category"),
    )


@query(f"WITH {PARTS}, {_KEPT} SELECT page_id, clean AS stripped FROM stripped")
def url_strip_tracking(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.strip_tracking(F.col("url")).alias("stripped"))


def _origins(spark, sf):
    """One row per page origin: the sites of the page table."""
    return table(spark, sf, "pages").select(
        urls.url_host(F.col("url")).alias("name"), urls.url_protocol(F.col("url")).alias("p")
    ).groupBy("name").agg(F.min("p").alias("p")).select(
        "name", F.concat("p", F.lit("//"), "name").alias("base_url")
    )


ORIGINS = """
origins AS (SELECT host AS name, min(protocol) || '//' || host AS base_url FROM parts GROUP BY host)
"""


@query(rf"""
WITH {PARTS}, {_KEPT}, {ORIGINS}
SELECT page_id, 'absolute' AS form,
  array_to_string(list_transform(string_split(clean, '://'),
    lambda s: regexp_replace(s, '/{{2,}}', '/', 'g')), '://') AS normalized_url,
  CAST(NULL AS VARCHAR) AS error
FROM stripped
UNION ALL
SELECT page_id, 'relative', base_url || pathname || search, NULL
FROM parts JOIN origins ON host = name
UNION ALL
SELECT page_id, 'unknown', NULL, 'Unknown site: no-' || host FROM parts
""")
def url_normalize(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", urls.url_host(F.col("url")).alias("site"))
    relative = F.concat(urls.url_path(F.col("url")), urls.url_search(F.col("url")))
    forms = F.array(
        F.struct(F.lit("absolute").alias("form"), F.col("url").alias("u"), F.col("site").alias("s")),
        F.struct(F.lit("relative").alias("form"), relative.alias("u"), F.col("site").alias("s")),
        F.struct(
            F.lit("unknown").alias("form"), F.col("url").alias("u"),
            F.concat(F.lit("no-"), "site").alias("s"),
        ),
    )
    each = pages.select("page_id", F.explode(forms).alias("x")).select("page_id", "x.*")
    return site_urls.normalize_urls(each, "u", "s", _origins(spark, sf)).select(
        "page_id", "form", "normalized_url", "error"
    )


@query(f"""
WITH {PARTS},
pairs AS (
  SELECT page_id, protocol || '//' || host || pathname AS head,
    list_filter(string_split(substr(search, 2) || '&page=9&a=1+b', '&'), lambda p: p <> '') AS ps
  FROM parts),
firsts AS (
  SELECT page_id, head, list_sort(list_filter(ps, lambda p, i:
    list_position(list_transform(ps, lambda q: string_split(q, '=')[1]), string_split(p, '=')[1]) = i))
    AS ps
  FROM pairs)
SELECT page_id, head || '?' || array_to_string(ps, '&') AS canonical FROM firsts
""")
def url_canonical(spark, sf):
    mark = F.when(urls.url_search(F.col("url")) == "", F.lit("?")).otherwise(F.lit("&"))
    longer = F.concat(
        urls.clean_url(F.col("url")), urls.url_search(F.col("url")), mark, F.lit("page=9&a=1+b"), urls.url_hash(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(longer).alias("canonical"))


@query(f"""
WITH {PARTS}
SELECT page_id, protocol || '//' || host || pathname || hash AS no_params,
  protocol || '//' || host || pathname AS clean,
  protocol || '//' || host || pathname || search AS resolved,
  protocol || '//' || host || pathname AS joined
FROM parts
""")
def url_parts_removed(spark, sf):
    origin = urls.url_origin(F.col("url"))
    bare = F.regexp_replace(urls.url_path(F.col("url")), "^/", "")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.remove_params(F.col("url")).alias("no_params"),
        urls.clean_url(F.col("url")).alias("clean"),
        urls.resolve_url(
            F.concat(origin, F.lit("/")), F.concat(urls.url_path(F.col("url")), urls.url_search(F.col("url")))
        ).alias("resolved"),
        urls.join_url(origin, bare).alias("joined"),
    )


@query(rf"""
WITH {PARTS}
SELECT page_id, protocol || '//' || host || pathname
  || CASE WHEN search = '' THEN '?page=7&utm_medium=e+mail'
     WHEN contains(search, 'page=') THEN regexp_replace(search, 'page=[0-9]+', 'page=7')
       || '&utm_medium=e+mail'
     ELSE search || '&page=7&utm_medium=e+mail' END || hash AS tagged
FROM parts
""")
def url_with_query(spark, sf):
    tagged = urls.with_query(F.col("url"), {"page": "7", "utm_medium": "e mail"})
    return table(spark, sf, "pages").select("page_id", tagged.alias("tagged"))


@query("""
WITH base AS (
  SELECT p_partkey, 'https://shop.example.com/collections/' || lower(p_type) AS u,
    1 + p_size % 4 AS last FROM part),
n AS (SELECT p_partkey, u, CAST(unnest(generate_series(1, last)) AS INT) AS page FROM base)
SELECT p_partkey, page, u || '?page=' || page AS page_url,
  CASE WHEN page = 1 THEN u ELSE u || '?page=' || page END AS shop_url
FROM n
""")
def url_collection_pages(spark, sf):
    base = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("https://shop.example.com/collections/"), F.lower("p_type")).alias("u"),
        (F.lit(1) + F.col("p_size") % 4).alias("last"),
    )
    both = site_urls.collection_urls(base, "u", F.col("last"))
    shop = F.when(F.col("page") == 1, F.col("u")).otherwise(F.col("page_url"))
    return both.select("p_partkey", "page", "page_url", shop.alias("shop_url"))


@query("""
WITH base AS (
  SELECT p_partkey, 'https://shop.example.com/collections/' || lower(p_type) AS u,
    1 + p_size % 4 AS last FROM part),
n AS (SELECT p_partkey, u, CAST(unnest(generate_series(1, last)) AS INT) AS page FROM base)
SELECT p_partkey, page, CASE WHEN page = 1 THEN u ELSE u || '?page=' || page END AS page_url FROM n
""")
def url_collection_pages_bare_first(spark, sf):
    base = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("https://shop.example.com/collections/"), F.lower("p_type")).alias("u"),
        (F.lit(1) + F.col("p_size") % 4).alias("last"),
    )
    return site_urls.collection_urls(base, "u", F.col("last"), bare_first=True).select(
        "p_partkey", "page", "page_url"
    )


@query(f"""
WITH {PARTS}, {ORIGINS}
SELECT name, category, base_url || '/collections/' || category AS category_url
FROM origins, (SELECT unnest(['helmets', 'jackets', 'boots']) AS category)
""")
def url_categories(spark, sf):
    sites = _origins(spark, sf).withColumn(
        "categories", F.array(F.lit("helmets"), F.lit("jackets"), F.lit("boots"))
    )
    return site_urls.category_urls(sites, "base_url", "categories").select(
        "name", "category", "category_url"
    )


@query("""
SELECT p_partkey, 'https://shop.example.com/search?q=' || replace(p_name, ' ', '+') || '&brand='
  || replace(p_brand, '#', '%23') || '&price_min=' || p_size AS search_url
FROM part
""")
def url_search(spark, sf):
    url = urls.search_url(
        F.lit("https://shop.example.com/"),
        F.col("p_name"),
        {"brand": F.col("p_brand"), "price_min": F.col("p_size").cast("string")},
    )
    return table(spark, sf, "part").select("p_partkey", url.alias("search_url"))


@query(f"""
WITH {PARTS}, {ORIGINS}
SELECT name, base_url || path AS sitemap_url FROM origins,
  (SELECT unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml', '/robots.txt']) AS path)
""")
def url_sitemaps(spark, sf):
    return site_urls.sitemap_urls(_origins(spark, sf), "base_url").select("name", "sitemap_url")


def nation_sites(spark, sf):
    """Sites named after nations."""
    slug = F.lower("n_name")
    return table(spark, sf, "nation").select(
        slug.alias("name"), F.concat(F.lit("https://"), slug, F.lit(".example.com")).alias("base_url")
    )


@query("""
SELECT c_custkey, lower(n_name) AS site, 'https://' || lower(n_name) || '.example.com' AS base_url
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def url_site_bases(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("site"))
    customers = table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return site_urls.site_base_urls(
        customers.select("c_custkey", "site"), "site", nation_sites(spark, sf)
    ).select("c_custkey", "site", "base_url")
