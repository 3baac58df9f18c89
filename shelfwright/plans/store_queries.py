"""Relational form, exports and stored files."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from shelfwright import schemas
from shelfwright.functions import js
from shelfwright.operators import relational
from shelfwright.operators.monitor import side_by_side
from shelfwright.plans.derive import (
    AS_OF, LINES_SQL, RAW_SQL, normalized_parts, order_products,
)
from shelfwright.plans.registry import query, table
from shelfwright.session import checkpoint_dir
from shelfwright.sources import logs as log_files
from shelfwright.sources import products as files
from shelfwright.sources import sites as site_files
from shelfwright.sources.store import ProductStore


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint space of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_products(spark, sf):
    """``rich_products`` written once: five tables are cut from them, each by its own scan."""
    path = scratch(spark, "rich")
    rich_products(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def rich_products(spark, sf, every: int = 1):
    """Order products with images, specifications, lists and variant images; on demand those of every n-th order key.

    Variants are numbered within their product, so their ids repeat from product to product.
    """
    key = F.col("o_orderkey").cast("string")
    products = order_products(spark, sf, keep=["o_orderkey"], every=every)
    url = F.concat(F.lit("https://img.example.com/"), key)
    variants = F.transform(
        "variants",
        lambda v, i: v.withField(
            "id", F.concat(F.lit("variant-"), i.cast("string"))
        ).withField(
            "images", F.when(v["type"] == "color", F.array(F.concat(url, F.lit("-c")), v["id"]))
        ),
    )
    specs = F.create_map(F.lit("order"), key, F.lit("lines"), F.size("variants").cast("string"))
    stamp = F.timestamp_seconds(F.lit(1736935200) + F.col("o_orderkey"))
    return products.withColumns(
        {
            "variants": variants,
            "images": F.when(
                F.col("o_orderkey") % 3 > 0, F.array(F.concat(url, F.lit("/b")), F.concat(url, F.lit("/a")))
            ).otherwise(F.col("images")),
            "description": F.col("description").withField("specifications", specs),
            "certifications": F.array(F.lit("CE"), F.lit("DOT")),
            "price": F.col("price").withField("sale", F.lit(0.0)),
            "metadata": F.col("metadata").withField("scraped_at", stamp),
        }
    )


@query("""
SELECT 'acme-O-' || o_orderkey AS id, 'Order ' || o_orderkey AS name, 'Acme' AS brand, 'O-' || o_orderkey AS sku,
  'uncategorized' AS category, CAST(NULL AS VARCHAR) AS subcategory,
  o_totalprice AS regular_price, CAST(NULL AS DOUBLE) AS sale_price, 'AUD' AS currency, CAST(NULL AS INT) AS discount_percentage,
  true AS in_stock, 'in_stock' AS stock_status, CAST(NULL AS INT) AS quantity, CAST(NULL AS VARCHAR) AS short_description,
  CAST(NULL AS VARCHAR) AS full_description, 'CE;DOT' AS certifications, CAST(NULL AS BOOLEAN) AS compliance_adr,
  '' AS compliance_standards, '' AS vehicle_types, '' AS makes, '' AS models, 'acme' AS site, '' AS source_url,
  CAST(0.6 AS DOUBLE) AS quality_score,
  strftime(to_timestamp(1736935200 + o_orderkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS scraped_at
FROM orders
""")
def tables_products(spark, sf):
    products = relational.to_relational(rich_products(spark, sf))["products"]
    lists = ["certifications", "compliance_standards", "vehicle_types", "makes", "models"]
    shown = {c: F.array_join(c, ";") for c in lists} | {"scraped_at": js.iso_utc(F.col("scraped_at"))}
    return products.select(*[shown.get(c, F.col(c)).alias(c) for c in products.columns])


@query("""
SELECT 'acme-O-' || o_orderkey AS product_id, unnest([0, 1]) AS image_order,
  'https://img.example.com/' || o_orderkey || '/' || unnest(['b', 'a']) AS image_url
FROM orders WHERE o_orderkey % 3 > 0
""")
def tables_images(spark, sf):
    return relational.to_relational(rich_products(spark, sf))["product_images"]


@query("""
WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem
  ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT 'acme-O-' || o_orderkey AS product_id, unnest(['order', 'lines']) AS spec_key,
  unnest([CAST(o_orderkey AS VARCHAR), CAST(n AS VARCHAR)]) AS spec_value FROM n
""")
def tables_specifications(spark, sf):
    return relational.to_relational(rich_products(spark, sf))["product_specifications"]


@query(f"""
WITH {LINES_SQL}
SELECT 'variant-' || pos AS id, 'acme-O-' || o_orderkey AS product_id, name, CAST(NULL AS VARCHAR) AS sku, type, value,
  regular AS regular_price, CAST(NULL AS DOUBLE) AS sale_price, 'AUD' AS currency, CAST(NULL AS INT) AS discount_percentage,
  in_stock, stock_status,
  CASE WHEN quantity > 0 THEN CAST(quantity AS INT) END AS quantity
FROM variants
""")
def tables_variants(spark, sf):
    return relational.to_relational(rich_products(spark, sf))["product_variants"]


@query(f"""
WITH {LINES_SQL}
SELECT 'acme-O-' || o_orderkey AS product_id, 'variant-' || pos AS variant_id, unnest([0, 1]) AS image_order,
  unnest(['https://img.example.com/' || o_orderkey || '-c', id]) AS image_url
FROM variants WHERE type = 'color'
""")
def tables_variant_images(spark, sf):
    return relational.to_relational(rich_products(spark, sf))["variant_images"]


@query(f"""
WITH {LINES_SQL}, v AS (SELECT o_orderkey, count(*) AS n, string_agg('variant-' || pos || '=' || name || '/' || type || '/' || value || '/'
    || CASE WHEN type = 'color' THEN 'https://img.example.com/' || o_orderkey || '-c,' || id ELSE '' END, ';'
    ORDER BY 'variant-' || pos) AS shown
  FROM variants GROUP BY o_orderkey)
SELECT 'acme-O-' || o.o_orderkey AS id, 'Order ' || o.o_orderkey AS name, o_totalprice AS regular,
  CASE WHEN o.o_orderkey % 3 > 0 THEN 'https://img.example.com/' || o.o_orderkey
    || '/b|https://img.example.com/' || o.o_orderkey || '/a' ELSE '' END AS images,
  'lines=' || coalesce(n, 0) || ';order=' || o.o_orderkey AS specs, coalesce(n, 0) AS n_variants,
  coalesce(shown, '') AS variants
FROM orders o LEFT JOIN v ON o.o_orderkey = v.o_orderkey
""")
def tables_round_trip(spark, sf):
    """Nested products to the five tables of a store, and back without a shuffle on their id."""
    store = ProductStore(spark, scratch(spark, "store"))
    store.add(rich_products(spark, sf))
    back = relational.from_relational(store.read())
    shown = F.transform(
        F.array_sort("variants", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)),
        lambda v: F.concat(
            v["id"], F.lit("="), F.concat_ws("/", v["name"], v["type"], v["value"], F.array_join(v["images"], ","))
        ),
    )
    return back.select(
        "id", "name", "price.regular",
        F.array_join("images", "|").alias("images"),
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("description.specifications")),
                lambda e: F.concat(e["key"], F.lit("="), e["value"]),
            ),
            ";",
        ).alias("specs"),
        F.size("variants").cast("bigint").alias("n_variants"),
        F.array_join(shown, ";").alias("variants"),
    )


@query(f"""
WITH {LINES_SQL}, p AS (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 > 0
  UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 4 = 0),
v AS (SELECT o_orderkey, count(*) AS n FROM variants WHERE o_orderkey % 4 > 0 GROUP BY o_orderkey)
SELECT 'acme-O-' || p.o_orderkey AS id, o_totalprice AS regular_price, coalesce(n, 0) AS n_variants,
  CASE WHEN p.o_orderkey % 12 = 0 OR p.o_orderkey % 3 = 0 THEN 0 WHEN p.o_orderkey % 4 = 0 THEN 1
    ELSE 2 END AS n_images
FROM p LEFT JOIN v ON p.o_orderkey = v.o_orderkey
""")
def tables_upsert(spark, sf):
    """Every fourth order comes in three times more; the last has double the price, one image, no variants."""
    last = F.col("turn") == 2
    times = F.element_at(F.array(F.lit(8), F.lit(4), F.lit(2)), F.col("turn") + 1)
    # every fourth order is made again, which is less work than storing all products for it, and once for all turns
    turns = F.explode(F.array(F.lit(2), F.lit(0), F.lit(1)))
    again = rich_products(spark, sf, every=4).withColumn("turn", turns).withColumns(
        {
            "price": F.col("price").withField("regular", F.col("price.regular") * times),
            "images": F.when(last, F.slice("images", 1, 1)).otherwise(F.concat("images", "images")),
            "variants": F.when(last, F.slice("variants", 1, 0)).otherwise(F.col("variants")),
        }
    )

    store = ProductStore(spark, scratch(spark, "store"))
    store.add(rich_products(spark, sf))
    store.add(again, "turn")
    merged = store.read()

    def counted(name: str, alias: str):
        return merged[name].groupBy(F.col("product_id").alias("id")).agg(
            F.count(F.lit(1)).alias(alias)
        )

    zero = F.lit(0).cast("bigint")
    return (
        merged["products"]
        .select("id", "regular_price")
        .join(counted("product_variants", "n_variants"), "id", "left")
        .join(counted("product_images", "n_images"), "id", "left")
        .select(
            "id", "regular_price",
            F.coalesce("n_variants", zero).alias("n_variants"),
            F.coalesce("n_images", zero).alias("n_images"),
        )
    )


def _money(c: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', {c}), '0+$', ''), '\\.$', '')"


_FLAT_SQL = f"""
SELECT id, full_name AS name, full_brand AS brand, coalesce(sku, '') AS sku, full_category AS category, '' AS subcategory,
  {_money("p_retailprice")} AS regular_price, coalesce({_money("sale")}, '') AS sale_price, 'AUD' AS currency,
  '' AS discount_percentage, CAST(in_stock AS VARCHAR) AS in_stock, stock_status, '0' AS quantity,
  CASE WHEN length(full_text) > 150 THEN substr(full_text, 1, 150) || '...' ELSE full_text END AS short_description,
  full_text AS full_description, '' AS specifications, '' AS certifications, '' AS compliance_adr, '' AS compliance_standards,
  '' AS vehicle_types, '' AS makes, '' AS models, 'acme' AS site, source_url,
  '2025-01-15T10:00:00.000Z' AS scraped_at, {_money("score")} AS quality_score,
  coalesce(array_to_string(list_filter(images, lambda x: trim(x) <> ''), '; '), '') AS images
FROM norm
"""


@query(f"WITH {RAW_SQL} {_FLAT_SQL}")
def csv_flat(spark, sf):
    return relational.flatten_for_csv(normalized_parts(spark, sf))


@query(f"""
WITH {LINES_SQL}
SELECT 'acme-O-' || o_orderkey AS id, 'Order ' || o_orderkey AS name, 'Acme' AS brand, 'O-' || o_orderkey AS sku,
  'uncategorized' AS category, '' AS subcategory, {_money("o_totalprice")} AS regular_price, '' AS sale_price, 'AUD' AS currency,
  '' AS discount_percentage, 'true' AS in_stock, 'in_stock' AS stock_status, '0' AS quantity, '' AS short_description,
  '' AS full_description, '' AS specifications, '' AS certifications, '' AS compliance_adr, '' AS compliance_standards,
  '' AS vehicle_types, '' AS makes, '' AS models, 'acme' AS site, '' AS source_url,
  '2025-01-15T10:00:00.000Z' AS scraped_at, '0.6' AS quality_score, '' AS images,
  coalesce(v.id, '') AS variant_id, coalesce(v.name, '') AS variant_name, coalesce(v.type, '') AS variant_type,
  coalesce(v.value, '') AS variant_value, '' AS variant_sku, coalesce({_money("v.regular")}, '') AS variant_regular_price,
  '' AS variant_sale_price, coalesce(CAST(v.in_stock AS VARCHAR), '') AS variant_in_stock,
  coalesce(v.stock_status, '') AS variant_stock_status, '' AS variant_images
FROM orders LEFT JOIN variants v USING (o_orderkey)
""")
def csv_flat_variants(spark, sf):
    return relational.flatten_for_csv(order_products(spark, sf), include_variants=True)


@query(f"WITH {RAW_SQL} {_FLAT_SQL}")
def csv_files(spark, sf):
    """Written as CSV and read back."""
    path = scratch(spark, "csv")
    files.write_products_csv(normalized_parts(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').option("nullValue", "\0").csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query(f"""
WITH {RAW_SQL}
SELECT id, full_name AS name, full_brand AS brand, sku, full_category AS category, p_retailprice AS regular, sale,
  'AUD' AS currency, in_stock, stock_status, full_text,
  coalesce(array_to_string(list_filter(images, lambda x: trim(x) <> ''), '; '), '') AS images, 'acme' AS site, source_url,
  CAST(score AS DOUBLE) AS score, '2025-01-15T10:00:00.000Z' AS scraped_at FROM norm
""")
def json_files(spark, sf):
    """Written as JSON lines and read back; a missing path adds nothing."""
    path = scratch(spark, "json")
    files.write_products_json(normalized_parts(spark, sf), path)
    back = files.read_products_json(spark, path, array_file=False)
    nothing = files.read_products_json(spark, path + "-missing")
    return back.unionByName(nothing).select(
        "id", "name", "brand", "sku", "category", "price.regular", "price.sale", "price.currency", "availability.in_stock",
        "availability.stock_status", F.col("description.full").alias("full_text"), F.array_join("images", "; ").alias("images"),
        "metadata.site", "metadata.source_url", F.col("metadata.scrape_quality_score").alias("score"),
        js.iso_utc(F.col("metadata.scraped_at")).alias("scraped_at"),
    )


@query(f"""
WITH {LINES_SQL}, v AS (SELECT o_orderkey, count(*) AS n FROM variants GROUP BY o_orderkey)
SELECT 'acme-O-' || o_orderkey AS id, o_totalprice AS regular, coalesce(n, 0) AS n_variants
FROM orders LEFT JOIN v USING (o_orderkey)
""")
def tables_files(spark, sf):
    """Five Parquet tables, written and read back to nested products."""
    path = scratch(spark, "tables")
    files.write_relational(relational.to_relational(stored_products(spark, sf)), path)
    back = relational.from_relational(files.read_relational(spark, path))
    return back.select(
        "id", "price.regular", F.size("variants").cast("bigint").alias("n_variants")
    )


@query("""
SELECT unnest(['json', 'tables', 'csv']) AS format, count(*) AS count, true AS success FROM part
""")
def store_all_formats(spark, sf):
    stored = files.store_products(normalized_parts(spark, sf), "all", scratch(spark, "store"))
    return stored.select("format", "count", "success")


@query(f"""
WITH {RAW_SQL}, p AS (SELECT 'p-' || p_partkey AS id, full_name AS name, p_retailprice AS regular, p_partkey FROM norm)
SELECT 'tables' AS format, id, name, CASE WHEN p_partkey % 3 = 0 THEN regular * 2 ELSE regular END AS regular FROM p
UNION ALL SELECT 'json', id, name, regular FROM p WHERE p_partkey % 3 < 2
UNION ALL SELECT 'json', id, name, regular * 2 FROM p WHERE p_partkey % 3 IN (0, 2)
UNION ALL SELECT 'csv', id, name, regular FROM p WHERE p_partkey % 3 < 2
UNION ALL SELECT 'csv', id, name, regular * 2 FROM p WHERE p_partkey % 3 IN (0, 2)
""".replace("regular * 2 FROM p WHERE p_partkey % 3 IN (0, 2)",
            "CASE WHEN p_partkey % 3 = 0 THEN regular * 2 ELSE regular END FROM p WHERE p_partkey % 3 IN (0, 2)"))
def store_two_runs(spark, sf):
    """Two runs that share a third of their products: tables add up, files of both runs stay; all read back."""
    folder = scratch(spark, "runs")
    parts = normalized_parts(spark, sf, keep=["p_partkey"]).withColumn(
        "id", F.concat(F.lit("p-"), F.col("p_partkey").cast("string"))
    )
    third = F.col("p_partkey") % 3
    twice = F.col("price").withField("regular", F.col("price.regular") * F.when(third == 0, 2).otherwise(1))
    runs = [parts.where(third < 2), parts.where(third != 1).withColumn("price", twice)]
    paths = {"json": [], "csv": [], "tables": []}
    for n, run in enumerate(runs):
        stored = files.store_products(
            run.drop("p_partkey"), "all", folder, as_of=datetime(2025, 1, 15 + n, tzinfo=timezone.utc)
        )
        for row in stored.collect():  # a row per format
            paths[row["format"]].append(row["path"])
    columns = ["id", "name", F.col("price.regular").alias("regular")]
    json_rows = spark.read.schema(schemas.PRODUCT).json(paths["json"]).select(*columns)
    csv_rows = spark.read.option("header", True).option("escape", '"').csv(paths["csv"]).select(
        "id", "name", F.col("regular_price").cast("double").alias("regular")
    )
    table_rows = relational.from_relational(files.read_stored(spark, paths["tables"][-1])).select(*columns)
    out = None
    for name, rows in (("tables", table_rows), ("json", json_rows), ("csv", csv_rows)):
        rows = rows.select(F.lit(name).alias("format"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _note_files(spark, sf) -> str:
    """Customer notes as one text file per nation and a list of nations, and the folder they are in."""
    path = scratch(spark, "notes")
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey"), F.format_string("%010d %12.2f", "c_custkey", F.col("c_acctbal").cast("double")).alias("value")
    )
    customers.repartition("c_nationkey").write.partitionBy("c_nationkey").text(f"{path}/notes")
    nations = table(spark, sf, "nation").select(F.to_json(F.struct("n_name", "n_nationkey")).alias("value"))
    nations.coalesce(1).write.text(f"{path}/nations")
    return path


@query("""
SELECT 'txt' AS extension, count(DISTINCT c_nationkey) + 1 AS files,
  CAST(24 * count(*) + (SELECT sum(strlen('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') + 1) FROM nation)
    AS BIGINT) AS total_size FROM customer
""")
def file_stats(spark, sf):
    """Number and bytes of files written from the tables."""
    return files.storage_stats(spark, _note_files(spark, sf)).where("extension = 'txt'")


@query("""
SELECT count(DISTINCT c_nationkey) + 1 AS older_than_an_hour, 0 AS older_than_two FROM customer
""")
def file_ages(spark, sf):
    """Files written now are older than an hour, and no older than two, an hour and a half from now."""
    path = _note_files(spark, sf)
    then = (datetime.now(timezone.utc) + timedelta(minutes=90)).strftime("%Y-%m-%d %H:%M:%S")

    def older(hours: int, alias: str):
        old = files.stale_files(spark, path, then, max_age_hours=hours)
        return old.where("path LIKE '%.txt'").agg(F.count(F.lit(1)).alias(alias))

    return side_by_side(older(1, "older_than_an_hour"), older(2, "older_than_two"))


def event_logs(spark, sf):
    """Events as log entries."""
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", F.lit("error"))
        .when(kind == "signup", F.lit("warn"))
        .when(kind == "purchase", F.lit("info"))
        .otherwise(F.lit("debug"))
    )
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        F.col("props").alias("context"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
    )


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(DISTINCT event_id) AS messages,
  count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY 1
""")
def log_files_by_day(spark, sf):
    """Log entries written as daily JSON lines and read back."""
    path = scratch(spark, "logs")
    log_files.write_logs(event_logs(spark, sf), path)
    back = log_files.read_logs(spark, path)
    return back.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("message").alias("messages"),
        F.count_if(F.col("level") == "error").alias("errors"),
    )


def supplier_configs(spark, sf):
    """Site configurations of suppliers, some with broken values."""
    k, name = F.col("s_suppkey"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", ""))
    kind = F.element_at(
        F.array(*map(F.lit, ["shopify", "mcas", "generic", "other"])), (k % 4 + 1).cast("int")
    )
    host = F.concat(F.lit("https://"), name, F.lit(".example.com"))
    selectors = [
        F.lit(f".{n}").alias(n)
        for n in ["product_container", "product_name", "price", "stock_status", "images"]
    ]
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        name.alias("name"),
        F.when(k % 5 == 0, F.lit("no address")).otherwise(host).alias("base_url"),
        kind.alias("adapter_type"),
        F.struct(
            (k % 40 * 10.0).alias("requests_per_minute"),
            F.lit(2000.0).alias("delay_between_requests"),
            F.when(k % 7 > 0, F.lit(2.0)).alias("concurrent_requests"),
        ).alias("rate_limit"),
        F.array(F.lit("helmets")).alias("categories"),
        F.struct(*selectors).alias("selectors"),
        F.struct(
            F.lit("/c/*").alias("product_list_pattern"), F.lit("/p/*").alias("product_page_pattern")
        ).alias("navigation"),
        F.when(k % 2 == 0, F.struct(F.lit(False).alias("use_stealth"))).alias("anti_detection"),
    )


@query("""
WITH c AS (SELECT s_suppkey AS k, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name FROM supplier),
e AS (SELECT name, k, list_filter([
  CASE WHEN k % 5 = 0 THEN 'base_url: Invalid URL' END,
  CASE WHEN k % 4 = 3 THEN
    'adapter_type: Invalid option: expected one of "shopify"|"mcas"|"generic"' END,
  CASE WHEN k % 40 = 0 THEN 'rate_limit.requests_per_minute: Too small: expected number to be >=1' END,
  CASE WHEN k % 40 > 30 THEN 'rate_limit.requests_per_minute: Too big: expected number to be <=300' END,
  CASE WHEN k % 7 = 0 THEN
    'rate_limit.concurrent_requests: Invalid input: expected number, received undefined' END
  ], lambda x: x IS NOT NULL) AS errors FROM c)
SELECT name, array_to_string(errors, '; ') AS errors, CASE WHEN len(errors) = 0 AND k % 2 = 0 THEN false END
  AS use_stealth, CASE WHEN len(errors) = 0 AND k % 2 = 0 THEN true END AS rotate_user_agents
FROM e
""")
def site_config_files(spark, sf):
    """Configurations written as ``{"sites": {…}}`` and as bare ``{…}`` files, read and checked."""
    path = scratch(spark, "sites")
    rows = supplier_configs(spark, sf)
    columns = [c for c in rows.columns if c != "s_suppkey"]
    # A file holds one JSON document, so a row becomes a file: some hundreds of sites each.
    number = F.floor(F.col("s_suppkey") / 200)
    sites = rows.groupBy(number.alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("name"), F.struct(*columns)))).alias("sites")
    )
    wrapped, bare = F.to_json(F.struct("sites")), F.to_json("sites")
    body = F.when(F.col("part") % 2 == 0, wrapped).otherwise(bare)
    sites.select("part", body.alias("value")).write.partitionBy("part").text(path)
    valid, invalid = site_files.read_site_configs(spark, path + "/*/*.txt")
    switches = ["use_stealth", "rotate_user_agents"]
    good = valid.select("name", F.lit("").alias("errors"), *[f"anti_detection.{s}" for s in switches])
    bad = invalid.select(
        "name", F.array_join("errors", "; ").alias("errors"),
        *[F.lit(None).cast("boolean").alias(s) for s in switches],
    )
    return good.unionByName(bad)
