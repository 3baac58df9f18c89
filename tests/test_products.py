"""Normalising, validating, de-duplicating and merging of records."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwright import schemas
from shelfwright.functions import js, text
from shelfwright.operators import dedup, normalize, validate

NOW = datetime.datetime(2025, 1, 15, 10, 0)
RAW = "name string, title string, brand string, price string, images array<string>, description string, category string, sku string"


def norm(spark, rows, schema=RAW, site="test-site"):
    return normalize.normalize_products(spark.createDataFrame(rows, schema), site, NOW)


def test_basic_record(spark):
    p = norm(spark, [("Test Motorcycle Helmet", None, "B", "$299.99", ["a.jpg"], "d", "helmets", None)]).first()
    assert p["id"] == "test-site-test-motorcycle-helmet"
    assert (p["price"]["regular"], p["price"]["currency"]) == (299.99, "AUD")
    assert p["metadata"]["site"] == "test-site"


def test_missing_fields(spark):
    p = norm(spark, [(None, "Unnamed Product", None, None, None, None, None, None)]).first()
    assert (p["name"], p["brand"], p["price"]["regular"]) == ("Unnamed Product", "Unknown", 0)
    assert (p["category"], p["images"], p["variants"]) == ("uncategorized", [], [])
    assert p["metadata"]["scrape_quality_score"] < 0.5
    assert p["availability"]["in_stock"] is True


def test_full_score(spark):
    row = ("Complete", None, "B", "299.99", ["1.jpg", "2.jpg"], "Full", "helmets", "SKU123")
    assert norm(spark, [row]).first()["metadata"]["scrape_quality_score"] == 1.0


@pytest.mark.parametrize(
    "shown, amount",
    [
        ("$299.99", 299.99), ("AUD $150.00", 150), ("1,299.99", 1299.99), ("89", 89), ("Free", 0), ("", 0),
        ("1,234,567.89", 1234), ("$10 - $20", 1020), ("1.2.3", 1.2), (".5", 0.5),
    ],
)
def test_numeric_price(value, shown, amount):
    assert value(text.numeric_price, c=shown) == amount


def test_numeric_column_price(spark):
    assert norm(spark, [("n", 89.0)], "name string, price double").first()["price"]["regular"] == 89


def test_variants(spark):
    schema = "name string, variants array<struct<id:string,title:string,price:double,available:boolean,size:string,color:string>>"
    rows = [("P", [("var1", "Small Red", 100.0, True, "Small", "Red"), (None, None, 120.0, False, "Large", "")])]
    a, b = norm(spark, rows, schema).first()["variants"]
    assert (a["id"], a["name"], a["type"], a["value"], a["price"]["regular"]) == ("var1", "Small Red", "color", "Red", 100)
    # In stock by its flag, but without a quantity its status is out of stock.
    assert a["availability"]["in_stock"] is True and a["availability"]["stock_status"] == "out_of_stock"
    assert (b["id"], b["name"], b["type"], b["value"]) == ("variant-1", "Variant 2", "size", "Large")
    assert b["availability"]["in_stock"] is False


def test_status_words(value):
    # 'unavailable' holds 'available'.
    assert value(text.map_stock_status, c="Unavailable") == "in_stock"
    assert value(text.map_stock_status, c="nothing") == "out_of_stock"


def test_availability_flags(spark):
    # The flag decides in_stock only; any non-empty text counts as true.
    p = norm(spark, [("n", "no", "out_of_stock")], "name string, availability string, stock_status string").first()
    assert (p["availability"]["in_stock"], p["availability"]["stock_status"]) == (True, "in_stock")
    p = norm(spark, [("n", False)], "name string, in_stock boolean").first()
    assert (p["availability"]["in_stock"], p["availability"]["stock_status"]) == (False, "in_stock")


def test_id_falls_back_to_content_hash(spark):
    schema = "product_name string, price string, brand string"
    a, b, c = norm(spark, [("x", "1", "B"), ("y", "1", "B"), ("x", "2", "B")], schema).select("id").collect()
    assert a["id"] == b["id"] != c["id"] and a["id"].startswith("test-site-")


def test_cents_and_discount(value):
    assert value(lambda c: js.cents(c.cast("double")), c="1.005") == 1.0
    assert value(lambda c: js.cents(c.cast("double")), c="2.5") == 2.5
    pct = lambda m: lambda r, s: text.discount_pct(r.cast("double"), s.cast("double"), m)
    assert value(pct("validator"), r="100", s="75") == 25
    assert value(pct("validator"), r="100", s="100") is None
    assert value(pct("shopify"), r="100", s="150") == -50
    assert value(pct("shopify"), r="0", s="5") is None


def test_wide_space_and_category(value):
    nbsp = chr(0xA0)
    assert value(js.collapse_space, c=f"{nbsp} a\t\n b{nbsp}c ") == "a b c"
    assert value(text.normalize_category, c="  Men's  Full-Face & Helmets! ") == "mens-full-face-helmets"


def test_number_text(spark):
    rows = [(100.0, "100"), (299.9, "299.9"), (12345678.9, "12345678.9"), (0.25, "0.25"), (1e7, "10000000")]
    df = spark.createDataFrame(rows, "x double, want string")
    assert all(r[0] == r[1] for r in df.select(js.number_text(F.col("x")), "want").collect())


def product(**over):
    price = {"regular": 10.0, "sale": None, "currency": "AUD", "discount_percentage": None}
    stock = {"in_stock": True, "quantity": 1.0, "stock_status": "in_stock"}
    base = dict.fromkeys(schemas.PRODUCT.fieldNames())
    base.update(
        id="1", name=" A  b ", brand="B", category="Cat & Dog", price=price, availability=stock, variants=[],
        images=["https://e.com/a b.jpg", "nope", "https://e.com/a%20b.jpg"],
        description={"short": "s", "full": None, "features": [" x  y "], "specifications": {"k ": "v", " k": "w"}},
        certifications=["ce", " CE ", ""], metadata={"scraped_at": NOW, "source_url": "", "site": "s"},
    )
    base.update(over)
    return base


def test_validate_and_clean(spark):
    bad_price = {"regular": float("nan"), "sale": None, "currency": "USD", "discount_percentage": None}
    df = spark.createDataFrame([product(), product(id="2", name=None, price=bad_price)], schemas.PRODUCT)
    valid, rejects = validate.validate_products(df)
    p = valid.first()
    assert (p["name"], p["category"], p["images"]) == ("A b", "cat-dog", ["https://e.com/a%20b.jpg"])
    assert p["description"]["features"] == ["x y"]
    assert p["description"]["specifications"] == {"k": "w"}
    assert p["certifications"] == ["CE"]
    assert rejects.first()["errors"] == [
        "name: Invalid input: expected string, received undefined",
        "price.regular: Invalid input: expected number, received NaN",
        'price.currency: Invalid input: expected "AUD"',
    ]


def test_invalid_variant_fails_product(spark):
    v = {
        "id": "v", "name": "n", "type": "shape", "value": "x",
        "price": {"regular": 1.0, "currency": "AUD"},
        "availability": {"in_stock": True, "stock_status": "in_stock"},
    }
    df = spark.createDataFrame([product(variants=[v])], schemas.PRODUCT)
    assert validate.validated(df).count() == 0
    assert df.select(validate.validate_variants(F.col("variants")).alias("v")).first()["v"] == []


def test_bad_time_text(spark):
    df = spark.createDataFrame([product()], schemas.PRODUCT)
    as_text = df.withColumn("metadata", F.col("metadata").withField("scraped_at", F.lit("yesterday")))
    assert validate.with_product_errors(as_text).first()["errors"] == ["metadata.scraped_at: Invalid input"]
    good = df.withColumn("metadata", F.col("metadata").withField("scraped_at", F.lit("2025-01-15T10:00:00.000Z")))
    assert validate.with_product_errors(good).first()["errors"] == []


def test_dedup_and_merge(spark):
    rows = [(1, "A", "b", 1.0, None), (2, "A", "b", 1.0, None), (3, "A", "b", 1.0, "s")]
    df = spark.createDataFrame(rows, "seq int, name string, brand string, price double, sku string")
    assert [r["seq"] for r in dedup.dedup_content(df, "seq").orderBy("seq").collect()] == [1, 3]
    schema = "k int, o int, name string, price struct<regular:double>, images array<string>, m map<string,string>"
    parts = [
        (1, 2, "Second", (5.0,), ["c"], {"a": "2", "b": "2"}), (1, 1, "", None, ["a", "b"], {"a": "1"}),
        (1, 3, None, (6.0,), None, None), (2, 1, None, None, None, None),
    ]
    merged = dedup.merge_partials(spark.createDataFrame(parts, schema), "k", "o").orderBy("k").collect()
    # An earlier empty text wins over a later one; only null is skipped.
    assert merged[0].asDict(True) == {
        "k": 1, "name": "", "price": {"regular": 5.0}, "images": ["a", "b", "c"], "m": {"a": "1", "b": "2"},
    }
    assert merged[1].asDict(True) == {"k": 2, "name": None, "price": None, "images": None, "m": None}


def test_first_per_key_limits_before_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id")
    plan = dedup.dedup_by_key(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_paths(spark):
    df = spark.createDataFrame([(7, [("x", 1.5)], [])], "id int, vs array<struct<n:string,p:double>>, e array<string>")
    got = {(r["path"], r["value"]) for r in normalize.flatten_paths(df, "id").collect()}
    assert got == {("id", "7"), ("vs[0].n", "x"), ("vs[0].p", "1.5"), ("e", "[]")}


def test_marks(value):
    assert value(text.infer_brand, c="Joe Rocket jacket") == "Joe Rocket"
    assert value(text.infer_brand, c="Foxy gloves") is None
    assert value(text.extract_certifications, c="dot, CE and ce, AS/NZS 1698.1") == ["CE", "DOT", "AS/NZS 1698.1"]
    stock = value(text.parse_stock_text, c="12 In Stock")
    assert (stock["in_stock"], stock["quantity"], stock["stock_status"]) == (True, 12, "in_stock")
    assert value(text.parse_stock_text, c=None)["stock_status"] == "in_stock"
    price = value(text.parse_price, c="Was $1,299.50 now $999")
    assert (price["regular"], price["sale"]) == (1299.5, 999)
    assert value(text.parse_price, c="Call")["regular"] == 0
    blocked = value(text.is_blocked, t="Please solve the CAPTCHA", u="https://e.com/403")
    assert blocked["reason"] == "Detected blocking indicator: captcha"
