import pytest
from pyspark.sql import functions as F

from shelfwright.functions import urls
from shelfwright.operators import site_urls

SHOP = "https://www.motoheaven.com.au"


def test_components(value):
    c = value(urls.url_components, u="https://example.com:8080/path?query=value#fragment")
    assert c.asDict() == {
        "protocol": "https:", "host": "example.com:8080", "pathname": "/path",
        "search": "?query=value", "hash": "#fragment", "origin": "https://example.com:8080",
    }
    relative = value(urls.url_components, u="/a/b?x=1")
    assert (relative["host"], relative["pathname"], relative["search"]) == (None, "/a/b", "?x=1")


@pytest.mark.parametrize(
    "url, valid",
    [("https://example.com", True), ("http://example.com/path", True), ("invalid-url", False), ("", False)],
)
def test_valid(value, url, valid):
    assert value(urls.is_valid_url, u=url) is valid


@pytest.mark.parametrize(
    "url, stripped",
    [
        (f"{SHOP}/products/helmet?utm_source=google&utm_medium=cpc&fbclid=123", f"{SHOP}/products/helmet"),
        ("https://a.com/x?b=1&ref=q&a=2#top", "https://a.com/x?b=1&a=2#top"),
        ("https://a.com/x?q=a%20b&flag", "https://a.com/x?q=a+b&flag="),
        ("HTTPS://a.com/x", "HTTPS://a.com/x"),
        ("https://a.com/x?p=100%", "https://a.com/x?p=100%25"),
    ],
)
def test_strip_tracking(value, url, stripped):
    assert value(urls.strip_tracking, u=url) == stripped


def test_canonical(value):
    url = "https://example.com/products/helmet?z=last&a=first&z=2#section"
    assert value(urls.canonical_url, u=url) == "https://example.com/products/helmet?a=first&z=last"


def test_normalize_by_site(spark):
    sites = spark.createDataFrame([("shop", SHOP)], "name string, base_url string")
    rows = spark.createDataFrame(
        [
            ("/products/helmet", "shop"), (f"{SHOP}//products//helmet?gclid=1", "shop"),
            ("https://example.com", "none"),
        ],
        "url string, site string",
    )
    out = {
        (r["url"], r["normalized_url"], r["error"])
        for r in site_urls.normalize_urls(rows, "url", "site", sites).collect()
    }
    good = f"{SHOP}/products/helmet"
    assert out == {
        ("/products/helmet", good, None), (f"{SHOP}//products//helmet?gclid=1", good, None),
        ("https://example.com", None, "Unknown site: none"),
    }
    with pytest.raises(Exception, match="Unknown site: none"):
        site_urls.normalize_urls(rows, "url", "site", sites, strict=True).collect()


def test_collection_pages(spark):
    df = spark.createDataFrame([(f"{SHOP}/collections/helmets",)], "u string")
    pages = [r["page_url"] for r in site_urls.collection_urls(df, "u", 3).collect()]
    assert pages == [f"{SHOP}/collections/helmets?page={n}" for n in (1, 2, 3)]
    shop = [r["page_url"] for r in site_urls.collection_urls(df, "u", 3, bare_first=True).collect()]
    assert shop == [f"{SHOP}/collections/helmets", *pages[1:]]
    assert site_urls.collection_urls(df, "u", 0).count() == 0


def test_category_and_search(value):
    for url, category in [
        ("https://example.com/collections/helmets?page=2", "helmets"),
        ("https://example.com/category/jackets", "jackets"),
        ("https://example.com/shop/boots", "boots"),
        ("https://example.com/about", "unknown"),
    ]:
        assert value(urls.category_from_url, u=url) == category
    got = value(
        lambda b, q: urls.search_url(b, q, {"brand": "shoei", "price_min": "100"}),
        b="https://example.com", q="motorcycle helmet",
    )
    assert got == "https://example.com/search?q=motorcycle+helmet&brand=shoei&price_min=100"


def test_site_product_and_external(value):
    assert value(urls.site_from_url, u=f"{SHOP}/products/helmet") == "motoheaven"
    assert value(urls.site_from_url, u="https://unknown-site.com/products") == "unknown"
    assert value(urls.is_product_url, u="https://example.com/product/123") is True
    assert value(urls.is_product_url, u="https://example.com/about") is False
    assert value(urls.is_collection_url, u="https://example.com/category/jackets") is True
    assert value(urls.is_external_url, u="https://a.com/x", b="https://a.com") is False
    assert value(urls.is_external_url, u="https://b.com/x", b="https://a.com") is True


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.com:80", "http://example.com/"),
        ("https://e.com/a/./b/../c d?x y#z", "https://e.com/a/c%20d?x%20y#z"),
        ("https://e.com/a/..", "https://e.com/"),
        ("https://e.com/für", "https://e.com/f%C3%BCr"),
        ("/relative.jpg", None),
        ("not an address", None),
        ("data:image/png;base64,AA", "data:image/png;base64,AA"),
    ],
)
def test_web_href(value, url, want):
    assert value(urls.web_href, u=url) == want


@pytest.mark.parametrize(
    "href, want",
    [
        ("/x", "https://e.com/x"), ("x", "https://e.com/a/x"), ("../x", "https://e.com/x"),
        ("//f.com/x", "https://f.com/x"), ("?q=1", "https://e.com/a/b?q=1"),
        ("https://g.com", "https://g.com/"), ("#t", "https://e.com/a/b?p=1#t"),
    ],
)
def test_page_href(value, href, want):
    assert value(urls.page_href, p="https://e.com/a/b?p=1#s", h=href) == want


def test_addresses_in_normal_form_take_the_short_way(spark):
    """What the short patterns let through is what the general rules leave as it is."""
    links = [
        "https://e.com/x", "http://e.com:80/x", "https://E.com/x", "https://e.com/a//b", "https://e.com/a/../b", "https://e.com/a/.", "https://e.com/.a?x=/../",
        "https://e.com/a b", "https://e.com/ü", "https://e.com/a\\b", "https://e.com/a?b=\\", "https://e.com", "https://e.com/%zz", "https://e%.com/", "/x?y#z", "x/./y",
        "https://e.com/a#/../b", "https://e.com/x\n", "https://e.com//a://b//c", "HTTP://e.com/x?utm_source=a&b=1", "https://e.com/x?b=1//2",
    ]
    pages = ["https://e.com/a/b?p=1#s", "HTTPS://E.com:443/a/b", "/a/b", "https://e.com/a/../b/", "https://u@e.com/a", None]
    df = spark.createDataFrame([(p, h) for p in pages for h in links], "p string, h string")
    p, h = F.col("p"), F.col("h")
    r = urls.page_href(p, h)
    folder = F.regexp_extract(urls.url_path(p), "(?s)^(.*/)", 1)
    general = urls.page_address(p)
    slow = F.array_join(F.transform(F.split(h, "://"), lambda x: F.regexp_replace(x, "/{2,}", "/")), "://")
    for row in df.select(
        "p", "h", r.alias("r"), F.coalesce(urls.web_href(r), r).alias("w"), general["origin"].alias("o"), urls.url_origin(p).alias("o2"),
        general["path"].alias("q"), urls.url_path(p).alias("q2"), general["protocol"].alias("s"), urls.url_protocol(p).alias("s2"),
        general["folder"].alias("f"), F.when(folder == "", F.lit("/")).otherwise(folder).alias("f2"),
        urls.single_slashes(h).alias("t"), slow.alias("t2"),
        (h.rlike(urls._NORMAL) & (urls.strip_tracking(slow) != h)).alias("bad"), (h.rlike(urls._PLAIN_WEB) & ~urls.web_href(h).eqNullSafe(h)).alias("bad2"),
    ).collect():
        assert (row.r, row.o, row.q, row.s, row.f, row.t) == (row.w, row.o2, row.q2, row.s2, row.f2, row.t2), row
        assert not row.bad and not row.bad2, row


def test_join(value):
    for base, path, want in [
        ("https://e.com/", "/x", "https://e.com/x"), ("https://e.com", "x", "https://e.com/x"),
        ("https://e.com", "/", "https://e.com"), ("https://e.com", "./x", "https://e.com/x"),
    ]:
        assert value(urls.join_url, b=base, p=path) == want


def test_with_query_keeps_place(value):
    got = value(lambda u: urls.with_query(u, {"b": F.lit("new"), "c": "x y"}), u="https://e.com/?a=1&b=2#h")
    assert got == "https://e.com/?a=1&b=new&c=x+y#h"
