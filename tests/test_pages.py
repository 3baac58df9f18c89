"""Parsing, selectors and page readers on hand-made pages."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import nodes
from shelfwright.functions.selectors import Automaton, filled, has_slot, slot
from shelfwright.operators import html
from shelfwright.operators import pages as ops
from shelfwright.operators.html import ParsedPage, parse_pages
from shelfwright.plans.catalogue import QUERIES

NOW = datetime.datetime(2025, 1, 15, 10, 0)
CONFIGS = [
    {"name": "s", "base_url": "https://s.example.com", "adapter_type": "shopify", "selectors": {"product_container": ".item"}},
    {"name": "m", "base_url": "https://m.example.com", "adapter_type": "mcas"},
    {"name": "g", "base_url": "https://g.example.com", "adapter_type": "other"},
]


def test_implied_end_tags():
    page = ParsedPage("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<b>z<div>w</div><table><tr><td>1<td>2<tr><td>3</table>")
    shape = [(tag, page.text[a:b]) for tag, a, b in zip(page.tags, page.t0, page.t1, strict=True)]
    assert shape == [
        ("ul", "abc"), ("li", "a"), ("li", "bc"), ("ul", "c"), ("li", "c"), ("p", "x"), ("p", "yz"), ("b", "z"),
        ("div", "w"), ("table", "123"), ("tr", "12"), ("td", "1"), ("td", "2"), ("tr", "3"), ("td", "3"),
    ]


def test_script_and_entities():
    page = ParsedPage('<script>var t="</p>";</script><p title="a&amp;b">x &lt; y<!-- no --></p>')
    assert page.text == 'var t="</p>";x < y'
    assert page.attrs[1] == {"title": "a&b"}


@pytest.mark.parametrize(
    "selector, hits",
    [
        ("li", 4), (".a", 2), ("li.a", 1), ("#x", 1), ("[data-k]", 1), ("[data-k='v w']", 1), ("[data-k*='v']", 1),
        ("ul li", 3), ("ul > li", 3), (".out ul li", 2), ("h1 + ul", 1), ("h1 ~ ul", 2), ("li:last-child", 3),
        ("li:nth-last-child(2)", 1), ("li.a, #x", 2), ("[class*='a'][class*='b']", 1), ("ol > .zz", 0),
    ],
)
def test_selectors(spark, selector, hits):
    html = (
        '<div class="out"><h1>t</h1><ul><li class="a b">1</li><li data-k="v w">2</li></ul><p id="x"></p>'
        '<ul class="a"></ul></div><ul><li>3</li></ul><ol><li>4</li></ol>'
    )
    page = nodes.Page()
    found = F.size(nodes.select(page, selector))
    df = parse_pages(spark.createDataFrame([(html,)], "html string"), page)
    assert df.select(found).first()[0] == hits


def run(spark, site, path, html):
    url = f"https://{site}.example.com{path}"
    df = spark.createDataFrame([(url, site, html)], "url string, site string, html string")
    return ops.process_pages(df, CONFIGS, NOW).first()


def test_shopify_product(spark):
    html = """<body><div class="breadcrumb">Home &gt; Helmets &gt; This</div><div class="product-form"><h1>AGV K1</h1>
    <span class="price">$300.00 $240.00</span><div class="product-form__input"><label>Colour</label>
    <input type="radio" id="r1" name="opt" value="red"><label for="r1">Red $10.00</label></div>
    <img src="/products/agv-k1.jpg"><img src="/agv-logo.png"></div>
    <ul class="size-chart"><li>M</li><li> </li></ul><button>M</button><p>SKU: AG1</p></body>"""
    p = run(spark, "s", "/products/agv-k1", html)["product"]
    assert (p["id"], p["name"], p["brand"], p["sku"], p["category"]) == ("s-AG1", "AGV K1", "AGV", "AG1", "Helmets")
    assert (p["price"]["regular"], p["price"]["sale"], p["price"]["discount_percentage"]) == (300, 240, 20)
    shown = [(v["type"], v["name"], v["value"], v["price"]["regular"]) for v in p["variants"]]
    assert shown == [("style", "Red", "Red $10.00", 10.0), ("size", "M", "M", 0.0)]
    assert p["images"] == ["https://s.example.com/products/agv-k1.jpg"]
    assert p["availability"]["in_stock"] is False and p["availability"]["stock_status"] == "out_of_stock"


def test_shopify_listing(spark):
    html = """<a href="/collections/b">b</a><a href="/collections/a?x=1">self</a>
    <div class="item"><a href="/products/1">1</a></div><div class="item"><a href="/products/1">1</a></div>
    <div class="item"><a href="/other">-</a></div><a rel="next" href="/collections/a?page=2">n</a>"""
    d = run(spark, "s", "/collections/a", html)["discovery"]
    assert d["product_urls"] == ["https://s.example.com/products/1"]
    assert d["total_products"] == 3
    # Addresses that hold the page's own address are left out.
    assert d["collection_urls"] == ["https://s.example.com/collections/b"]
    assert (d["has_next"], d["next_url"]) == (True, "https://s.example.com/collections/a?page=2")
    loose = run(spark, "s", "/collections/a", '<a href="/products/9">9</a><a href="/products/9">9</a>')
    assert loose["discovery"]["product_urls"] == ["https://s.example.com/products/9"]
    assert loose["discovery"]["has_next"] is False


def test_mcas_product_and_unknown_name(spark):
    html = """<div class="product-name">Glove</div><b class="current-price">$50</b><i class="sale-price">$40</i>
    <p class="stock-indicator">3 available</p><table class="specs-x"></table>
    <div class="product-specs"><table><tr><th>Size</th><td>M</td></tr><tr><th>Size</th><td>L</td></tr></table></div>"""
    p = run(spark, "m", "/product/glove?x=1", html)["product"]
    assert (p["id"], p["brand"], p["category"]) == ("m-glove", "Unknown Brand", "unknown")
    assert (p["price"]["sale"], p["price"]["discount_percentage"], p["availability"]["quantity"]) == (40, 20, 3)
    assert p["description"]["specifications"] == {"Size": "L"}
    assert run(spark, "m", "/product/none", "<p></p>")["product"] is None


@pytest.mark.parametrize(
    "offers, regular, sale, in_stock, status",
    [
        ('{"price":"12.50","availability":"https://schema.org/InStock"}', 12.5, None, True, "in_stock"),
        ('{"lowPrice":3,"highPrice":"9.0","availability":"http://schema.org/InStock"}', 3, 9, False, "in_stock"),
        ('[{"price":5}]', 0, None, False, "in_stock"),
        ('{"price":1,"availability":"https://schema.org/BackOrder"}', 1, None, False, "backorder"),
    ],
)
def test_jsonld(spark, offers, regular, sale, in_stock, status):
    html = f"""<script type="application/ld+json">{{"@type":"Organization"}}</script>
    <script type="application/ld+json">[{{"@type":"Thing"}},{{"@type":"Product","name":"N","brand":"plain",
    "manufacturer":{{"name":"Maker"}},"image":"https://e.com/i.jpg","offers":{offers}}}]</script>"""
    p = run(spark, "g", "/item/n", html)["product"]
    assert (p["name"], p["brand"], p["images"]) == ("N", "Maker", ["https://e.com/i.jpg"])
    assert (p["price"]["regular"], p["price"]["sale"]) == (regular, sale)
    assert (p["availability"]["in_stock"], p["availability"]["stock_status"]) == (in_stock, status)


def test_generic_types(spark):
    assert run(spark, "g", "/x", '<div class="buy-now">Buy now</div>')["page_type"] == "product"
    assert run(spark, "g", "/x", '<div class="buy-now">hello</div>')["page_type"] == "unknown"
    assert run(spark, "g", "/x", '<ul class="products"></ul>')["page_type"] == "collection"
    assert run(spark, "zz", "/x", "")["error"] == "No configuration found for site: zz"


def test_route_by_url_both_ways(spark):
    rows = [
        (1, "https://a.com/x"), (2, "https://a.com.au/x"), (3, "/rel"), (4, "http://q/https://b.com/y"),
        (5, "https://c.com"), (6, "https://bare.example.com/a"), (7, "https://x.net/en/shop/1"), (8, "HTTPS://UP.COM/x"),
        (9, None), (10, "https://seashop.net/"),
    ]
    urls = spark.createDataFrame(rows, "id int, url string")
    bases = [
        "https://a.com/x", "https://a.com", "https://b.com/", "bare.example.com", "/en/shop/", "UP.COM", "shop",
        None, "é", "",
    ]
    for kind in ["mcas", "generic"]:
        for used in (bases[:9], bases):
            sites = spark.createDataFrame(
                [(10**12 + i, f"s{i}", b, "mcas") for i, b in enumerate(used)] + [(10**13, "rest", "https://r.com", kind)],
                "pos long, name string, base_url string, adapter_type string",
            )
            got = [
                {r["id"]: r["site"] for r in ops.route_by_url(urls, sites, "url", ["id"], inline_sites=n).collect()}
                for n in (1000, 0)
            ]
            assert got[0] == got[1]
            rest = "s9" if len(used) == 10 else "rest" if kind == "generic" else None
            for i, site in {1: "s0", 2: "s1", 3: "s0", 4: "s2", 5: rest, 6: "s3", 7: "s4", 10: "s6"}.items():
                assert got[0][i] == site, (i, used, kind)


def shape(page):
    return page.text, list(zip(page.tags, page.attrs, page.parents, page.prevs, page.from_end, page.last, page.t0, page.t1, strict=True))


def test_plain_markup_is_read_like_any_other():
    """Patterns and the standard library's reader agree, also on markup that only one of them takes."""
    rng = random.Random(6)
    bits = [
        "<p>", "<P CLASS='a b'>", "</p>", "<li>x", "<a href=\"/x?a=1&amp;b=2\" rel=next>", "</a >", "<br/>", "<img src='i.png' alt>",
        "text &amp; more", "1 &lt; 2 &copy &bogus; &#233;", "<!-- c -->", "<!doctype html>", "<script>if (a<b) { x='</p>' }</script>",
        "<script src=x></script>", "<style>p > a {}</style>", "<title>a &amp; b</title>", "<textarea>x</textarea>", "<div data-x=\"1 > 2\">",
        "<a href=/x/>", "< p", "<", "<3", "<p =x>", "<p a=1 A=2>", "</", "</ p>", "<!-->", "<!--->", "<!-- a -- b -->", "<![CDATA[x]]>", "<?php x?>",
        "<a title='a&b=1&copy=2'>", "<a title=\"it's\">", "<svg/>", "<x-y:z a:b='c'>", "<p\n class=a\t>", "é ü", "<p é='x'>", "\r\n", "</div>", "<table><tr><td>1",
        "<option selected>o", "<SCRIPT>a</SCRIPT>", "<script/>", "<p class=\"a\"id=\"b\">", "<p class=\"\">",
    ]
    for _ in range(4000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert shape(ParsedPage(html)) == shape(ParsedPage(html, plain=False)), html
    for html in bits:
        assert shape(ParsedPage(html)) == shape(ParsedPage(html, plain=False)), html


def test_equal_tags_are_taken_apart_and_tested_once(monkeypatch):
    """Many pages of one design: the work on a tag is done for its first page."""
    taken, tested = [], []
    values, tests = html._values, Automaton.tests
    monkeypatch.setattr(html, "_values", lambda written: taken.append(written) or values(written))
    monkeypatch.setattr(Automaton, "tests", lambda self, tag, attrs: tested.append(tag) or tests(self, tag, attrs))
    automaton = Automaton([".box-once a", "b", ".box-once > b:last-child"])
    page = "<div class='box-once'><a class='once'>x</a><b>1</b><b>2</b></div>" * 5
    for _ in range(20):
        assert automaton.hits(ParsedPage(page)) == [
            [4 * k + 1 for k in range(5)], [i for k in range(5) for i in (4 * k + 2, 4 * k + 3)], [4 * k + 3 for k in range(5)]
        ]
    assert len(taken) == 2 and sorted(tested) == ["a", "b", "div"]


def test_summaries_of_a_page_are_made_once(spark, tmp_path):
    """No filter of the plan makes them again; pages without summaries add no rows."""
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"
    lines = [(k, n, 10 * k + n, 1, 5.5 + n, 1.0) for k in (0, 1, 2) for n in (1, 2)]
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["listing_summaries_unlimited"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
    assert sorted((r.key, r.name, r.regular, r.n) for r in found.collect()) == [
        (k, f"Part {10 * k + n}", 5.5 + n, 1) for k in (1, 2) for n in (1, 2)
    ]


def test_hits_of_many_pages_at_once():
    """Pages without elements or hits, repeated hits, and siblings on either side, as one column."""
    made = ["<b>1</b><i>2</i><b>3</b>", "", "<p>x</p>", None, "<i class='x' id='y'>4</i>"]
    automaton = Automaton(["b", "i, .x", "b, i"])
    pages = [ParsedPage(m) for m in made]
    got = html._hits_of(pages, [automaton.found(p) for p in pages]).to_pylist()
    assert [[[h["i"] for h in hits] for hits in page] for page in got] == [automaton.hits(p) for p in pages]
    first = got[0][1][0]
    assert {k: first[k] for k in ("last", "t0", "t1", "p0", "p1", "n0", "n1")} == {
        "last": 1, "t0": 1, "t1": 2, "p0": 0, "p1": 1, "n0": 2, "n1": 3
    }
    assert got[4][1][0]["attrs"] == [("class", "x"), ("id", "y")] and got[4][1][0]["p0"] is None and got[4][1][0]["n1"] is None


def fits(page, i, parts, marks):
    """A chain tested at one element by looking at all elements that its last combinator may mean."""
    tag, attrs, place = page.tags[i], page.attrs[i], page.from_end[i]
    for name, value in re.findall(r"([.#:]?)([\w-]+)", parts[-1]):
        if name == "." and value not in attrs.get("class", "").split():
            return False
        if name == "#" and attrs.get("id") != value:
            return False
        if name == ":" and place != 1:
            return False
        if not name and tag != value:
            return False
    if not marks:
        return True
    parent, before = page.parents[i], [j for j in range(i) if page.parents[j] == page.parents[i]]
    above, up = [], parent
    while up >= 0:
        above.append(up)
        up = page.parents[up]
    where = {" ": above, ">": above[:1], "+": before[-1:], "~": before}[marks[-1]]
    return any(fits(page, j, parts[:-1], marks[:-1]) for j in where)


def test_automaton_equals_search_in_the_document():
    rng = random.Random(11)
    tags, classes = ["a", "b", "c"], ["x", "y"]

    def tree(depth):
        tag = rng.choice(tags)
        attrs = rng.choice(["", f' class="{rng.choice(classes)}"', ' class="x y"', f' id="{rng.choice("pq")}"'])
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def simple():
        return rng.choice([rng.choice(tags), "." + rng.choice(classes), "#" + rng.choice("pq"), rng.choice(tags) + ".x",
                           rng.choice(tags) + ":last-child", ".x.y"])

    for _ in range(60):
        page = ParsedPage("".join(tree(4) for _ in range(2)))
        chains = []
        for _ in range(25):
            n = rng.randint(1, 4)
            chains.append(([simple() for _ in range(n)], [rng.choice(" >+~") for _ in range(n - 1)]))
        written = ["".join(x for pair in zip(parts, [*marks, ""], strict=True) for x in pair) for parts, marks in chains]
        written.append(" , ".join(written[:3]))
        hits = Automaton(written).hits(page)
        want = [[i for i in range(len(page.tags)) if fits(page, i, *chain)] for chain in chains]
        want.append(sorted(set().union(*want[:3])))
        assert hits == want


@pytest.mark.parametrize("selector", ["", " ", "a >", "> a", "a[", "a:hover", "*"])
def test_unsupported_selectors(selector):
    with pytest.raises(ValueError):
        nodes.Page().hits(selector)


def test_slots_and_empty_alternatives():
    assert filled(slot("price", ".p") + " b, " + slot("brand"), {"brand": ".z"}) == ".p b, .z"
    assert has_slot(slot("x")) and not has_slot("a[href]")
    page = ParsedPage("<i class=p><b>1</b></i><b>2</b>")
    assert Automaton([filled(slot("price", ".p") + " b, " + slot("brand"), {}), filled(slot("brand"), {})]).hits(page) == [[1], []]


def test_a_page_parsed_without_a_selector_is_an_error(spark):
    page = nodes.Page()
    first = nodes.select_text(page, "b")
    df = parse_pages(spark.createDataFrame([("<b>x</b><i>y</i>",), (None,)], "html string"), page)
    assert [r[0] for r in df.select(first).collect()] == ["x", None]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.select(nodes.select_text(page, "i")).collect()


def test_nested_pages_take_time_in_proportion():
    """Deep nesting with descendant selectors: an element costs the same wherever it lies."""
    selectors = ["div b.x", "div div div b", "body div .x ~ i", "div > b + i"]

    def seconds(n):
        html = "<div>" * n + "<b class='x'>deep</b><i></i>" + "</div>" * n
        automaton = Automaton(selectors)
        started = time.perf_counter()
        page = ParsedPage(html)
        hits = automaton.hits(page)
        spent = time.perf_counter() - started
        assert hits == [[n], [n], [], [n + 1]]
        return spent

    small, large = min(seconds(5000) for _ in range(3)), min(seconds(20_000) for _ in range(3))
    assert large < 10 * small and large < 3


def test_deep_page_in_spark(spark):
    html = "<div>" * 20_000 + "<b class='x'>deep</b>" + "</div>" * 20_000
    page = nodes.Page()
    texts = [nodes.select_text(page, s).alias(f"x{i}") for i, s in enumerate(["div b.x", "div div b", "div > .x"])]
    got = parse_pages(spark.createDataFrame([(html,)], "html string"), page).select(*texts).first()
    assert list(got) == ["deep"] * 3


def test_a_thousand_sites_share_their_expressions(spark):
    """Each site has selectors of its own; they are data, so the plan does not grow with the sites."""
    configs = [
        {"name": f"s{i}", "base_url": f"https://s{i}.example.com", "adapter_type": ("shopify", "mcas", "generic")[i % 3],
         "selectors": {"product_container": f".box{i}", "product_name": f".name{i}", "brand": f".brand{i}"},
         "navigation": {"pagination_selector": f".next{i}"}, "limits": {"summaries": 1 + i % 2}}
        for i in range(1000)
    ]
    rows = []
    for i in (0, 1, 2, 300, 301, 302, 999):
        word = "products" if i % 3 == 0 else "product"
        path = ("collections", "category", "browse")[i % 3]
        boxes = "".join(
            f'<div class="box{i} product-item"><a href="/{word}/{k}">x</a><p class="name{i} product-name">N{k}</p></div>' for k in range(3)
        )
        rows.append((f"https://s{i}.example.com/{path}/x", f"s{i}", f'{boxes}<a class="next{i}" rel="next" href="/{path}/x?page=2">n</a>'))
    pages = spark.createDataFrame(rows, "url string, site string, html string")
    ops.process_pages(pages.limit(0), configs[:3], NOW).collect()
    started = time.perf_counter()
    outcomes = ops.process_pages(pages, configs, NOW)
    outcomes._jdf.queryExecution().executedPlan()
    planning = time.perf_counter() - started
    got = {r.site: r for r in outcomes.collect()}
    for url, site, _ in rows:
        i = int(site[1:])
        assert got[site].page_type == "collection"
        assert [u.rsplit("/", 1)[1] for u in got[site].discovery.product_urls] == ["0", "1", "2"]
        assert got[site].discovery.next_url == url + "?page=2"
        n = {0: 0, 1: 3, 2: 1 + i % 2}[i % 3]
        assert [s.name for s in got[site].summaries] == [f"N{k}" for k in range(n)]
    one = ops.process_pages(pages, configs[:3], NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert len(outcomes._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * len(one)
    assert planning < 10, planning
    with pytest.raises(ValueError):
        ops.process_pages(pages, [{**configs[0], "selectors": {"product_container": "a:hover"}}], NOW)
