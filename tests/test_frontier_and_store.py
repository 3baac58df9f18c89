import datetime

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import dedup, frontier, images, monitor, relational
from shelfwright.plans import derive
from shelfwright import schemas
from shelfwright.sources import logs, products, sites
from shelfwright.sources.store import ProductStore
from tests.test_products import product

T0 = "2025-01-01 00:00:00"


@pytest.fixture
def queue(spark):
    rows = [("u0", "a", 1, 0), ("u1", "a", 9, 1), ("u2", "b", 0, 2), ("u3", "b", 9, 3)]
    urls = spark.createDataFrame(rows, "url string, site string, priority int, seq long")
    return frontier.enqueue(None, urls, T0)


def order(df):
    return [r["url"] for r in df.collect()]


def test_priority_zero_and_order(queue):
    assert order(frontier.next_batch(queue, T0, k=4)) == ["u1", "u3", "u2", "u0"]
    assert queue.filter("url = 'u2'").first()["priority"] == 5
    assert order(frontier.next_batch(queue, T0, k=4, per_site=1)) == ["u1", "u3"]


def test_retry_goes_first_then_fails(queue):
    q = frontier.start(queue, queue.filter("url = 'u0'"))
    assert frontier.next_batch(q, T0).count() == 2
    errors = q.filter("url = 'u0'").select("id", F.lit("boom").alias("error"))
    again = frontier.apply_failures(q, errors, T0)
    row = again.filter("url = 'u0'").first()
    assert (row["status"], row["retry_count"]) == ("pending", 1)
    assert row["scheduled_at"] == datetime.datetime(2025, 1, 1, 0, 0, 5)
    assert order(frontier.next_batch(again, "2025-01-01 00:01:00", k=2)) == ["u0", "u1"]
    worn = again.withColumn("status", F.lit("processing")).withColumn("retry_count", F.lit(3))
    dead = frontier.apply_failures(worn, errors, T0).filter("url = 'u0'").first()
    assert (dead["status"], dead["retry_count"], dead["metadata"]["error"]) == ("failed", 3, "boom")


def test_stats_and_eta(queue):
    assert frontier.frontier_stats(queue).first().asDict() == {
        "pending": 4, "processing": 0, "completed": 0, "failed": 0, "total": 4
    }
    assert frontier.eta_ms(queue).first()[0] == 8000
    assert frontier.eta_ms(queue.filter("false")).first()[0] == 0
    assert frontier.remove_pending(queue, queue.filter("seq < 2").select("id")).count() == 2


def test_backoff(spark):
    df = spark.range(1, 8)
    got = [r[0] for r in df.select(frontier.backoff_ms(F.col("id"))).collect()]
    assert got == [1000, 2000, 4000, 8000, 16000, 30000, 30000]


def test_large_batches_are_limited_early(spark):
    rows = [(f"https://a/{i}", "a", i % 3, i) for i in range(50)]
    f = frontier.enqueue(None, spark.createDataFrame(rows, "url string, site string, priority int, seq long"), T0)
    plan = frontier.next_batch(f, T0, k=5_000, per_site=4_000)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_round_trip_and_lost_values(spark):
    v = {
        "id": "v1", "name": "n", "sku": "", "type": "size", "value": "M",
        "price": {"regular": 1.0, "sale": 0.0, "currency": "AUD"},
        "availability": {"in_stock": True, "quantity": 0.0, "stock_status": "in_stock"}, "images": ["b", "a"],
    }
    rows = [product(variants=[v], compliance={"adr": False}, reviews={"average_rating": 4.0}), product(id="2", images=[])]
    df = spark.createDataFrame(rows, schemas.PRODUCT)
    back = relational.from_relational(relational.to_relational(df)).orderBy("id").collect()
    p = back[0]
    assert p["images"] == rows[0]["images"]
    assert p["variants"][0]["images"] == ["b", "a"]
    assert p["variants"][0]["price"]["sale"] is None and p["variants"][0]["availability"]["quantity"] is None
    assert p["compliance"]["adr"] is None and p["reviews"] is None and p["description"]["features"] is None
    assert back[1]["images"] == [] and back[1]["variants"] == []


def test_upsert_replaces_children(spark):
    old = spark.createDataFrame([product(), product(id="2")], schemas.PRODUCT)
    new = spark.createDataFrame([product(images=["z"], name="new")], schemas.PRODUCT)
    merged = relational.upsert_relational(relational.to_relational(old), relational.to_relational(new))
    got = {r["id"]: (r["name"], len(r["images"])) for r in relational.from_relational(merged).collect()}
    assert got == {"1": ("new", 1), "2": (" A  b ", 3)}


def test_last_write_wins_with_its_children(spark):
    old = spark.createDataFrame([product(id="1"), product(id="2")], schemas.PRODUCT)
    batch = spark.createDataFrame(
        [product(name="first", images=["a", "b"]), product(name="second", images=["c"]), product(id="3")], schemas.PRODUCT
    )
    merged = relational.upsert_relational(
        relational.to_relational(old), relational.to_relational(relational.latest_products(batch.coalesce(1)))
    )
    got = {r["id"]: (r["name"], list(r["images"])) for r in relational.from_relational(merged).collect()}
    assert got["1"] == ("second", ["c"]) and len(got) == 3


def test_same_variant_ids_in_two_products(spark):
    def v(images):
        return {
            "id": "variant-0", "name": "n", "sku": "", "type": "size", "value": "M",
            "price": {"regular": 1.0, "sale": 0.0, "currency": "AUD"},
            "availability": {"in_stock": True, "quantity": 0.0, "stock_status": "in_stock"}, "images": images,
        }

    rows = [product(id="1", variants=[v(["b", "a"])]), product(id="2", variants=[v(["c"])]), product(id="3", variants=[v([])])]
    df = spark.createDataFrame(rows, schemas.PRODUCT)
    back = relational.from_relational(relational.to_relational(df), newest_first=True).collect()
    assert {r["id"]: r["variants"][0]["images"] for r in back} == {"1": ["b", "a"], "2": ["c"], "3": []}
    assert [r["id"] for r in back] == ["1", "2", "3"]  # one time of scraping: by id


def test_stored_tables_add_up(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert products.read_stored(spark, folder) is None
    for n in range(3):
        batch = [product(id=str(n), name=f"run {n}"), product(id="x", name=f"run {n}")]
        products.add_to_stored(spark.createDataFrame(batch, schemas.PRODUCT), folder)
    got = {r["id"]: r["name"] for r in relational.from_relational(products.read_stored(spark, folder)).collect()}
    assert got == {"0": "run 0", "1": "run 1", "2": "run 2", "x": "run 2"}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("ready")) == ["ready-2", "ready-3"]


def _bytes_of_run(folder, run):
    return sum(f.stat().st_size for f in folder.glob(f"*/run={run}/*.parquet"))


def _store_products(spark, first, last, name):
    """Products with images, specifications and variants with images."""
    text = F.concat(F.lit(name), F.col("n").cast("string"))
    variant = F.struct(
        F.lit("v0").alias("id"), text.alias("name"), F.lit("M").alias("value"), F.lit("size").alias("type"),
        F.array(text, F.lit("b")).alias("images"),
    )
    full = F.struct(
        F.col("n").cast("string").alias("id"), text.alias("name"), F.array(text, F.lit("a")).alias("images"),
        F.array(variant).alias("variants"), F.struct(F.create_map(F.lit("k"), text).alias("specifications")).alias("description"),
        F.struct(F.lit("s").alias("site")).alias("metadata"),
    )
    rows = spark.range(first, last).withColumnRenamed("id", "n")
    return rows.select(F.from_json(F.to_json(full), schemas.PRODUCT).alias("p")).select("p.*")


def test_a_run_writes_its_own_share(spark, tmp_path):
    """One product in a hundred comes again: about a hundredth of the bytes is written, and all tables read right."""
    store = ProductStore(spark, str(tmp_path / "t"), buckets=2)
    store.add(_store_products(spark, 0, 60_000, "first "))
    store.add(_store_products(spark, 59_700, 60_300, "second "))
    one, two = (_bytes_of_run(tmp_path / "t", n) for n in (1, 2))
    assert 0 < two < 0.03 * one
    back = relational.from_relational(ProductStore(spark, str(tmp_path / "t")).read())
    got = {r["id"]: r for r in back.where("cast(id AS int) >= 59600").collect()}
    assert back.count() == 60_300 and len(got) == 700
    for n, r in got.items():
        text = ("second " if int(n) >= 59_700 else "first ") + n
        assert r["name"] == text and r["images"] == [text, "a"] and r["description"]["specifications"] == {"k": text}
        assert [(v["id"], v["images"]) for v in r["variants"]] == [("v0", [text, "b"])]


def test_reading_the_store_needs_no_shuffle(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "t"), buckets=4)
    for first in (0, 50):
        store.add(_store_products(spark, first, first + 100, f"{first} "))
        back = relational.from_relational(store.read())
        back.collect()
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, plan


def test_a_run_shuffles_its_products_once(spark, tmp_path):
    """One shuffle finds the last of each id and deals the buckets; each of the five tables is then one stage."""
    store = ProductStore(spark, str(tmp_path / "t"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.sparkContext.setJobGroup("one run", "")
    try:
        store.add(_store_products(spark, 0, 500, "x ").union(_store_products(spark, 100, 200, "y ")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(n) for n in tracker.getJobIdsForGroup("one run")]
    assert 0 < len({s for job in jobs for s in job.stageIds}) <= 8
    for name in ("products", "product_images", "product_variants"):
        files = [f.name for f in (tmp_path / "t" / name / "run=1").glob("*.parquet")]
        assert 0 < len(files) <= store.buckets
    got = {r["id"]: r["name"] for r in relational.from_relational(store.read()).collect()}
    assert got == {str(i): f"{'y' if 100 <= i < 200 else 'x'} {i}" for i in range(500)}


def test_lines_of_orders_in_their_order(spark, tmp_path):
    """Lines that agree in all numbers go by the texts of their variants, an absent text first; some orders have none."""
    lines = [(n, 1, 7, 8, 2.0, 10.5, 0.05, flag, status) for n in (4, 5) for flag in ("R", "A", None, "N") for status in ("O", None, "F")]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, f"{names}, l_tax double, l_returnflag string, l_linestatus string").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    orders = [(n, 1.0, "O") for n in (4, 5, 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    got = {r["o_orderkey"]: r["variants"] for r in derive.raw_orders(spark, str(tmp_path), every=4).collect()}
    assert set(got) == {4, 8} and got[8] is None and len(got[4]) == 12
    key = lambda v: [(x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in v]
    assert [tuple(v) for v in got[4]] == sorted((tuple(v) for v in got[4]), key=key)
    want = {
        (None, f and f == "A" and "Line 1" or None, "$10.50", "C1" if s == "O" else None, "S1" if f == "R" else None, "P7",
         2.0 if f in ("R", "A") else None, None if s is None else s == "O")
        for *_, f, s in lines
    }
    assert {tuple(v) for v in got[4]} == want


def test_layers_are_merged(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "t"), buckets=2, most_layers=3)
    for n in range(6):
        store.add(_store_products(spark, n, n + 5, f"{n} "))
    assert len(store.layers) <= 3 and store.buckets == 2
    again = ProductStore(spark, str(tmp_path / "t"), buckets=7)
    assert (again.buckets, again.layers) == (2, store.layers)
    got = {r["id"]: r["name"] for r in relational.from_relational(again.read()).collect()}
    assert got == {str(i): f"{min(i, 5)} {i}" for i in range(10)}


def test_a_run_that_fails_leaves_the_store(spark, tmp_path, monkeypatch):
    store = ProductStore(spark, str(tmp_path / "t"), buckets=2)
    store.add(_store_products(spark, 0, 5, "a "))

    def fail(*_):
        raise RuntimeError("stopped before the marker")

    monkeypatch.setattr(ProductStore, "_mark", fail)
    with pytest.raises(RuntimeError):
        store.add(_store_products(spark, 3, 9, "lost "))
    monkeypatch.undo()
    again = ProductStore(spark, str(tmp_path / "t"))
    names = lambda: {r["id"]: r["name"] for r in relational.from_relational(again.read()).collect()}
    assert names() == {str(i): f"a {i}" for i in range(5)}
    again.add(_store_products(spark, 4, 6, "b "))
    assert names() == {**{str(i): f"a {i}" for i in range(4)}, "4": "b 4", "5": "b 5"}


def test_an_empty_run_and_products_without_children(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "t"), buckets=2)
    assert store.read() is None
    store.add(spark.createDataFrame([], schemas.PRODUCT))
    assert relational.from_relational(store.read()).count() == 0
    store.add(_store_products(spark, 0, 3, "x "))
    store.add(spark.createDataFrame([product(id="1", images=[], variants=[], description=None)], schemas.PRODUCT))
    got = {r["id"]: (len(r["images"]), len(r["variants"])) for r in relational.from_relational(store.read()).collect()}
    assert got == {"0": (2, 1), "1": (0, 0), "2": (2, 1)}


def test_append_keeps_the_first_that_came(spark):
    old = spark.createDataFrame([("1", "a"), ("1", "b")], "id string, name string").coalesce(1)
    new = spark.createDataFrame([("2", "c"), ("2", "d"), ("1", "e")], "id string, name string").coalesce(1)
    got = {r["id"]: r["name"] for r in dedup.append_products(old, new).collect()}
    assert got == {"1": "a", "2": "c"}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([product(name='q"uo,te', brand=" edge ")], schemas.PRODUCT)
    result = products.store_products(df, "all", str(tmp_path), as_of=datetime.datetime(2025, 1, 2, 3, 4, 5))
    got = {r["format"]: (r["count"], r["success"], r["path"]) for r in result.collect()}
    assert got["json"] == (1, True, f"{tmp_path}/products_2025-01-02T03-04-05.json")
    assert set(got) == {"json", "csv", "tables"}
    lines = [r[0] for r in spark.read.text(got["csv"][2]).collect()]
    assert any('"q""uo,te"' in x for x in lines)
    back = products.read_products_json(spark, got["json"][2], array_file=False).first()
    assert back["name"] == 'q"uo,te' and back["brand"] == " edge "
    assert products.store_products(df.filter("false"), "json", str(tmp_path)).count() == 0
    bad = products.store_products(df, "xml", str(tmp_path)).first()
    assert (bad["success"], bad["count"]) == (False, 0)
    stats = {r["extension"]: r["files"] for r in products.storage_stats(spark, str(tmp_path)).collect()}
    assert stats["json"] >= 1 and stats["csv"] >= 1
    assert products.read_products_json(spark, str(tmp_path / "none")).count() == 0


def test_json_array_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('[{"id": "1", "name": "A", "price": {"regular": 2, "currency": "AUD"}},\n {"id": "2"}]')
    got = products.read_products_json(spark, str(path)).orderBy("id").collect()
    assert [r["id"] for r in got] == ["1", "2"] and got[0]["price"]["regular"] == 2.0


def test_bare_site_map(spark, tmp_path):
    path = tmp_path / "sites.json"
    path.write_text('{"x": {"name": "x", "base_url": "bad", "adapter_type": "shopify"}}')
    valid, invalid = sites.read_site_configs(spark, str(path))
    assert valid.count() == 0
    assert "base_url: Invalid URL" in invalid.first()["errors"]


def test_logs(spark, tmp_path):
    rows = [(datetime.datetime(2025, 1, d, 1), lvl, f"m{d}", None, None) for d, lvl in [(1, "debug"), (2, "warn"), (3, "error")]]
    df = spark.createDataFrame(rows, schemas.LOG_ENTRY)
    logs.write_logs(df, str(tmp_path / "l"))
    back = logs.read_logs(spark, str(tmp_path / "l"))
    assert [r["message"] for r in monitor.recent_logs(back, 5, "warn").collect()] == ["m3", "m2"]


def test_images(spark):
    rows = [
        ("p", "https://e.com/a.JPG", "image/jpeg", 5, b"x"), ("p", "https://e.com/img/1", "text/html", 5, b"x"),
        ("p", "https://e.com/doc", "image/png", 5, b"x"), ("p", "https://e.com/b.png", "image/png", 20_000_000, b"x"),
        ("p", "https://e.com/c.jpg", "image/jpeg", 5, b"x"),
    ]
    df = spark.createDataFrame(rows, "product_id string, url string, content_type string, size long, content binary")
    good, bad = images.accept_images(df)
    assert bad.count() == 3
    manifest = images.image_manifest(good, "/img/", T0)
    fresh = images.new_images(manifest, manifest.filter("false"))
    # Equal contents of one product share a file name.
    assert [r["filename"] for r in fresh.collect()] == ["p_9dd4e461268c8034f5c8564e155c67a6.jpg"]
    assert images.new_images(manifest, manifest).count() == 0


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.REQUEST)
    issues = spark.createDataFrame([], "site string, type string")
    report = monitor.performance_report(empty, issues, spark.createDataFrame([], schemas.LOG_ENTRY), T0)
    row = report["summary"].first()
    assert (row["requests"], row["success_rate"], row["avg_response_time"]) == (0, "0%", "0ms")
