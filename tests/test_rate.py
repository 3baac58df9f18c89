"""Rate limits against straightforward reference loops on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import rate


def log(spark, seed, n=400, span=40_000, sites=("a", "a", "a", "b")):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(sites), rnd.randrange(span)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, site string, ms long")


@pytest.mark.parametrize("cell_ms, cell_rows", [(70, 10**6), (1000, 10**6), (7000, 10**6), (10**9, 10**6), (40_000, 100), (60_000, 0)])
def test_windows(spark, cell_ms, cell_rows):
    rows, df = log(spark, 1)
    got = rate.rate_window_audit(
        df, max_requests=5, burst=2, window_ms=1000, burst_ms=200, cell_ms=cell_ms, cell_rows=cell_rows
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [ms for _, s, ms in rows if s == r["site"] and 0 <= r["ms"] - ms < 1000]
        near = [ms for ms in past if r["ms"] - ms < 200]
        wait = 0
        if len(past) >= 5:
            wait = 1000 - (r["ms"] - min(past)) + 100
        elif len(near) >= 2:
            wait = 200 - (r["ms"] - min(near)) + 100
        assert (r["in_window"], r["in_burst"], r["wait_ms"]) == (len(past), len(near), wait)


def walk(rows, size, refill):
    """One site's bucket in whole units."""
    cap, per_ms = round(size * rate.UNITS), round(refill * rate.UNITS / 1000)
    level, now, out = cap, None, {}
    for i, _, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        level = min(cap, level + (0 if now is None else (ms - now) * per_ms))
        now = ms
        out[i] = level
        if level >= rate.UNITS:
            level -= rate.UNITS
    return out, level


@pytest.mark.parametrize("size, refill", [(5.0, 0.5), (2.5, 3.0), (7.5, 0.125), (0.5, 1.0), (1.0, 40.0)])
@pytest.mark.parametrize("slice_ms", [300, 5000, 10**9])
def test_bucket(spark, size, refill, slice_ms):
    rows, df = log(spark, int(size * 10))
    params = spark.createDataFrame(
        [("a", size, refill, 100.0)], "site string, max_tokens double, refill_rate double, min_interval double"
    )
    got = {r["id"]: r for r in rate.token_bucket_tag(df, params, slice_ms=slice_ms).collect()}
    want, end = walk([r for r in rows if r[1] == "a"], size, refill)
    default, _ = walk([r for r in rows if r[1] == "b"], rate.MAX_TOKENS, rate.REFILL_RATE)
    for i, level in {**want, **default}.items():
        assert round(got[i]["tokens"] * rate.UNITS) == level
        assert got[i]["admitted"] == (level >= rate.UNITS)
        assert (got[i]["wait_ms"] == 0) == got[i]["admitted"]
    status = rate.bucket_status(rate.bucket_slices(df, params, slice_ms=slice_ms), params)
    assert status.filter(F.col("site") == "a").first()["level"] == end


def test_bucket_continues(spark):
    rows, df = log(spark, 5, sites=("a",))
    params = spark.createDataFrame(
        [("a", 3.0, 0.4, 100.0)], "site string, max_tokens double, refill_rate double, min_interval double"
    )
    first, second = df.filter("ms < 20000"), df.filter("ms >= 20000")
    state = rate.bucket_status(rate.bucket_slices(first, params, slice_ms=3000), params)
    got = rate.token_bucket_tag(second, params, state.select("site", "level", "ms"), slice_ms=3000)
    want, _ = walk(rows, 3.0, 0.4)
    assert all(round(r["tokens"] * rate.UNITS) == want[r["id"]] for r in got.collect())


def test_utilization_and_params(spark):
    _, df = log(spark, 2)
    used = rate.rate_utilization(df, 10_000, max_requests=10, window_ms=1000).first()
    n = df.filter("ms <= 10000 AND 10000 - ms < 1000").count()
    assert (used["in_window"], used["utilization"]) == (n, n / 10)
    sites = spark.createDataFrame(
        [("s", (15.0, 2000.0)), ("d", None)],
        "name string, rate_limit struct<requests_per_minute:double,delay_between_requests:double>",
    )
    got = {r["site"]: tuple(r)[1:] for r in rate.bucket_params(sites).collect()}
    assert got == {"s": (7.5, 0.125, 2000.0), "d": (5.0, 0.5, 2000.0)}


def test_late_request_refills_nothing(spark):
    """A request older than the level it meets takes a token and turns no clock back."""
    params = spark.createDataFrame([("a", 2.0, 1.0, 0.0)], "site string, max_tokens double, refill_rate double, min_interval double")
    state = spark.createDataFrame([("a", rate.UNITS, 10_000)], "site string, level bigint, ms bigint")
    requests = spark.createDataFrame([("a", 4_000, 1), ("a", 4_500, 2)], "site string, ms bigint, id bigint")
    tags = {r["id"]: (r["tokens"], r["admitted"]) for r in rate.token_bucket_tag(requests, params, state).collect()}
    assert tags == {1: (1.0, True), 2: (0.5, False)}


def test_busy_slice_is_cut(spark):
    """One site with nine tenths of the rows in one slice: many slices, the same tags."""
    busy = [("busy", 1_000 + i // 3, i) for i in range(1800)]
    rows = busy + [("calm", 10_000 * i, 10_000 + i) for i in range(200)]
    requests = spark.createDataFrame(rows, "site string, ms bigint, id bigint")
    params = spark.createDataFrame([("busy", 5.0, 20.0, 0.0)], "site string, max_tokens double, refill_rate double, min_interval double")
    timed = rate._with_params(requests, params)
    cut = rate._cut_slices(timed, 600_000, rows=100).groupBy("site", "slice").count()
    assert cut.where("site = 'busy'").count() > 0
    narrow = rate._cut_slices(timed, 1_000, rows=100).groupBy("site", "slice").agg(F.count("*").alias("n"))
    assert narrow.where("site = 'busy'").agg(F.max("n")).first()[0] <= 350
    whole = {r["id"]: r["tokens"] for r in rate.token_bucket_tag(requests, params).collect()}
    old, rate._cut_slices.__defaults__ = rate._cut_slices.__defaults__, (100,)
    try:
        parts = {r["id"]: r["tokens"] for r in rate.token_bucket_tag(requests, params, slice_ms=1_000).collect()}
    finally:
        rate._cut_slices.__defaults__ = old
    assert parts == whole


def test_windows_of_one_limiter_with_nulls_and_negative_times(spark):
    rows = [(1, "a", -5), (2, None, 5), (3, "b", 100), (4, None, 5), (5, "a", None), (6, "c", 1004)]
    df = spark.createDataFrame(rows, "id long, site string, ms long")
    got = {r.id: (r.in_window, r.in_burst) for r in rate.rate_window_audit(df, window_ms=1000, burst_ms=100, by=[], cell_ms=50).collect()}
    assert got == {1: (1, 1), 2: (3, 3), 4: (3, 3), 3: (4, 3), 6: (4, 1)}
    apart = {r.id: r.in_window for r in rate.rate_window_audit(df, window_ms=1000, burst_ms=100).collect()}
    assert apart == {1: 1, 2: 2, 4: 2, 3: 1, 6: 1}
    assert rate.rate_window_audit(df.limit(0)).collect() == []


def test_windows_at_any_traffic(spark):
    """One site with nine tenths of all requests within seconds: no task of the sums sees more than 50,000 rows."""
    hot = spark.range(900_000).select(F.lit("hot").alias("site"), F.expr("id div 90").alias("ms"), "id")
    rest = spark.range(100_000).select(F.concat(F.lit("s"), F.expr("id % 50")).alias("site"), (F.col("id") * 7).alias("ms"), "id")
    audit = rate.rate_window_audit(hot.unionAll(rest), max_requests=10, burst=5)
    got = audit.filter("site = 'hot'").agg(F.count("*"), F.max("in_window"), F.max("in_burst"), F.sum("in_window")).first()
    assert got[0] == 900_000 and got[1] == got[2] == 900_000
    assert got[3] == sum(90 * 90 * (k + 1) for k in range(10_000))


def test_cells_are_bounded(spark):
    """Nine tenths of the requests within one coarse cell: cells of at most 30,000 rows."""
    rows = spark.range(90_000).select(F.lit("hot").alias("site"), (F.col("id") * 2).alias("_t")).unionAll(
        spark.range(10_000).select(F.lit("calm").alias("site"), (F.col("id") * 1000).alias("_t"))
    )
    cells = rate._celled(rows, ["site"], 3_600_000, 30_000).groupBy("site", "_cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 30_000
    assert cells.filter("site = 'calm'").count() == 3 and cells.filter("site = 'hot'").count() == 18


def test_a_million_requests_in_one_millisecond(spark):
    requests = spark.range(1_000_000).select(F.lit("a").alias("site"), F.lit(5_000).cast("long").alias("ms"), "id").unionAll(
        spark.createDataFrame([("a", 5_001, -1), ("a", 9_000, -2), ("b", 5_000, -3)], "site string, ms long, id long")
    )
    params = spark.createDataFrame([("a", 3.5, 1.0, 50.0)], "site string, max_tokens double, refill_rate double, min_interval double")
    tags = rate.token_bucket_tag(requests, params)
    per = {(r.site, r.ms, r.admitted): r.n for r in tags.groupBy("site", "ms", "admitted").agg(F.count("*").alias("n")).collect()}
    assert per == {("a", 5_000, True): 3, ("a", 5_000, False): 999_997, ("a", 5_001, False): 1, ("a", 9_000, True): 1, ("b", 5_000, True): 1}
    firsts = {r.id: (r.tokens, r.wait_ms) for r in tags.filter("id < 5").collect()}
    assert firsts[0] == (3.5, 0) and firsts[2] == (1.5, 0) and firsts[3] == firsts[4] == (0.5, 500.0)
    assert firsts[-2][0] == 3.5
    plan = tags._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
