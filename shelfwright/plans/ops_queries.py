"""Frontier, request rates, monitoring and images."""

from __future__ import annotations

from pyspark.sql import functions as F


from shelfwright.operators import frontier, images, monitor, rate
from shelfwright.plans.registry import query, table
from shelfwright.plans.store_queries import event_logs, scratch, supplier_configs
from shelfwright.sources import logs as log_files

NOW = "2024-03-01 00:00:00"
NOW_MS = 1709251200000


def seeds(spark, sf):
    """One URL per order; the customer's nation is the site."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        F.concat(F.lit("https://shop.example.com/o/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.lower("n_name").alias("site"),
        # 1-URGENT is the highest of 5..1; 0 stands for the lowest given priority.
        (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderkey").alias("seq"),
        "o_orderstatus",
    )


def orders_frontier(spark, sf):
    """Frontier in which finished orders are done, some are in process and some were retried."""
    urls = seeds(spark, sf)
    f = frontier.enqueue(None, urls.drop("o_orderstatus"), NOW)
    state = urls.select("seq", "o_orderstatus")
    now = F.lit(NOW).cast("timestamp")
    done = F.col("o_orderstatus") == "F"
    busy = (F.col("o_orderstatus") == "P") & (F.col("seq") % 2 == 0)
    again = F.col("seq") % 11 == 0
    status = F.when(done, F.lit("completed")).when(busy, F.lit("processing")).otherwise(F.lit("pending"))
    late = F.col("seq") % 13 == 0
    return (
        f.join(state, "seq")
        .withColumn("status", status)
        .withColumn("retry_count", F.when(again, (F.col("seq") % 5).cast("int")).otherwise(0))
        .withColumn(
            "retried_at",
            F.when(
                again & (F.col("retry_count") > 0),
                F.timestamp_millis(F.lit(NOW_MS - 10_000_000) + F.col("seq")),
            ),
        )
        .withColumn(
            "scheduled_at", F.when(late, now + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("scheduled_at"))
        )
        .select(*f.columns)
    )


FRONTIER_SQL = """
frontier AS (
  SELECT o_orderkey AS seq, 'https://shop.example.com/o/' || o_orderkey AS url, lower(n_name) AS site,
    CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 5
      ELSE 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0
      THEN 'processing' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey % 5 AS INT) ELSE 0 END AS retry_count,
    o_orderkey % 11 = 0 AND o_orderkey % 5 > 0 AS retried,
    CASE WHEN o_orderkey % 13 = 0 THEN 1709251200000 + 3600000 ELSE 1709251200000 END AS due
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query(f"""
WITH {FRONTIER_SQL} SELECT url, site, priority, 0 AS retry_count, 'pending' AS status, seq FROM frontier
""")
def frontier_enqueue(spark, sf):
    urls = seeds(spark, sf).drop("o_orderstatus")
    half = frontier.enqueue(None, urls.filter("seq % 2 = 0"), NOW)
    return frontier.enqueue(half, urls.filter("seq % 2 = 1"), NOW).select(
        "url", "site", "priority", "retry_count", "status", "seq"
    )


_ORDER = "CASE WHEN retried THEN 0 ELSE 1 END, CASE WHEN retried THEN -seq END, priority DESC, seq"


@query(f"""
WITH {FRONTIER_SQL}, ready AS (SELECT * FROM frontier WHERE status = 'pending' AND due <= 1709251200000)
SELECT seq, site, priority, retry_count FROM ready ORDER BY {_ORDER} LIMIT 200
""")
def frontier_next_batch(spark, sf):
    batch = frontier.next_batch(orders_frontier(spark, sf), NOW, k=200)
    return batch.select("seq", "site", "priority", "retry_count")


@query(f"""
WITH {FRONTIER_SQL}, ready AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_ORDER}) AS r
  FROM frontier WHERE status = 'pending' AND due <= 1709251200000),
caps AS (SELECT lower(n_name) AS site, 1 + n_nationkey % 4 AS cap FROM nation)
SELECT seq, site, priority, retry_count FROM ready JOIN caps USING (site) WHERE r <= cap
ORDER BY {_ORDER} LIMIT 40
""")
def frontier_next_batch_per_site(spark, sf):
    caps = table(spark, sf, "nation").select(
        F.lower("n_name").alias("site"), (F.lit(1) + F.col("n_nationkey") % 4).alias("cap")
    )
    batch = frontier.next_batch(orders_frontier(spark, sf), NOW, k=40, per_site=caps)
    return batch.select("seq", "site", "priority", "retry_count")


@query(f"""
WITH {FRONTIER_SQL}, hit AS (SELECT *, status = 'processing' AND seq % 3 = 0 AS failed FROM frontier)
SELECT seq,
  CASE WHEN failed AND retry_count < 3 THEN 'pending' WHEN failed THEN 'failed' ELSE status END AS status,
  retry_count + CASE WHEN failed AND retry_count < 3 THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN failed AND retry_count < 3 THEN 1709251200000 + 5000 * CAST(2 ** retry_count AS BIGINT)
    ELSE due END AS due,
  CASE WHEN failed AND retry_count >= 3 THEN 'timeout ' || seq END AS error
FROM hit
""")
def frontier_failures(spark, sf):
    f = orders_frontier(spark, sf)
    failures = f.filter("seq % 3 = 0").select(
        "id", F.concat(F.lit("timeout "), F.col("seq").cast("string")).alias("error")
    )
    return frontier.apply_failures(f, failures, NOW).select(
        "seq", "status", "retry_count", F.unix_millis("scheduled_at").alias("due"),
        F.col("metadata")["error"].alias("error"),
    )


@query(f"""
WITH {FRONTIER_SQL}, hit AS (SELECT *, status = 'processing' AND seq % 3 = 1 AS done FROM frontier)
SELECT seq, CASE WHEN done THEN 'completed' ELSE status END AS status,
  CASE WHEN done THEN CAST(seq * 2 AS VARCHAR) END AS result FROM hit
""")
def frontier_completions(spark, sf):
    f = orders_frontier(spark, sf)
    done = f.filter("seq % 3 = 1").select("id", (F.col("seq") * 2).alias("result"))
    return frontier.apply_completions(f, done).select(
        "seq", "status", F.col("metadata")["result"].alias("result")
    )


@query(f"""
WITH {FRONTIER_SQL}
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) AS total FROM frontier
""")
def frontier_stats(spark, sf):
    return frontier.frontier_stats(orders_frontier(spark, sf))


@query(f"""
WITH {FRONTIER_SQL}
SELECT 'retry' AS list, seq FROM frontier WHERE status = 'pending' AND retry_count > 0
UNION ALL SELECT 'processing', seq FROM frontier WHERE status = 'processing'
""")
def frontier_items(spark, sf):
    f = orders_frontier(spark, sf)
    return frontier.frontier_items(f, "retry").select(F.lit("retry").alias("list"), "seq").unionByName(
        frontier.frontier_items(f, "processing").select(F.lit("processing").alias("list"), "seq")
    )


@query(f"""
WITH {FRONTIER_SQL} SELECT seq, status FROM frontier WHERE NOT (status = 'pending' AND seq % 4 = 0)
""")
def frontier_remove(spark, sf):
    f = orders_frontier(spark, sf)
    return frontier.remove_pending(f, f.filter("seq % 4 = 0").select("id")).select("seq", "status")


@query(f"""
WITH {FRONTIER_SQL}
SELECT CAST(ceil(count(*) FILTER (status IN ('pending', 'processing')) * 6000 / 3) AS BIGINT) AS eta_ms
FROM frontier
""")
def frontier_eta(spark, sf):
    return frontier.eta_ms(orders_frontier(spark, sf))


@query(f"""
WITH {FRONTIER_SQL}, links AS (
  SELECT f.*, l_partkey, l_linenumber FROM frontier f JOIN lineitem ON seq = l_orderkey)
SELECT 'https://shop.example.com/p/' || l_partkey AS url, site,
  CASE WHEN l_linenumber = 7 THEN priority ELSE priority + 1 END AS priority,
  CASE WHEN l_linenumber = 7 THEN 'parentUrl=' ELSE 'discoveredFrom=' END || url AS origin
FROM links
""")
def frontier_expand(spark, sf):
    """Lines of an order as links found on its page; line 7 is the next page."""
    f = orders_frontier(spark, sf)
    links = table(spark, sf, "lineitem").select(
        F.concat(F.lit("https://shop.example.com/o/"), F.col("l_orderkey").cast("string")).alias("page_url"),
        F.concat(F.lit("https://shop.example.com/p/"), F.col("l_partkey").cast("string")).alias("link"),
        F.when(F.col("l_linenumber") == 7, F.lit("next")).otherwise(F.lit("product")).alias("kind"),
        F.col("l_linenumber").alias("pos"),
    )
    grown = frontier.expand_frontier(f, links, "2024-03-01 01:00:00")
    new = grown.filter(F.col("created_at") > F.lit(NOW).cast("timestamp"))
    m = F.col("metadata")
    origin = F.coalesce(
        F.concat(F.lit("discoveredFrom="), m["discoveredFrom"]),
        F.concat(F.lit("parentUrl="), m["parentUrl"]),
    )
    return new.select("url", "site", "priority", origin.alias("origin"))


@query("""
SELECT p_partkey, least(30000, 1000 * 2 ** (1 + p_size % 8 - 1) + 250) AS delay_ms FROM part
""")
def backoff_schedule(spark, sf):
    delay = frontier.backoff_ms(F.lit(1) + F.col("p_size") % 8, jitter=250.0)
    return table(spark, sf, "part").select("p_partkey", delay.alias("delay_ms"))


def requests_of_events(spark, sf):
    """Events as a request log: the user's last digit is the site, errors are failures."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("site-"), (F.col("user_id") % 10).cast("string")).alias("site"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("response_ms"),
        k.alias("data_extracted"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT event_id AS id, 'site-' || (user_id % 10) AS site, event_type <> 'error' AS success,
    value AS response_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS data_extracted, ts,
    epoch_us(ts) // 1000 AS ms FROM events)
"""
HOUR = 3_600_000


@query(f"""
WITH {REQUESTS_SQL}, c AS (SELECT id, site, ms, count(*) OVER w AS in_window, count(*) OVER n AS in_burst,
  min(ms) OVER w AS oldest, min(ms) OVER n AS near FROM requests
  WINDOW w AS (PARTITION BY site ORDER BY ms RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW),
    n AS (PARTITION BY site ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW))
SELECT id, site, in_window, in_burst, in_window >= 6 AS over_limit, in_burst >= 3 AS over_burst,
  CASE WHEN in_window >= 6 THEN 21600000 - (ms - oldest) + 100 WHEN in_burst >= 3
    THEN 3600000 - (ms - near) + 100 ELSE 0 END AS wait_ms
FROM c
""")
def rate_audit(spark, sf):
    audit = rate.rate_window_audit(
        requests_of_events(spark, sf), max_requests=6, burst=3, window_ms=6 * HOUR, burst_ms=HOUR
    )
    return audit.select(
        "id", "site", "in_window", "in_burst", "over_limit", "over_burst", "wait_ms"
    )


@query(f"""
WITH {REQUESTS_SQL}, c AS (SELECT id, count(*) OVER w AS in_window, count(*) OVER n AS in_burst FROM requests
  WINDOW w AS (ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW),
    n AS (ORDER BY ms RANGE BETWEEN 599999 PRECEDING AND CURRENT ROW))
SELECT id, in_window, in_burst FROM c
""")
def rate_audit_global(spark, sf):
    """One limiter over the whole log, still split by time."""
    audit = rate.rate_window_audit(
        requests_of_events(spark, sf), window_ms=HOUR, burst_ms=HOUR // 6, by=[]
    )
    return audit.select("id", "in_window", "in_burst")


@query(f"""
WITH {REQUESTS_SQL}
SELECT site, count(*) AS in_window, 60 AS max_requests, count(*) / 60.0::DOUBLE AS utilization
FROM requests WHERE ms <= 1705000000000 AND 1705000000000 - ms < 86400000 GROUP BY site
""")
def rate_utilization(spark, sf):
    return rate.rate_utilization(
        requests_of_events(spark, sf), 1705000000000, window_ms=24 * HOUR, by=["site"]
    )


@query("""
SELECT lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS site, s_suppkey % 40 * 10 / 2 AS max_tokens,
  s_suppkey % 40 * 10 / 120 AS refill_rate, CAST(2000 AS DOUBLE) AS min_interval FROM supplier
""")
def bucket_params(spark, sf):
    return rate.bucket_params(supplier_configs(spark, sf))


def event_buckets(spark, sf):
    """Bucket of one token per hour and site-dependent size, as the log is sparse."""
    sites = requests_of_events(spark, sf).select("site").distinct()
    digit = F.substring("site", 6, 1).cast("double")
    return sites.select(
        "site", (F.lit(1.5) + digit).alias("max_tokens"), F.lit(1 / 3600).alias("refill_rate"),
        F.lit(2000.0).alias("min_interval"),
    )


BUCKET_SQL = f"""
{REQUESTS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY ms, id) AS n,
    CAST(substr(site, 6, 1) AS INT) + 1.5::DOUBLE AS size FROM requests),
walk AS (
  SELECT site, n, id, ms, size, CAST(size * 120000000 AS BIGINT) AS before FROM r WHERE n = 1
  UNION ALL
  SELECT r.site, r.n, r.id, r.ms, r.size, least(CAST(r.size * 120000000 AS BIGINT),
    before - CASE WHEN before >= 120000000 THEN 120000000 ELSE 0 END + (r.ms - walk.ms) * 33)
  FROM walk JOIN r ON r.site = walk.site AND r.n = walk.n + 1)
"""


@query(f"""
WITH RECURSIVE {BUCKET_SQL}
SELECT id, site, before AS level, before >= 120000000 AS admitted,
  CASE WHEN before >= 120000000 THEN 0
    ELSE floor(greatest((120000000 - before) / 33.0::DOUBLE, 2000)) END AS wait_ms
FROM walk
""")
def token_bucket(spark, sf):
    tagged = rate.token_bucket_tag(
        requests_of_events(spark, sf), event_buckets(spark, sf), slice_ms=24 * HOUR
    )
    return tagged.select(
        "id", "site", F.round(F.col("tokens") * rate.UNITS).cast("bigint").alias("level"), "admitted",
        F.floor("wait_ms").cast("double").alias("wait_ms"),
    )


@query(f"""
WITH RECURSIVE {BUCKET_SQL}, ends AS (SELECT site, arg_max(before, n) AS b FROM walk GROUP BY site)
SELECT site, b - CASE WHEN b >= 120000000 THEN 120000000 ELSE 0 END AS level
FROM ends
""")
def token_bucket_status(spark, sf):
    requests, params = requests_of_events(spark, sf), event_buckets(spark, sf)
    slices = rate.bucket_slices(requests, params, slice_ms=24 * HOUR)
    return rate.bucket_status(slices, params).select("site", "level")


_METRIC_SQL = """
  count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
  round(avg(response_ms), 4) AS avg_response_ms
"""


def _rounded(df):
    return df.withColumn("avg_response_ms", F.round("avg_response_ms", 4))


@query(f"""
WITH {REQUESTS_SQL}
SELECT site, {_METRIC_SQL}, strftime(max(ts) FILTER (success), '%Y-%m-%d %H:%M:%S') AS last_success,
  strftime(max(ts) FILTER (NOT success), '%Y-%m-%d %H:%M:%S') AS last_failure
FROM requests GROUP BY site
""")
def site_metrics(spark, sf):
    out = _rounded(monitor.site_metrics(requests_of_events(spark, sf)))
    for c in ["last_success", "last_failure"]:
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


@query(f"""
WITH {REQUESTS_SQL}
SELECT site, {_METRIC_SQL}, CAST(sum(data_extracted) FILTER (success) AS BIGINT) AS data_extracted,
  grouping(site) = 1 AS is_total
FROM requests GROUP BY GROUPING SETS ((site), ())
""")
def metrics_with_total(spark, sf):
    return _rounded(monitor.metrics_with_total(requests_of_events(spark, sf))).drop(
        "last_success", "last_failure"
    )


@query(f"""
WITH {REQUESTS_SQL}
SELECT {_METRIC_SQL}, CAST(sum(data_extracted) FILTER (success) AS BIGINT) AS data_extracted FROM requests
""")
def global_metrics(spark, sf):
    return _rounded(monitor.global_metrics(requests_of_events(spark, sf)))


POINTS_SQL = f"""
{REQUESTS_SQL}, points AS (
  SELECT 'request_duration' AS name, 'timer' AS type, response_ms AS value, ts, site, success FROM requests
  UNION ALL SELECT 'requests_total', 'counter', 1, ts, site, success FROM requests
  UNION ALL SELECT 'data_extracted', 'counter', data_extracted, ts, site, NULL FROM requests
    WHERE data_extracted <> 0)
"""


@query(f"""
WITH {POINTS_SQL}
SELECT name, type, site, CAST(success AS VARCHAR) AS success, count(*) AS n, round(sum(value), 2) AS total
FROM points GROUP BY ALL
""")
def metric_points(spark, sf):
    points = monitor.to_metric_points(requests_of_events(spark, sf))
    return points.groupBy(
        "name", "type", F.col("tags")["site"].alias("site"), F.col("tags")["success"].alias("success")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""
WITH {POINTS_SQL}
SELECT strftime(ts, '%Y-%m-%d') AS dt, name, type, site, CAST(success AS VARCHAR) AS success, count(*) AS n,
  round(sum(value), 2) AS total
FROM points GROUP BY ALL
""")
def metric_files_by_day(spark, sf):
    """Metric points written as daily JSON lines and read back."""
    path = scratch(spark, "metrics")
    log_files.write_metrics(monitor.to_metric_points(requests_of_events(spark, sf)), path)
    tags = F.col("tags")
    return log_files.read_metrics(spark, path).groupBy(
        F.date_format("timestamp", "yyyy-MM-dd").alias("dt"), "name", "type", tags["site"].alias("site"),
        tags["success"].alias("success"),
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""
WITH {POINTS_SQL}
SELECT coalesce(sum(value), 0) AS requests_per_minute FROM points
WHERE name = 'requests_total' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 60 SECONDS
""")
def requests_per_minute(spark, sf):
    requests = requests_of_events(spark, sf)
    last = requests.agg(F.max("ts")).first()[0]
    return monitor.requests_per_minute(monitor.to_metric_points(requests), last)


@query("""
SELECT event_type || ' ' || event_id AS message, 'user-' || user_id AS source FROM events
WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def recent_logs(spark, sf):
    return monitor.recent_logs(event_logs(spark, sf), 100, "warn").select("message", "source")


@query(f"""
WITH {POINTS_SQL}
SELECT site, count(*) AS n, round(sum(value), 2) AS total FROM points
WHERE name = 'request_duration' AND ts BETWEEN '2024-01-05' AND '2024-01-12' GROUP BY site
""")
def metrics_between(spark, sf):
    points = monitor.to_metric_points(requests_of_events(spark, sf))
    kept = monitor.metrics_between(
        points, "2024-01-05 00:00:00", "2024-01-12 00:00:00", "request_duration"
    )
    return kept.groupBy(F.col("tags")["site"].alias("site")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


def _issues(spark, sf):
    kind = F.col("event_type")
    named = (
        F.when(kind == "error", F.lit("rate_limit"))
        .when(kind == "signup", F.lit("duplicate"))
        .when(kind == "purchase", F.lit("validation_error"))
        .when(kind == "view", F.lit("image_failure"))
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("site-"), (F.col("user_id") % 10).cast("string")).alias("site"),
        named.alias("type"),
    )


@query("""
SELECT 'site-' || (user_id % 10) AS site, count(*) FILTER (event_type = 'error') AS rate_limit,
  count(*) FILTER (event_type = 'signup') AS duplicate,
  count(*) FILTER (event_type = 'purchase') AS validation_error,
  count(*) FILTER (event_type = 'view') AS image_failure
FROM events GROUP BY 1
""")
def issue_counts(spark, sf):
    return monitor.issue_counts(_issues(spark, sf))


@query(f"""
WITH {REQUESTS_SQL} SELECT id, site FROM requests ORDER BY ts DESC, id DESC LIMIT 1000
""")
def keep_latest(spark, sf):
    return monitor.keep_latest(requests_of_events(spark, sf), 1000, ["ts", "id"]).select("id", "site")


@query(f"""
WITH {REQUESTS_SQL}
SELECT count(*) AS total_processed, count(*) FILTER (success) AS successful,
  count(*) FILTER (NOT success) AS failed, round(avg(response_ms), 4) AS average_processing_ms,
  7 AS rate_limit_hits, 3600000 AS uptime_ms FROM requests
""")
def run_stats(spark, sf):
    results = requests_of_events(spark, sf).withColumnRenamed("response_ms", "processing_ms")
    stats = monitor.run_stats(results, NOW, "2024-02-29 23:00:00", 7)
    return stats.withColumn("average_processing_ms", F.round("average_processing_ms", 4))


def _report(spark, sf):
    last = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return monitor.performance_report(
        requests_of_events(spark, sf), _issues(spark, sf), event_logs(spark, sf), last
    )


_RATE_SQL = "printf('%.2f%%', count(*) FILTER (success) / count(*) * 100)"


@query(f"""
WITH {REQUESTS_SQL}, last AS (SELECT max(ts) AS t FROM events)
SELECT count(*) AS requests, {_RATE_SQL} AS success_rate,
  CAST(floor(avg(response_ms) + 0.5) AS BIGINT) || 'ms' AS avg_response_time,
  CAST(sum(data_extracted) FILTER (success) AS BIGINT) AS data_extracted,
  count(*) FILTER (ts >= t - INTERVAL 60 SECONDS) AS requests_per_minute,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS rate_limit_hits,
  (SELECT count(*) FROM events WHERE event_type = 'signup') AS duplicates,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS validation_errors,
  (SELECT count(*) FROM events WHERE event_type = 'view') AS image_failures
FROM requests, last
""")
def report_summary(spark, sf):
    return _report(spark, sf)["summary"]


@query(f"""
WITH {REQUESTS_SQL}
SELECT site, count(*) AS requests, {_RATE_SQL} AS success_rate,
  CAST(floor(avg(response_ms) + 0.5) AS BIGINT) || 'ms' AS avg_response_time,
  strftime(date_trunc('millisecond', max(ts) FILTER (success)), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_success,
  strftime(date_trunc('millisecond', max(ts) FILTER (NOT success)), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_failure
FROM requests GROUP BY site
""")
def report_sites(spark, sf):
    return _report(spark, sf)["site_breakdown"]


@query("""
SELECT event_type || ' ' || event_id AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 20
""")
def report_recent(spark, sf):
    return _report(spark, sf)["recent_activity"].select("message")


@query(f"""
WITH {REQUESTS_SQL}, last AS (SELECT max(ts) AS t FROM events)
SELECT count(*) FILTER (ts >= t - INTERVAL 1 HOUR) AS hourly_requests,
  count(*) FILTER (ts >= t - INTERVAL 1 HOUR AND NOT success) AS hourly_failures FROM requests, last
""")
def report_trends(spark, sf):
    return _report(spark, sf)["trends"]


def _image_table(spark, sf):
    """Documents as image contents."""
    k = F.col("doc_id")
    kinds = ["image/jpeg", "image/png", "image/webp", "image/gif", "text/html", "image/svg+xml"]
    names = ["/img/", "/files/a.PNG?", "/files/", "/photo/b.jpg#", "/x.svg?"]
    return table(spark, sf, "documents").select(
        F.concat(F.lit("p"), (k % 50).cast("string")).alias("product_id"),
        F.concat(
            F.lit("https://img.example.com"),
            F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int")),
            k.cast("string"),
        ).alias("url"),
        F.element_at(F.array(*map(F.lit, kinds)), (k % 6 + 1).cast("int")).alias("content_type"),
        (F.octet_length("text") * 300).cast("bigint").alias("size"),
        F.encode("text", "UTF-8").alias("content"),
        "doc_id",
    )


IMAGES_SQL = """
img AS (
  SELECT doc_id, 'p' || (doc_id % 50) AS product_id, 'https://img.example.com'
    || list_extract(['/img/', '/files/a.PNG?', '/files/', '/photo/b.jpg#', '/x.svg?'], CAST(doc_id % 5 + 1 AS INT))
    || doc_id AS url, list_extract(['image/jpeg', 'image/png', 'image/webp', 'image/gif', 'text/html',
    'image/svg+xml'], CAST(doc_id % 6 + 1 AS INT)) AS content_type,
    list_extract(['.jpg', '.png', '.webp', '.gif', '.jpg', '.svg'], CAST(doc_id % 6 + 1 AS INT)) AS ext,
    strlen(text) * 300 AS size, text FROM documents)
"""


@query(f"""
WITH {IMAGES_SQL}
SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'Invalid image URL'
  WHEN content_type IN ('image/gif', 'text/html') THEN 'Unsupported image type ' || content_type
  WHEN size > 10485760 THEN 'Image too large (' || size || ' bytes)' END AS reason
FROM img
""")
def image_checks(spark, sf):
    return images.check_images(_image_table(spark, sf)).select("doc_id", "reason")


@query(f"""
WITH {IMAGES_SQL}
SELECT product_id || '_' || md5(text) || ext AS filename, min(strlen(text)) AS size, md5(text) AS hash
FROM img WHERE doc_id % 5 <> 2 AND content_type NOT IN ('image/gif', 'text/html') AND size <= 10485760
  AND product_id || '_' || md5(text) || ext NOT IN (SELECT product_id || '_' || md5(text) || ext FROM img
    WHERE doc_id % 3 = 0)
GROUP BY ALL
""")
def image_manifest(spark, sf):
    """Accepted images that are not stored yet."""
    source = _image_table(spark, sf)
    accepted, _ = images.accept_images(source)
    manifest = images.image_manifest(accepted, "/data/images", NOW)
    stored = images.image_manifest(source.filter("doc_id % 3 = 0"), "/data/images", NOW)
    return images.new_images(manifest, stored).select("filename", "size", "hash")


@query("""
SELECT 'acme-' || p_partkey AS product_id, unnest(['https://img.example.com/' || p_partkey || '-a.jpg',
  'https://img.example.com/' || p_partkey || '-b.jpg']) AS url FROM part WHERE p_size % 4 > 0
""")
def image_jobs(spark, sf):
    key = F.col("p_partkey").cast("string")
    url = F.concat(F.lit("https://img.example.com/"), key)
    products = table(spark, sf, "part").select(
        F.concat(F.lit("acme-"), key).alias("id"),
        F.when(
            F.col("p_size") % 4 > 0,
            F.array(F.concat(url, F.lit("-a.jpg")), F.concat(url, F.lit("-b.jpg"))),
        ).alias("images"),
    )
    return images.image_jobs(products)
