"""Aggregates over request logs, metric points and log entries.

Requests: site, success, response_ms, data_extracted, ts. Means are taken in one pass; the totals
and the per-site figures come from one set of grouping sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import js

MAX_LOG_ENTRIES = 10_000
MAX_METRIC_ENTRIES = 50_000


def _time(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")


def _request_aggregates() -> list[Column]:
    ok = F.col("success")
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.avg("response_ms").alias("avg_response_ms"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
        F.coalesce(F.sum(F.when(ok, F.col("data_extracted"))), F.lit(0)).alias("data_extracted"),
    ]


def site_metrics(requests: DataFrame) -> DataFrame:
    return requests.groupBy("site").agg(*_request_aggregates()).drop("data_extracted")


def metrics_with_total(requests: DataFrame) -> DataFrame:
    """Per-site rows and one total row (``is_total``) from one pass."""
    grouped = requests.groupingSets([["site"], []], "site").agg(
        F.grouping("site").alias("_g"), *_request_aggregates()
    )
    return grouped.withColumn("is_total", F.col("_g") == 1).drop("_g")


def global_metrics(requests: DataFrame) -> DataFrame:
    return requests.agg(*_request_aggregates()).drop("last_success", "last_failure")


def requests_per_minute(metrics: DataFrame, as_of) -> DataFrame:
    """Requests counted by metric points in the minute before a time, its start included."""
    now = _time(as_of)
    recent = metrics.filter(
        (F.col("name") == "requests_total")
        & (F.col("timestamp") >= now - F.expr("INTERVAL 60 SECONDS"))
        & (F.col("timestamp") <= now)
    )
    return recent.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("requests_per_minute"))


def to_metric_points(requests: DataFrame) -> DataFrame:
    """Duration, request count and extracted data of each request as metric points."""
    tags = F.create_map(
        F.lit("site"), F.col("site"), F.lit("success"), F.col("success").cast("string")
    )
    site_only = F.create_map(F.lit("site"), F.col("site"))

    def point(name: str, kind: str, value: Column, labels: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(kind).alias("type"),
            value.cast("double").alias("value"),
            F.col("ts").alias("timestamp"),
            labels.alias("tags"),
        )

    extracted = F.coalesce(F.col("data_extracted"), F.lit(0))
    points = F.array(
        point("request_duration", "timer", F.col("response_ms"), tags),
        point("requests_total", "counter", F.lit(1), tags),
        F.when(extracted != 0, point("data_extracted", "counter", extracted, site_only)),
    )
    return requests.select(F.explode(F.array_compact(points)).alias("p")).select("p.*")


def level_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in K.LEVEL_RANKS.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def recent_logs(
    logs: DataFrame, n: int = 100, level: str | None = None, tie: list[str] = ()
) -> DataFrame:
    """The newest ``n`` entries of at least a level; ``tie`` orders equal times, latest last."""
    kept = logs
    if level:
        kept = logs.filter(level_rank(F.col("level")) >= K.LEVEL_RANKS[level])
    return keep_latest(kept, n, ["timestamp", *tie])


def metrics_between(metrics: DataFrame, start=None, end=None, name: str | None = None) -> DataFrame:
    out = metrics
    if start is not None:
        out = out.filter(F.col("timestamp") >= _time(start))
    if end is not None:
        out = out.filter(F.col("timestamp") <= _time(end))
    if name is not None:
        out = out.filter(F.col("name") == name)
    return out


def issue_counts(issues: DataFrame) -> DataFrame:
    """Rate-limit hits and quality issues (site, type) by site, one column per type."""
    # The issue types.
    kinds = ["rate_limit", "duplicate", "validation_error", "image_failure"]
    return issues.groupBy("site").agg(
        *[F.count_if(F.col("type") == kind).alias(kind) for kind in kinds]
    )


def keep_latest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest ``n`` rows: a top-n, so each task keeps at most ``n``."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def run_stats(results: DataFrame, as_of, started_at, rate_limit_hits: int = 0) -> DataFrame:
    """Processed, successful, failed, mean time and uptime of a run (success, processing_ms)."""
    uptime = F.unix_millis(_time(as_of)) - F.unix_millis(_time(started_at))
    return results.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.avg("processing_ms"), F.lit(0.0)).alias("average_processing_ms"),
    ).select(
        "*", F.lit(rate_limit_hits).cast("bigint").alias("rate_limit_hits"), uptime.alias("uptime_ms")
    )


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row from tables of at most one row each, with the columns of all of them."""
    names = [c for row in rows for c in row.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def performance_report(
    requests: DataFrame, issues: DataFrame, logs: DataFrame, as_of
) -> dict[str, DataFrame]:
    """Summary, site breakdown, recent activity and trends as of a time."""
    now = _time(as_of)
    hour_ago = now - F.expr("INTERVAL 1 HOUR")
    minute_ago = now - F.expr("INTERVAL 60 SECONDS")
    both = metrics_with_total(requests)
    shown = both.select(
        "site",
        "is_total",
        "requests",
        js.fixed_percent(F.col("successes"), F.col("requests")).alias("success_rate"),
        F.concat(
            F.coalesce(F.floor(F.col("avg_response_ms") + 0.5), F.lit(0)).cast("string"), F.lit("ms")
        ).alias("avg_response_time"),
        js.iso_utc(F.col("last_success")).alias("last_success"),
        js.iso_utc(F.col("last_failure")).alias("last_failure"),
        "data_extracted",
    )
    recent = requests.agg(
        F.count_if((F.col("ts") >= minute_ago) & (F.col("ts") <= now)).alias("requests_per_minute"),
        F.count_if(F.col("ts") >= hour_ago).alias("hourly_requests"),
        F.count_if((F.col("ts") >= hour_ago) & ~F.col("success")).alias("hourly_failures"),
    )
    troubles = issues.agg(
        F.count_if(F.col("type") == "rate_limit").alias("rate_limit_hits"),
        F.count_if(F.col("type") == "duplicate").alias("duplicates"),
        F.count_if(F.col("type") == "validation_error").alias("validation_errors"),
        F.count_if(F.col("type") == "image_failure").alias("image_failures"),
    )
    total = shown.filter("is_total").drop("site", "is_total", "last_success", "last_failure")
    nothing = {
        "requests": 0, "success_rate": "0%", "avg_response_time": "0ms", "data_extracted": 0,
    }
    # An empty log has no total row.
    summary = side_by_side(total, recent.select("requests_per_minute"), troubles).fillna(nothing)
    return {
        "summary": summary,
        "site_breakdown": shown.filter("NOT is_total").drop("is_total", "data_extracted"),
        "recent_activity": recent_logs(logs, 20, tie=[c for c in ("source", "level", "message") if c in logs.columns]),
        "trends": recent.select("hourly_requests", "hourly_failures"),
    }
