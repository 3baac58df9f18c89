"""The URL frontier as a table: one row per URL with its status.

Columns: id, url, site, priority, retry_count, created_at, scheduled_at, status, seq, metadata.
``created_at`` and ``seq`` give the order of arrival; retries keep them and go to the front by
``retried_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright import schemas
from shelfwright.operators.lookup import bounded_broadcast

# Defaults of the queue.
DEFAULT_PRIORITY = 5
MAX_RETRIES = 3
RETRY_DELAY_MS = 5000
RATE_LIMIT_DELAY_MS = 1000
MAX_CONCURRENT = 3
ITEM_MS = 5000
BACKOFF_CAP_MS = 30000


def _time(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")


def enqueue(
    frontier: DataFrame | None, urls: DataFrame, as_of, default_priority: int = DEFAULT_PRIORITY
) -> DataFrame:
    """Add URLs (url, site, seq, optional priority and metadata) as pending entries.

    A missing priority and 0 both become the default.
    """
    given = F.col("priority") if "priority" in urls.columns else F.lit(None).cast("int")
    metadata = F.col("metadata") if "metadata" in urls.columns else F.lit(None)
    now = _time(as_of)
    new = urls.select(
        # Wide enough to be a key of any number of entries.
        F.sha2(F.concat_ws("\n", "url", F.unix_micros(now).cast("string"), F.col("seq").cast("string")), 256).alias("id"),
        "url",
        "site",
        F.coalesce(F.nullif(given, F.lit(0)), F.lit(default_priority)).cast("int").alias("priority"),
        F.lit(0).alias("retry_count"),
        now.alias("created_at"),
        now.alias("scheduled_at"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("retried_at"),
        F.col("seq").cast("bigint").alias("seq"),
        metadata.cast(schemas.STRING_MAP).alias("metadata"),
    )
    return new if frontier is None else frontier.unionByName(new)


def _queue_order() -> list[Column]:
    """Retries first, the latest in front; then priority, then arrival."""
    return [
        F.col("retried_at").desc_nulls_last(),
        F.col("priority").desc(),
        F.col("created_at").asc(),
        F.col("seq").asc(),
        F.col("id").asc(),
    ]


def next_batch(
    frontier: DataFrame, as_of, k: int | None = None, per_site: DataFrame | int | None = None,
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """The next ready entries.

    ``k`` defaults to the free slots: ``max_concurrent`` less the entries in process. ``per_site``
    caps the entries of one site, by a number or by a table (site, cap). The per-site ranking and
    the top-k are both limited before their shuffle.
    """
    if k is None:
        busy = frontier.filter(F.col("status") == "processing").limit(max_concurrent).count()
        k = max_concurrent - busy
    ready = frontier.filter(
        (F.col("status") == "pending") & (F.col("scheduled_at") <= _time(as_of))
    )
    if per_site is not None:
        rank = F.row_number().over(Window.partitionBy("site").orderBy(*_queue_order()))
        if isinstance(per_site, int):
            ready = ready.withColumn("_r", rank).filter(F.col("_r") <= min(per_site, k)).drop("_r")
        else:
            caps = bounded_broadcast(per_site.select("site", F.col("cap").alias("_cap")))
            # No site can fill more than k slots, so rank k is a safe first limit.
            ready = (
                ready.withColumn("_r", rank)
                .filter(F.col("_r") <= k)
                .join(caps, "site", "left")
                .filter(F.col("_cap").isNull() | (F.col("_r") <= F.col("_cap")))
                .drop("_r", "_cap")
            )
    return ready.orderBy(*_queue_order()).limit(k)


def start(frontier: DataFrame, batch: DataFrame) -> DataFrame:
    """Mark the entries of a batch as in process."""
    ids = bounded_broadcast(batch.select("id").withColumn("_go", F.lit(True)))
    return (
        frontier.join(ids, "id", "left")
        .withColumn("status", F.when(F.col("_go"), F.lit("processing")).otherwise(F.col("status")))
        .drop("_go")
        .select(*frontier.columns)
    )


def _note(condition: Column, key: str, value: Column) -> Column:
    """Metadata with one key set where the condition holds."""
    old = F.coalesce(F.col("metadata"), F.create_map().cast(schemas.STRING_MAP))
    kept = F.map_filter(old, lambda k, v: k != key)
    return F.when(condition, F.map_concat(kept, F.create_map(F.lit(key), value))).otherwise(
        F.col("metadata")
    )


def apply_failures(
    frontier: DataFrame, failures: DataFrame, as_of,
    max_retries: int = MAX_RETRIES, retry_delay_ms: int = RETRY_DELAY_MS,
) -> DataFrame:
    """Entries in process that failed (id, error) are retried with doubled delay, or failed."""
    joined = frontier.join(failures.select("id", F.col("error").alias("_error")), "id", "left")
    failed = F.coalesce(
        (F.col("status") == "processing") & F.col("_error").isNotNull(), F.lit(False)
    )
    again = failed & (F.col("retry_count") < max_retries)
    final = failed & ~again
    now = _time(as_of)
    delay = F.lit(retry_delay_ms) * F.pow(F.lit(2.0), F.col("retry_count"))
    due = F.timestamp_millis(F.unix_millis(now) + delay.cast("bigint"))
    # One step, as every expression reads the state before the failure.
    return joined.withColumns(
        {
            "metadata": _note(final, "error", F.col("_error")),
            "scheduled_at": F.when(again, due).otherwise(F.col("scheduled_at")),
            "retried_at": F.when(again, now).otherwise(F.col("retried_at")),
            "status": F.when(again, F.lit("pending"))
            .when(final, F.lit("failed"))
            .otherwise(F.col("status")),
            "retry_count": F.col("retry_count") + F.when(again, 1).otherwise(0),
        }
    ).select(*frontier.columns)


def apply_completions(frontier: DataFrame, done: DataFrame) -> DataFrame:
    """Entries in process that are done (id, result) become completed."""
    joined = frontier.join(
        done.select("id", F.col("result").alias("_result"), F.lit(True).alias("_done")), "id", "left"
    )
    hit = F.coalesce((F.col("status") == "processing") & F.col("_done"), F.lit(False))
    return joined.withColumns(
        {
            "metadata": _note(hit, "result", F.col("_result").cast("string")),
            "status": F.when(hit, F.lit("completed")).otherwise(F.col("status")),
        }
    ).select(*frontier.columns)


def frontier_stats(frontier: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("status") == s).alias(s)
        for s in ["pending", "processing", "completed", "failed"]
    ]
    return frontier.agg(*counts, F.count(F.lit(1)).alias("total"))


def frontier_items(frontier: DataFrame, status: str) -> DataFrame:
    if status == "retry":
        return frontier.filter((F.col("status") == "pending") & (F.col("retry_count") > 0))
    return frontier.filter(F.col("status") == status)


def remove_pending(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the given ids, but only where the entry is pending."""
    gone = ids.select("id").withColumn("status", F.lit("pending"))
    return frontier.join(gone, ["id", "status"], "left_anti").select(*frontier.columns)


def eta_ms(
    frontier: DataFrame, rate_limit_delay_ms: int = RATE_LIMIT_DELAY_MS,
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """Estimated milliseconds until the frontier is empty; 0 when it is."""
    left = F.count_if(F.col("status").isin("pending", "processing"))
    per_item = rate_limit_delay_ms + ITEM_MS
    return frontier.agg(
        F.ceil(left * F.lit(float(per_item)) / F.lit(float(max_concurrent))).alias("eta_ms")
    )


def expand_frontier(frontier: DataFrame, links: DataFrame, as_of) -> DataFrame:
    """Grow the frontier from discovered links (page_url, link, kind, pos).

    Product links get the priority of their page plus one, a next page the same priority. Links
    of one page arrive in page order; the order between pages of one step is fixed but free.
    """
    parents = frontier.select(
        F.col("url").alias("page_url"), "site", "priority", "metadata"
    )
    found = links.filter(F.col("kind").isin("product", "next")).join(parents, "page_url")
    is_product = F.col("kind") == "product"
    base = F.coalesce(F.nullif(F.col("priority"), F.lit(0)), F.lit(DEFAULT_PRIORITY))
    note = F.when(
        is_product,
        F.create_map(
            F.lit("discoveredFrom"), F.col("page_url"), F.lit("pageType"), F.lit("product")
        ),
    ).otherwise(
        F.create_map(
            F.lit("parentUrl"), F.col("page_url"), F.lit("pageType"), F.lit("collection")
        )
    )
    keys = F.map_keys(note)
    old = F.map_filter(
        F.coalesce(F.col("metadata"), F.create_map().cast(schemas.STRING_MAP)),
        lambda k, v: ~F.array_contains(keys, k),
    )
    new = found.select(
        F.col("link").alias("url"),
        "site",
        (base + F.when(is_product, 1).otherwise(0)).alias("priority"),
        # 40 bits of page, 20 bits of position on the page.
        (
            F.shiftleft(F.xxhash64("page_url").bitwiseAND(F.lit((1 << 40) - 1)), 20)
            + F.col("pos")
        ).alias("seq"),
        F.map_concat(old, note).alias("metadata"),
    )
    return enqueue(frontier, new, as_of)


def backoff_ms(attempt: Column, base: int = 1000, jitter: Column | float = 0.0) -> Column:
    extra = jitter if isinstance(jitter, Column) else F.lit(jitter)
    delay = F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1) + extra
    return F.least(delay, F.lit(float(BACKOFF_CAP_MS)))
