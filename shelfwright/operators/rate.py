"""Rate limits applied to a request log (site, ms, and an id that orders equal times).

A site, and a moment, may hold a large share of the log, so no step gathers the rows of one in one task: requests of one
site and millisecond are one row with a count. Sliding windows are sums of what came and left, over short cells of time. The
token bucket is a state machine; each slice is first reduced to its effect on the bucket, the
effects are chained per site, and then every slice runs on its own from its true start level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.operators.lookup import bounded_broadcast

# Limits of the global and of the per-site limiter.
# Length of the time cells that windows are summed over where traffic is dense, and the rows above which it is.
CELL_MS = 10_000
CELL_ROWS = 30_000
# Different times, in milliseconds, of one slice that one task walks through.
SLICE_ROWS = 50_000
MAX_REQUESTS = 60
BURST_LIMIT = 10
WINDOW_MS = 60_000
BURST_MS = 10_000
WAIT_MARGIN_MS = 100
MAX_TOKENS = 5.0
REFILL_RATE = 0.5
MIN_INTERVAL_MS = 2000.0

# Bucket levels are whole numbers of these units per token, so that slices add up exactly.
UNITS = 120_000_000


def _celled(events: DataFrame, by: list[str], cell_ms: int, cell_rows: int) -> DataFrame:
    """Events (``_t``) with their ``_cell``, whose numbers rise with time."""
    coarse = F.floor(F.col("_t") / cell_ms)
    crowded = (
        events.groupBy(*by, coarse.alias("_coarse")).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > cell_rows)
        .select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_coarse").alias("_full"))
    )
    same = F.col("_coarse") == F.col("_full")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    short = F.floor((F.col("_t") - F.col("_coarse") * cell_ms) / CELL_MS)
    fine = F.when(F.col("_full").isNotNull(), short).otherwise(F.lit(0))
    joined = events.withColumn("_coarse", coarse).join(bounded_broadcast(crowded), same, "left")
    return joined.withColumn("_cell", F.col("_coarse") * (1 << 20) + fine).drop("_coarse", "_full", *[f"_{c}" for c in by])


def rate_window_audit(
    requests: DataFrame,
    max_requests: int = MAX_REQUESTS,
    burst: int = BURST_LIMIT,
    window_ms: int = WINDOW_MS,
    burst_ms: int = BURST_MS,
    by: list[str] = ("site",),
    cell_ms: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Requests in the window and in the burst span up to each request, with wait estimates.

    Adds in_window, in_burst, over_limit, over_burst and wait_ms. ``by=[]`` audits the whole log as one limiter. Requests
    without a time are left out.

    Requests of one millisecond are one row first. Each such row comes into both spans at its time and leaves them a span
    later; what is in a span is the sum of what came and left before. Sums run over cells of time, ``cell_ms`` long (by default
    the burst span); a cell of more than ``cell_rows`` rows is cut into cells of ``CELL_MS``, which hold at most three rows a
    millisecond. A cell starts from the sums of all cells before it, one short row a cell. So no task of the
    sums has more rows than that, whatever the traffic.
    """
    by = list(by)
    timed = requests.filter(F.col("ms").isNotNull())
    spans = (("wide", window_ms), ("near", burst_ms))
    came = timed.groupBy(*by, "ms").agg(F.count(F.lit(1)).alias("_n"))
    moves = [F.struct(F.col("ms").alias("t"), F.lit("came").alias("kind"))]
    moves += [F.struct((F.col("ms") + span).alias("t"), F.lit(name).alias("kind")) for name, span in spans]
    events = came.select(*by, "ms", "_n", F.explode(F.array(*moves)).alias("_e")).select(
        *by, "ms", "_n", F.col("_e.t").alias("_t"), F.col("_e.kind").alias("_kind"),
    )
    events = _celled(events, by, cell_ms or max(CELL_MS, burst_ms), cell_rows)

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("_kind") == kind, value)

    none = F.lit(0)
    cells = events.groupBy(*by, "_cell").agg(
        F.sum(of("came", F.col("_n"))).alias("came"),
        *[F.sum(of(name, F.col("_n"))).alias(f"left_{name}") for name, _ in spans],
        *[F.min(of(name, F.col("ms"))).alias(f"first_{name}") for name, _ in spans],
    )
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        *by, "_cell", F.lit("start").alias("_kind"),
        *[
            F.coalesce(F.sum(F.coalesce("came", none) - F.coalesce(f"left_{name}", none)).over(before), none).alias(f"_in_{name}")
            for name, _ in spans
        ],
        *[F.last(f"first_{name}", ignorenulls=True).over(behind).alias(f"_next_{name}") for name, _ in spans],
    )
    rows = events.unionByName(starts, allowMissingColumns=True)
    # One order serves all sums: what a cell holds up to a time is all it holds without what comes after.
    cell = Window.partitionBy(*by, "_cell")
    after = cell.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)

    def up_to(kind: str) -> Column:
        value = F.coalesce(of(kind, F.col("_n")), none)
        return F.sum(value).over(cell) - F.coalesce(F.sum(value).over(after), none)

    def inside(name: str) -> Column:
        return F.max(f"_in_{name}").over(cell) + up_to("came") - up_to(name)

    def oldest(name: str) -> Column:
        """The first request that has not left: the next one to leave, in this cell or a later one."""
        return F.coalesce(F.min(of(name, F.col("ms"))).over(after), F.max(f"_next_{name}").over(cell))

    counted = rows.select(
        *by, "ms", "_kind", inside("wide").alias("in_window"), inside("near").alias("in_burst"),
        oldest("wide").alias("_oldest"), oldest("near").alias("_oldest_near"),
    ).filter(F.col("_kind") == "came")
    over, over_burst = F.col("in_window") >= max_requests, F.col("in_burst") >= burst
    wait = (
        F.when(over, window_ms - (F.col("ms") - F.col("_oldest")) + WAIT_MARGIN_MS)
        .when(over_burst, burst_ms - (F.col("ms") - F.col("_oldest_near")) + WAIT_MARGIN_MS)
        .otherwise(F.lit(0))
    )
    told = counted.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("ms").alias("_ms"), "in_window", "in_burst",
        over.alias("over_limit"), over_burst.alias("over_burst"), wait.cast("bigint").alias("wait_ms"),
    )
    same = F.col("ms") == F.col("_ms")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return timed.join(told, same).drop("_ms", *[f"_{c}" for c in by])


def rate_utilization(
    requests: DataFrame, as_of_ms: int, max_requests: int = MAX_REQUESTS,
    window_ms: int = WINDOW_MS, by: list[str] = (),
) -> DataFrame:
    """Requests in the window that ends at a time, and their share of the limit."""
    recent = (F.col("ms") <= as_of_ms) & (F.lit(as_of_ms) - F.col("ms") < window_ms)
    counted = requests.filter(recent).groupBy(*by).agg(F.count(F.lit(1)).alias("in_window"))
    return counted.withColumn("max_requests", F.lit(max_requests).cast("bigint")).withColumn(
        "utilization", F.col("in_window") / F.lit(float(max_requests))
    )


def bucket_params(sites: DataFrame) -> DataFrame:
    """Bucket size, refill per second and least interval per site, from the rate limits."""
    rpm = F.col("rate_limit.requests_per_minute")
    return sites.select(
        F.col("name").alias("site"),
        F.coalesce(rpm / 2.0, F.lit(MAX_TOKENS)).alias("max_tokens"),
        F.coalesce(rpm / 120.0, F.lit(REFILL_RATE)).alias("refill_rate"),
        F.coalesce(F.col("rate_limit.delay_between_requests"), F.lit(MIN_INTERVAL_MS)).alias(
            "min_interval"
        ),
    )


def _effect(ms: np.ndarray, counts: np.ndarray, start: int, cap: int, rate: int) -> tuple[list, list, list]:
    """What a slice does to a start level: pieces (from, shift, fixed level or -1).

    A level x in a piece ends at the fixed level, or at x + shift. ``start`` is the slice start. Of the requests of one time no
    more than a full bucket can take a token, so the others change nothing.
    """
    lows, shifts, fixed = [0], [0], [-1]
    now = start
    most = cap // UNITS + 1
    for t, gain in _steps(ms, counts, start, most):
        gain *= rate
        now = max(now, t)
        nl, ns, nf = [], [], []
        for k, low in enumerate(lows):
            high = lows[k + 1] - 1 if k + 1 < len(lows) else cap
            if fixed[k] >= 0:
                level = min(cap, fixed[k] + gain)
                parts = [(low, 0, level - UNITS if level >= UNITS else level)]
            else:
                shift = shifts[k] + gain
                parts = []
                # Start levels below one token, from one token to full, and beyond full.
                one, full = UNITS - shift, cap - shift
                if low < min(one, full):
                    parts.append((low, shift, -1))
                if high >= one and max(low, one) < full:
                    parts.append((max(low, one), shift - UNITS, -1))
                if high >= full:
                    top = cap - UNITS if cap >= UNITS else cap
                    parts.append((max(low, full), 0, top))
            for part in parts:
                same = nl and ns[-1] == part[1] and nf[-1] == part[2]
                if not same:
                    nl.append(part[0])
                    ns.append(part[1])
                    nf.append(part[2])
        lows, shifts, fixed = nl, ns, nf
    return lows, shifts, fixed


def _steps(ms: np.ndarray, counts: np.ndarray, start: int, most: int) -> Iterator[tuple[int, int]]:
    """(time, time since the one before) of each request that can matter."""
    now = start
    for t, n in zip(ms.tolist(), counts.tolist(), strict=True):
        yield t, max(0, t - now)
        now = max(now, t)
        for _ in range(min(n, most) - 1):
            yield t, 0


def _run(ms: np.ndarray, counts: np.ndarray, start_ms: int, level: int, cap: int, rate: int) -> np.ndarray:
    """Levels before the first request of each time."""
    before = np.empty(len(ms), dtype=np.int64)
    now = start_ms
    for k, (t, n) in enumerate(zip(ms.tolist(), counts.tolist(), strict=True)):
        level = min(cap, level + max(0, t - now) * rate)
        now = max(now, t)
        before[k] = level
        level -= min(n, level // UNITS) * UNITS
    return before


_EFFECT = (
    "site string, slice bigint, first_ms bigint, last_ms bigint, cap bigint, rate bigint,"
    " lows array<bigint>, shifts array<bigint>, fixed array<bigint>"
)


def _slice_effect(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ms")
    ms, cap, rate = pdf["ms"].to_numpy(), int(pdf["cap"].iat[0]), int(pdf["rate"].iat[0])
    lows, shifts, fixed = _effect(ms, pdf["n"].to_numpy(), int(ms[0]), cap, rate)
    row = (pdf["site"].iat[0], pdf["slice"].iat[0], ms[0], ms[-1], cap, rate, lows, shifts, fixed)
    return pd.DataFrame([row], columns=[c.split()[0] for c in _EFFECT.split(",")])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start level of every slice of one site; reads one short row per slice."""
    pdf = pdf.sort_values("slice")
    cap, rate = int(pdf["cap"].iat[0]), int(pdf["rate"].iat[0])
    level = int(pdf["level0"].iat[0])
    now = int(pdf["ms0"].iat[0]) if pdf["ms0"].iat[0] >= 0 else int(pdf["first_ms"].iat[0])
    starts, ends = [], []
    for row in pdf.itertuples():
        # A request from before the stored level, one that came late, refills nothing.
        level = min(cap, level + max(0, row.first_ms - now) * rate)
        starts.append(level)
        k = int(np.searchsorted(np.asarray(row.lows), level, side="right")) - 1
        level = int(row.fixed[k]) if row.fixed[k] >= 0 else level + int(row.shifts[k])
        now = max(now, row.last_ms)
        ends.append(level)
    return pd.DataFrame(
        {
            "site": pdf["site"], "slice": pdf["slice"], "start_level": starts, "end_level": ends,
            "last_ms": pdf["last_ms"],
        }
    )


def _with_params(requests: DataFrame, params: DataFrame) -> DataFrame:
    """Requests with whole-number bucket size and refill per ms; defaults for unknown sites."""
    dim = bounded_broadcast(params.select("site", "max_tokens", "refill_rate", "min_interval"))
    joined = requests.join(dim, "site", "left")
    size = F.coalesce("max_tokens", F.lit(MAX_TOKENS))
    rate = F.coalesce("refill_rate", F.lit(REFILL_RATE))
    return joined.select(
        *requests.columns,
        F.round(size * UNITS).cast("bigint").alias("cap"),
        F.round(rate * (UNITS / 1000)).cast("bigint").alias("rate"),
        F.coalesce("min_interval", F.lit(MIN_INTERVAL_MS)).alias("min_interval"),
    )


def _counted(requests: DataFrame) -> DataFrame:
    """One row per site and time, with the number of its requests."""
    return requests.groupBy("site", "ms").agg(F.count(F.lit(1)).alias("n"))


def _cut_slices(timed: DataFrame, slice_ms: int, rows: int = SLICE_ROWS) -> DataFrame:
    """Times with their ``slice``, whose numbers rise with time.

    A slice is ``slice_ms`` long; where a site has more than ``rows`` times in one, it is cut into
    slices of ``rows`` milliseconds, which hold no more than that.
    """
    coarse = F.floor(F.col("ms") / slice_ms)
    crowded = (
        timed.groupBy("site", coarse.alias("coarse")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
        .select("site", "coarse", F.lit(rows).alias("length"))
    )
    fine = F.floor((F.col("ms") - F.col("coarse") * slice_ms) / F.coalesce("length", F.lit(slice_ms)))
    return (
        timed.withColumn("coarse", coarse)
        .join(bounded_broadcast(crowded), ["site", "coarse"], "left")
        .withColumn("slice", F.col("coarse") * (1 << 20) + fine)
        .drop("coarse", "length")
    )


def bucket_slices(
    requests: DataFrame, params: DataFrame, state: DataFrame | None = None, slice_ms: int = 600_000
) -> DataFrame:
    """Start and end level of each (site, slice); ``state`` (site, level, ms) continues a run."""
    timed = _cut_slices(_with_params(_counted(requests), params), slice_ms)
    effects = timed.groupBy("site", "slice").applyInPandas(_slice_effect, _EFFECT)
    if state is None:
        seeded = effects.withColumn("level0", F.col("cap")).withColumn("ms0", F.lit(-1).cast("bigint"))
    else:
        old = state.select(
            "site", F.col("level").alias("level0"), F.col("ms").alias("ms0")
        )
        seeded = (
            effects.join(old, "site", "left")
            .withColumn("level0", F.coalesce("level0", "cap"))
            .withColumn("ms0", F.coalesce("ms0", F.lit(-1).cast("bigint")))
        )
    schema = "site string, slice bigint, start_level bigint, end_level bigint, last_ms bigint"
    return seeded.groupBy("site").applyInPandas(_chain, schema)


def token_bucket_tag(
    requests: DataFrame,
    params: DataFrame,
    state: DataFrame | None = None,
    slice_ms: int = 600_000,
    order: str = "id",
    slices: DataFrame | None = None,
) -> DataFrame:
    """Tag each request of a site: tokens before it, admitted or not, and the wait it is told.

    A request takes one token if there is one. Otherwise it is refused and told to wait for the
    missing part of a token, but no less than the least interval. ``slices``, if given, is what
    ``bucket_slices`` made of the same requests.
    """
    starts = bucket_slices(requests, params, state, slice_ms) if slices is None else slices
    timed = _cut_slices(_with_params(_counted(requests), params), slice_ms)
    joined = timed.join(starts.select("site", "slice", "start_level"), ["site", "slice"])

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ms")
        ms, cap, rate = pdf["ms"].to_numpy(), int(pdf["cap"].iat[0]), int(pdf["rate"].iat[0])
        before = _run(ms, pdf["n"].to_numpy(), int(ms[0]), int(pdf["start_level"].iat[0]), cap, rate)
        return pd.DataFrame(
            {"site": pdf["site"], "ms": ms, "n": pdf["n"], "level": before, "rate": rate, "least": pdf["min_interval"]}
        )

    known = joined.groupBy("site", "slice").applyInPandas(
        levels, "site string, ms bigint, n bigint, level bigint, rate bigint, least double"
    )
    # The first requests of a time, as many as a full bucket can admit; of a crowded time a map task sends on no more.
    largest = params.agg(F.max("max_tokens")).first()[0]
    most = int(max(largest or 0.0, MAX_TOKENS)) + 1
    rank = F.row_number().over(Window.partitionBy("site", "ms").orderBy(order))
    firsts = (
        requests.select("site", "ms", order).withColumn("_rank", rank).filter(F.col("_rank") <= most)
        .groupBy("site", "ms").agg(F.array_sort(F.collect_list(order)).alias("_firsts"))
    )
    told = known.join(firsts, ["site", "ms"])
    tokens = F.floor(F.col("level") / UNITS)
    place = F.array_position("_firsts", F.col(order))
    taken = F.least(F.when(place > 0, place - 1).otherwise(F.col("n")), tokens)
    before = (F.col("level") - taken * UNITS).cast("bigint")
    missing = F.coalesce(F.try_divide((F.lit(UNITS) - F.col("_before")).cast("double"), F.col("rate")), F.lit(float("inf")))
    admitted = F.col("_before") >= UNITS
    return (
        requests.select("site", "ms", order).join(told, ["site", "ms"]).withColumn("_before", before)
        .select(
            "site", "ms", order, (F.col("_before") / F.lit(float(UNITS))).alias("tokens"), admitted.alias("admitted"),
            F.when(admitted, F.lit(0.0)).otherwise(F.greatest(missing, F.col("least"))).alias("wait_ms"),
        )
    )


def bucket_status(
    slices: DataFrame, params: DataFrame, as_of_ms: int | None = None
) -> DataFrame:
    """Tokens and wait per site after its last request, or at a later time."""
    last = slices.groupBy("site").agg(
        F.max_by("end_level", "slice").alias("level"), F.max("last_ms").alias("ms")
    )
    sized = _with_params(last, params)
    now = F.col("ms") if as_of_ms is None else F.greatest(F.col("ms"), F.lit(as_of_ms))
    level = F.least(F.col("cap"), F.col("level") + (now - F.col("ms")) * F.col("rate"))
    missing = F.try_divide((F.lit(UNITS) - level).cast("double"), F.col("rate"))
    wait = F.when(level >= UNITS, F.lit(0.0)).otherwise(F.greatest(missing, F.col("min_interval")))
    return sized.select(
        "site", (level / F.lit(float(UNITS))).alias("tokens"), wait.alias("wait_ms"),
        level.alias("level"), now.cast("bigint").alias("ms"),
    )
