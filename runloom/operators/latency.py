"""Request latency: percentiles, tail, stalls, throughput and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.columns import micros
from runloom.operators.grouped import PERCENTILE_ROWS, exact_percentiles, group_sizes, join_on, per_group
from runloom.session import written

#: Reported percentiles.
PERCENTILES = {
    "latency_p50_ms": 0.5,
    "latency_p95_ms": 0.95,
    "latency_p99_ms": 0.99,
    "latency_p999_ms": 0.999,
}
#: Fixed value: added to denominators.
EPSILON = 1e-8
#: Fixed value: a longest latency that is not known is this much above p99.
P999_OVER_P99 = 1.1
#: Fixed value: a request stalls above this multiple of the median.
STALL_FACTOR = 2.0

GROUP = ("method", "workload")
#: Size of the approximate sketches: ranks within 0.1 %.
SKETCH_SIZE = 4096


def _with_ms(requests: DataFrame) -> DataFrame:
    return requests.withColumn("_ms", F.col("latency_s") * 1000)


def latency_percentiles(
    requests: DataFrame,
    keys: Sequence[str] = GROUP,
    group_rows: int = PERCENTILE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """p50, p95, p99 and p99.9 in milliseconds per group, exact and interpolated."""
    return exact_percentiles(_with_ms(requests), keys, "_ms", PERCENTILES, group_rows, largest)


def latency_sketches(requests: DataFrame, keys: Sequence[str] = GROUP, k: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable quantile sketch of the latencies in milliseconds per group: ``sketch`` and ``num_requests``.

    For groups too large, or asked for too often, to be counted exactly: keep sketches per hour, say, and merge them for a
    report. A sketch has a bounded size, whatever the size of its group.
    """
    return _with_ms(requests).groupBy(*keys).agg(
        F.kll_sketch_agg_double("_ms", F.lit(k)).alias("sketch"), F.count("_ms").alias("num_requests")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = GROUP, k: int = SKETCH_SIZE) -> DataFrame:
    """The sketches of parts as those of the wholes that ``keys`` name."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("num_requests").alias("num_requests")
    )


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Approximate p50, p95, p99 and p99.9 of each sketch, of the values that occurred.

    The rank of a value is off by no more than ``rank_error`` of the group, with 99 % confidence. Sketches of fewer values than
    ``SKETCH_SIZE`` are exact. A group without values has nulls.
    """
    known = F.when(F.col("num_requests") > 0, F.col("sketch"))
    figures = [F.kll_sketch_get_quantile_double(known, F.lit(share)).alias(name) for name, share in PERCENTILES.items()]
    return sketches.select(*keys, "num_requests", *figures)


def rank_error(k: int = SKETCH_SIZE) -> float:
    """The published error of the sketch's ranks by its size."""
    return 2.446 / k**0.9433


def _rate() -> Column:
    time = F.sum("latency_s")
    return F.when(time > 0, F.sum("output_tokens") / time).otherwise(0.0)


def throughput(requests: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Tokens per second of serving time, 0 if no time passed."""
    return requests.groupBy(*keys).agg(_rate().alias("throughput_tokens_per_sec"))


def tail_amplification(report: DataFrame, given: str | None = None) -> DataFrame:
    """p99 over p50; a value that the report already has wins."""
    derived = F.col("latency_p99_ms") / (F.col("latency_p50_ms") + EPSILON)
    known = [F.col(given)] if given else []
    return report.withColumn("tail_amplification", F.coalesce(*known, derived))


def stall_ratio(
    requests: DataFrame, keys: Sequence[str] = GROUP, group_rows: int = PERCENTILE_ROWS
) -> DataFrame:
    """Share of requests slower than twice the median of their group."""
    groups, largest = group_sizes(requests, keys)
    median = exact_percentiles(_with_ms(requests), keys, "_ms", {"_p50": 0.5}, group_rows, largest)
    return _stalls(requests, per_group(median, groups), keys).select(*keys, "stall_ratio")


def _stalls(requests: DataFrame, medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and sums per group, against a median that is one row per group."""
    needed = requests.select(*keys, "latency_s", "output_tokens")
    stalled = F.col("_ms") > STALL_FACTOR * F.col("_p50")
    return (
        join_on(_with_ms(needed), medians, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("num_requests"),
            F.avg(stalled.cast("int")).alias("stall_ratio"),
            _rate().alias("throughput_tokens_per_sec"),
            F.sum("output_tokens").alias("total_output_tokens"),
        )
    )


def benchmark_report(
    requests: DataFrame, keys: Sequence[str] = GROUP, group_rows: int = PERCENTILE_ROWS
) -> DataFrame:
    """One row per group with counts, percentiles, tail, stalls and throughput."""
    groups, largest = group_sizes(requests, keys)
    percentiles = latency_percentiles(requests, keys, group_rows, largest)
    medians = percentiles.select(*keys, F.col("latency_p50_ms").alias("_p50"))
    totals = _stalls(requests, per_group(medians, groups), keys)
    return tail_amplification(join_on(totals, percentiles, keys)).select(
        *keys,
        "num_requests",
        *PERCENTILES,
        "tail_amplification",
        "stall_ratio",
        "throughput_tokens_per_sec",
        "total_output_tokens",
    )


def compare_runs(report: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """Two methods side by side per workload, columns prefixed ``a_`` and ``b_``."""

    def side(method: str, prefix: str) -> DataFrame:
        rows = report.filter(F.col("method") == method)
        return rows.select(
            "workload", *[F.col(c).alias(prefix + c) for c in report.columns if c != "workload"]
        )

    return side(method_a, "a_").join(side(method_b, "b_"), "workload")


def latency_cdf_points(report: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Five points of the latency distribution per group."""
    p999 = F.lit(None).cast("double")
    if "latency_p999_ms" in report.columns:
        p999 = F.col("latency_p999_ms")
    top = F.coalesce(p999, F.col("latency_p99_ms") * P999_OVER_P99)
    points = [
        (F.lit(0.0), 0.0),
        (F.col("latency_p50_ms"), 0.5),
        (F.col("latency_p95_ms"), 0.95),
        (F.col("latency_p99_ms"), 0.99),
        (top, 0.999),
    ]
    pairs = [F.struct(x.alias("latency_ms"), F.lit(y).alias("cdf")) for x, y in points]
    return report.select(*keys, F.inline(F.array(*pairs)))


def arrival_offsets(events: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Seconds since the first arrival of the group.

    The running sum of gaps equals the distance from the first row, so a minimum
    per group replaces an ordered window over the whole group.
    """
    first = written(events.groupBy(*keys).agg(F.min(ts).alias("_first")), "first")
    timed = join_on(events, per_group(first, first.count()), keys)
    elapsed = micros(timed, ts) - micros(timed, "_first")
    return timed.withColumn("arrival_s", elapsed / 1_000_000).drop("_first")
