"""Scalar series of training runs: windows, tails, medians and skew."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.columns import micros
from runloom.functions.rolling import sliding_percentiles
from runloom.operators.grouped import (
    GROUP_ROWS,
    PERCENTILE_ROWS,
    chunked,
    exact_percentiles,
    group_sizes,
    join_on,
    per_group,
)
from runloom.session import written

#: Lengths of the rolling window and of the averaged tail.
ROLLING_ROWS = 100
TAIL_POINTS = 50
#: Rolling percentiles.
ROLLING = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Series of step times, the first that a run has; marks of a step.
STEP_TIME_TAGS = ("train/step_time_ms/p50", "step_time_ms/p50")
BEGIN, END = "begin", "end"
EPSILON = 1e-8

SERIES = ("run", "tag")


def step_durations(
    marks: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    group_rows: int = GROUP_ROWS,
    kind: str | None = None,
) -> DataFrame:
    """Milliseconds since the previous mark of the key; null for the first mark.

    With a ``kind`` column only the time from a begin mark to the end mark right after it
    counts, one row per end; an end that follows no begin is left out, and so is idle time.
    """
    rows = chunked(marks, keys, [ts, tie], before=1, group_rows=group_rows)
    window = Window.partitionBy(*keys, "_chunk").orderBy(ts, tie)
    timed = rows.withColumn("_micros", micros(rows, ts))
    elapsed = (F.col("_micros") - F.lag("_micros").over(window)) / 1000
    timed = timed.withColumn("elapsed_ms", elapsed)
    if kind is not None:
        timed = timed.withColumn("_pair", (F.col(kind) == END) & (F.lag(kind).over(window) == BEGIN)).filter("_pair").drop("_pair")
    return timed.filter("_own").drop("_chunk", "_own", "_micros")


def rolling_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    rows: int = ROLLING_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """p50, p95 and p99 of the last ``rows`` values of each key, the current one included.

    Spark's windowed ``percentile`` builds every frame anew, row by row. Sorting
    whole blocks of frames in numpy is many times faster, so each bounded chunk is
    handed over as an Arrow table.
    """
    parts = chunked(df, keys, order, before=rows - 1, group_rows=group_rows)
    names, shares = list(ROLLING), list(ROLLING.values())
    columns = [*df.columns, *names]

    def roll(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in order])
        values = table[value].cast(pa.float64()).to_numpy()
        for name, result in zip(names, sliding_percentiles(values, rows, shares)):
            table = table.append_column(name, pa.array(result, from_pandas=True))
        return table.filter(table["_own"]).select(columns)

    doubles = [T.StructField(name, T.DoubleType()) for name in names]
    schema = T.StructType([*df.schema.fields, *doubles])
    return parts.groupBy(*keys, "_chunk").applyInArrow(roll, schema)


def timing_log(
    steps: DataFrame,
    run: str = "run",
    rank: str = "rank",
    step: str = "step",
    value: str = "elapsed_ms",
    prefix: str = "train/",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rolling step times as scalar points ``run, tag, step, value``.

    Tags look like ``train/step_time_ms/rank3/p50``; a run of one process has a null rank
    and no rank in its tags.
    """
    rows = steps.select(F.col(run).alias("run"), F.col(rank).alias("rank"), F.col(step).alias("step"), F.col(value).alias("ms"))
    rolled = rolling_percentiles(rows, ["run", "rank"], ["step"], "ms", group_rows=group_rows)
    of_rank = F.coalesce(F.concat(F.lit("/rank"), F.col("rank").cast("string")), F.lit(""))
    points = [
        F.struct(F.concat(F.lit(f"{prefix}step_time_ms"), of_rank, F.lit(f"/{name}")).alias("tag"), "step", F.col(name).alias("value"))
        for name in ROLLING
    ]
    return rolled.select("run", F.inline(F.array(*points)))


def smooth_centered(
    log: DataFrame,
    width: int,
    keys: Sequence[str] = SERIES,
    order: str = "step",
    value: str = "value",
    true_average: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Centred moving average. Sums at the ends are divided by ``width`` too, so they dip;
    ``true_average`` divides by the points present. A series shorter than ``width`` is unchanged.
    """
    # Looking back over a whole width shows in every chunk whether the series is that long.
    parts = chunked(log, keys, [order], before=width - 1, after=width, group_rows=group_rows)
    chunk = Window.partitionBy(*keys, "_chunk")
    before = width // 2
    frame = chunk.orderBy(order).rowsBetween(-before, width - 1 - before)
    points = F.count(value).over(frame) if true_average else F.lit(width)
    smoothed = F.sum(value).over(frame) / points
    long_enough = F.count("*").over(chunk) >= width
    return (
        parts.withColumn("smoothed", F.when(long_enough, smoothed).otherwise(F.col(value)))
        .filter("_own")
        .drop("_chunk", "_own")
    )


def final_value(log: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Last value of each series, rounded to 4 places."""
    return log.groupBy(*keys).agg(F.round(F.max_by("value", F.struct("step", "value")), 4).alias("final_value"))


def tail_mean(
    log: DataFrame, keys: Sequence[str] = SERIES, points: int = TAIL_POINTS
) -> DataFrame:
    """Mean of the last points of each series, rounded to 4 places.

    Spark limits every series to ``points`` rows before the shuffle.
    """
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("step"), F.desc("value")))
    return (
        log.withColumn("_newest", newest)
        .filter(F.col("_newest") <= points)
        .groupBy(*keys)
        .agg(F.round(F.avg("value"), 4).alias("tail_mean"))
    )


def series_fallback(log: DataFrame, tags: Sequence[str], keys: Sequence[str] = ("run",)) -> DataFrame:
    """Per run, the points of the first tag in ``tags`` that has any."""
    ranks = F.create_map(*[F.lit(x) for pair in zip(tags, range(len(tags))) for x in pair])
    known = log.filter(F.col("tag").isin(*tags)).withColumn("_choice", ranks[F.col("tag")])
    best = written(known.groupBy(*keys).agg(F.min("_choice").alias("_choice")), "best")
    return join_on(known, per_group(best, best.count()), [*keys, "_choice"], "left_semi").drop("_choice")


def step_time_distribution(
    log: DataFrame,
    keys: Sequence[str] = ("run",),
    bins: int = 20,
    group_rows: int = PERCENTILE_ROWS,
    tags: Sequence[str] = STEP_TIME_TAGS,
) -> DataFrame:
    """Minimum, median and maximum per run, and the counts of ``bins`` equal bins between.

    A run is judged by the first of the ``tags`` that it has; runs with none are left out.
    """
    chosen = series_fallback(log, tags, keys).select(*keys, "value")
    groups, largest = group_sizes(chosen, keys)
    edges = chosen.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    medians = exact_percentiles(chosen, keys, "value", {"median": 0.5}, group_rows, largest)
    span = F.col("high") - F.col("low")
    place = F.floor((F.col("value") - F.col("low")) / span * bins)
    inside = F.when(span > 0, F.least(place, F.lit(bins - 1))).otherwise(0)
    counts = (
        join_on(chosen, per_group(edges, groups), keys)
        .withColumn("bin", inside.cast("int"))
        .groupBy(*keys, "low", "high", "bin")
        .agg(F.count("value").alias("points"))
    )
    return join_on(counts, medians, keys).select(*keys, "low", "median", "high", "bin", "points")


def rank_step_skew(log: DataFrame, group_rows: int = PERCENTILE_ROWS) -> DataFrame:
    """Median step time per run and rank; skew is max over min if a run has several ranks.

    Tags look like ``train/step_time_ms/rank3/p50``; without any such tag the form
    without ``train/`` is used.
    """
    pattern = r"^(train/)?step_time_ms/rank([0-9]+)/p50$"
    # The starts reach the scan; the pattern does not.
    begins = F.col("tag").startswith("train/step_time_ms/rank") | F.col("tag").startswith("step_time_ms/rank")
    ranked = log.filter(begins & F.col("tag").rlike(pattern)).select(
        "run",
        F.when(F.col("tag").startswith("train/"), 0).otherwise(1).alias("_form"),
        F.regexp_extract("tag", pattern, 2).cast("int").alias("rank"),
        "value",
    )
    medians = exact_percentiles(ranked, ["run", "_form", "rank"], "value", {"median": 0.5}, group_rows)
    run = Window.partitionBy("run")
    chosen = medians.withColumn("_best", F.min("_form").over(run)).filter("_form = _best").drop("_form", "_best")
    skew = F.max("median").over(run) / (F.min("median").over(run) + EPSILON)
    return chosen.withColumn("skew", F.when(F.count("*").over(run) > 1, skew))
