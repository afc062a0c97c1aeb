"""Summary tables: one row per run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.latency import EPSILON
from runloom.operators.series import TAIL_POINTS

#: Scalar tags and the names used for them.
TAGS = {
    "train_loss": "train/loss",
    "eval_loss": "eval/loss",
    "routing_entropy": "train/routing/global_entropy",
    "routing_cv": "train/routing/global_cv",
    "routing_active": "train/routing/global_active_experts",
    "balance_loss": "train/routing/balance_loss",
    "global_max_over_mean": "train/routing/global_max_over_mean_load",
    "global_overflow": "train/routing/global_overflow_fraction",
}
#: Workloads of the wide summary.
WORKLOADS = ("homogeneous", "heterogeneous", "bursty", "mixed_semantic")
#: Headers of the written tables.
HEADERS = {
    "run": "Method",
    "final_train_loss": "Final Train Loss",
    "final_eval_loss": "Final Eval Loss",
    "final_eval_perplexity": "Final Eval Perplexity",
    "mean_routing_entropy": "Mean Routing Entropy",
    "mean_load_cv": "Mean Load CV",
}
WIDE_HEADERS = {
    "run": "Method",
    "final_train_loss": "Final Train Loss",
    "final_eval_loss": "Final Eval Loss",
    "eval_perplexity": "Eval Perplexity",
    "mean_load_cv": "Mean Load CV",
    "max_mean_load": "Max/Mean Load",
    "overflow_fraction": "Overflow Fraction",
    **{f"p99_latency_{w}": f"P99 latency ({w})" for w in WORKLOADS},
    **{f"tail_amp_{w}": f"Tail amp ({w})" for w in WORKLOADS},
}


def perplexity(loss: Column) -> Column:
    """``exp(loss)`` rounded to 2 places."""
    return F.round(F.exp(loss), 2)


def newest_points(log: DataFrame, points: int = TAIL_POINTS, name: str = "_newest") -> DataFrame:
    """The last points of each series, numbered from the newest; Spark limits every series before the shuffle."""
    newest = F.row_number().over(Window.partitionBy("run", "tag").orderBy(F.desc("step"), F.desc("value")))
    return log.withColumn(name, newest).where(F.col(name) <= points)


def _series_figures(log: DataFrame, finals: dict[str, str], tails: dict[str, str], points: int) -> DataFrame:
    """Last values and tail means of several series, one column each, from one pass over their last points."""
    wanted = [TAGS[key] for key in (*finals, *tails)]
    last = newest_points(log.filter(F.col("tag").isin(*wanted)), points)
    of = lambda key: F.col("tag") == TAGS[key]
    figures = [F.round(F.max(F.when(of(key) & (F.col("_newest") == 1), F.col("value"))), 4).alias(name) for key, name in finals.items()]
    figures += [F.round(F.avg(F.when(of(key), F.col("value"))), 4).alias(name) for key, name in tails.items()]
    return last.groupBy("run").agg(*figures)


def _left_join(runs: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.join(right, "run", "left"), tables, runs)


def run_summary(
    runs: DataFrame, log: DataFrame, eval_metrics: DataFrame, points: int = TAIL_POINTS
) -> DataFrame:
    """Final losses, perplexity and tail means of the routing series; null where missing."""
    evals = eval_metrics.select(
        "run",
        F.col("eval_loss").alias("final_eval_loss"),
        perplexity(F.col("eval_loss")).alias("final_eval_perplexity"),
    )
    tails = {"routing_entropy": "mean_routing_entropy", "routing_cv": "mean_load_cv"}
    tables = [_series_figures(log, {"train_loss": "final_train_loss"}, tails, points), evals]
    return _left_join(runs, tables).select(*HEADERS)


def run_summary_wide(
    runs: DataFrame,
    log: DataFrame,
    eval_metrics: DataFrame,
    report: DataFrame,
    points: int = TAIL_POINTS,
) -> DataFrame:
    """The summary with load and overflow, and p99 and tail of each workload as columns.

    ``report`` has one row per ``method`` (the run) and ``workload``.
    """
    evals = eval_metrics.select(
        "run",
        F.col("eval_loss").alias("final_eval_loss"),
        perplexity(F.col("eval_loss")).alias("eval_perplexity"),
    )
    tails = {
        "routing_cv": "mean_load_cv",
        "global_max_over_mean": "max_mean_load",
        "global_overflow": "overflow_fraction",
    }
    derived = F.col("latency_p99_ms") / (F.col("latency_p50_ms") + EPSILON)
    given = [F.col("tail_amplification")] if "tail_amplification" in report.columns else []
    figures = report.select(
        F.col("method").alias("run"),
        "workload",
        F.round("latency_p99_ms", 1).alias("p99_latency"),
        F.round(F.coalesce(*given, derived), 3).alias("tail_amp"),
    )
    wide = figures.groupBy("run").pivot("workload", list(WORKLOADS)).agg(
        F.first("p99_latency").alias("p99_latency"), F.first("tail_amp").alias("tail_amp")
    )
    wide = wide.select(
        "run",
        *[F.col(f"{w}_{f}").alias(f"{f}_{w}") for f in ("p99_latency", "tail_amp") for w in WORKLOADS],
    )
    tables = [_series_figures(log, {"train_loss": "final_train_loss"}, tails, points), evals, wide]
    return _left_join(runs, tables).select(*WIDE_HEADERS)
