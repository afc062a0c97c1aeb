"""Logs and result files of training runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from runloom.operators.summary import TAGS

#: Columns of the result files.
EVAL_SCHEMA = "eval_loss DOUBLE, epoch DOUBLE"
BENCHMARK_SCHEMA = (
    "method STRING, workload STRING, num_requests BIGINT, latency_p50_ms DOUBLE, "
    "latency_p95_ms DOUBLE, latency_p99_ms DOUBLE, latency_p999_ms DOUBLE, "
    "tail_amplification DOUBLE, stall_ratio DOUBLE, throughput_tokens_per_sec DOUBLE, "
    "total_output_tokens BIGINT, peak_gpu_memory_mb DOUBLE, max_mean_expert_weight DOUBLE, "
    "mean_expert_weight DOUBLE, max_mean_ratio DOUBLE, expert_weight_entropy DOUBLE, "
    "per_expert_token_counts ARRAY<DOUBLE>"
)
#: File name patterns below a run folder.
ARTIFACTS = {
    "eval": ("eval_results.json", EVAL_SCHEMA),
    "benchmark": ("benchmark_*.json", BENCHMARK_SCHEMA),
    "snapshot": ("routing_snapshot.json", None),
}


def read_scalar_log(log: DataFrame, tags: Mapping[str, str] = TAGS) -> DataFrame:
    """Points of the wanted tags under their short names; a tag without points is absent.

    The tag filter reaches the Parquet scan.
    """
    names = F.create_map(*[F.lit(x) for key, tag in tags.items() for x in (tag, key)])
    wanted = log.filter(F.col("tag").isin(*tags.values()))
    return wanted.select("run", names[F.col("tag")].alias("key"), "step", "value")


def scalar_tags_by_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """All series whose tag starts with ``prefix``."""
    return log.filter(F.col("tag").startswith(prefix))


def read_run_artifacts(
    spark: SparkSession,
    root: str,
    kind: str,
    files: str | None = None,
    run_pattern: str = r"([^/]+)/[^/]+$",
) -> DataFrame:
    """Result files ``root/<run>/<file>`` with their run; no file gives no row.

    A snapshot has one column ``snapshot`` with the JSON text. Other file names
    and layouts are given by ``files`` (a glob) and ``run_pattern``.
    """
    name, schema = ARTIFACTS[kind]
    path = f"{root.rstrip('/')}/*/{files or name}"
    run = F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).alias("run")
    columns = T.StructType.fromDDL(schema or "value STRING")
    try:
        if schema is None:
            return spark.read.text(path, wholetext=True).select(run, F.col("value").alias("snapshot"))
        return spark.read.schema(schema).option("multiLine", True).json(path).select(run, "*")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        named = columns if schema else T.StructType.fromDDL("snapshot STRING")
        return spark.createDataFrame([], T.StructType([T.StructField("run", T.StringType()), *named.fields]))


def explode_snapshot(snapshots: DataFrame, text: str = "snapshot", keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """JSON ``{layer: [weight, ...]}`` to one row per layer and expert."""
    layers: Column = F.from_json(text, "MAP<STRING, ARRAY<DOUBLE>>")
    return snapshots.select(*keys, F.explode(layers).alias("layer", "weights")).select(
        *keys, "layer", F.posexplode("weights").alias("expert_id", "mean_weight")
    )


def write_summary(summary: DataFrame, path: str, headers: Mapping[str, str] | None = None) -> None:
    """Write a summary table as one CSV part with a header; it has one row per run."""
    named = summary.withColumnsRenamed(dict(headers)) if headers else summary
    named.repartition(1).write.mode("overwrite").option("header", True).csv(path)
