"""Inputs of the operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.operators.grouped import row_positions
from runloom.operators.series import step_durations

#: Experts of a layer; a vector holds as many layers as it has room for.
EXPERTS = 8


#: Columns of the given tables; a stated schema saves a job per read.
SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction record per user turn: its text, the setting so far and the answer that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    setting = F.last(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True)
    answered = F.lead("role").over(w) == "assistant"
    turns = table(spark, sf_dir, "conversations").select(
        "role",
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"),
        F.col("text").alias("instruction"),
        F.coalesce(setting.over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")).alias("input"),
        F.when(answered, F.lead("text").over(w)).otherwise("").alias("output"),
    )
    return turns.where("role = 'user'").drop("role")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One served request per event."""
    workloads = F.array(*[F.lit(w) for w in ("homogeneous", "heterogeneous", "bursty", "mixed_semantic")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("method"),
        workloads[F.pmod("user_id", F.lit(4)).cast("int")].alias("workload"),
        (F.col("value") / 1000).alias("latency_s"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("output_tokens"),
        F.floor("value").cast("int").alias("prompt_len_raw"),
        "ts",
    )


def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar series ``run, tag, step, value``."""
    kind = F.pmod("user_id", F.lit(5))
    rank = F.pmod("user_id", F.lit(4)).cast("string")
    tag = (
        F.when(kind == 0, "eval/loss")
        .when(kind == 1, "train/loss")
        .when(kind == 2, "train/routing/global_entropy")
        .when(kind == 3, "train/routing/global_cv")
        .otherwise(F.concat(F.lit("train/step_time_ms/rank"), rank, F.lit("/p50")))
    )
    points = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), tag.alias("tag"), "ts", "event_id", "value"
    )
    steps = row_positions(points, ["run", "tag"], ["ts", "event_id"], "step")
    return steps.select("run", "tag", "step", "value")


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "run")
    return events.groupBy("run").agg((F.avg("value") / 100).alias("eval_loss"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run")).distinct()


def router_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router logits, one row per layer and token: a vector holds all layers of 8 experts each."""
    layer = F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / EXPERTS).cast("int") - 1)).alias("layer")
    return (
        table(spark, sf_dir, "embeddings")
        .select(layer, F.col("label").alias("batch_id"), F.col("vec_id").alias("token_id"), "embedding")
        .select(
            "layer",
            "batch_id",
            "token_id",
            F.slice("embedding", F.col("layer") * EXPERTS + 1, EXPERTS)
            .cast("array<double>")
            .alias("logits"),
        )
    )


def router_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form, one row per expert."""
    return router_tokens(spark, sf_dir).select(
        "layer", "batch_id", "token_id", F.posexplode("logits").alias("expert_id", "logit")
    )


def served(tokens: DataFrame) -> DataFrame:
    """The method and workload that a token of the router was served for."""
    workloads = F.array(*[F.lit(w) for w in ("homogeneous", "heterogeneous", "bursty", "mixed_semantic")])
    half = F.floor(F.col("token_id") / 2)
    return tokens.select(
        "*",
        F.when(F.col("token_id") % 2 == 0, "click").otherwise("view").alias("method"),
        workloads[F.pmod(half, F.lit(4)).cast("int")].alias("workload"),
    )


def pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two published parts of the chats."""
    turns = table(spark, sf_dir, "conversations")
    return turns.filter("conv_id % 10 <> 0"), turns.filter("conv_id % 10 = 0")


def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed time between the events of a type."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return step_durations(events, ["event_type"], "ts", "event_id")


def step_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks where a step begins or ends."""
    kind = F.when(F.col("user_id") % 2 == 0, "begin").otherwise("end").alias("kind")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", kind)


def timed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step times; a run with a name of even length has one process, so its rank is null."""
    rank = F.when(F.length("event_type") % 2 == 1, F.pmod("user_id", F.lit(4)).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), rank.alias("rank"), F.col("event_id").alias("step"), F.col("value").alias("elapsed_ms")
    )
