"""Dispatch of tokens to experts whose queues are bounded, decided inside the token row.

The decision and the softmax are array expressions of a row, and per-expert figures are arrays summed by position,
so a token is read once and never becomes a row per expert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.columns import let, softmax
from runloom.operators.grouped import join_on, per_group
from runloom.operators.queues import BATCH, queue_cuts, queue_key, stays
from runloom.operators.routing import TOKEN, token_picks


def _kept_softmax(picks: Column) -> Column:
    """``picks`` with the softmax over the kept ones as weights; dropped ones get 0, never NaN."""
    kept = F.transform(F.filter(picks, lambda p: p["kept"]), lambda p: p["logit"])
    return let(
        F.array_max(kept),
        lambda top: let(
            F.aggregate(kept, F.lit(0.0), lambda total, x: total + F.exp(x - top)),
            lambda total: F.transform(
                picks, lambda p: p.withField("weight", F.when(p["kept"], F.exp(p["logit"] - top) / total).otherwise(F.lit(0.0)))
            ),
        ),
    )


def dispatch(tokens: DataFrame, top_k: int, capacity_factor: float) -> DataFrame:
    """Token rows with ``picks``: the chosen experts with ``choice``, ``logit``, whether ``kept``, and the weight over the kept ones.

    Capacity is ``ceil(capacity_factor * tokens / experts)`` per batch; a factor of 0 or less keeps everything. Ties
    go to the lower token id. Two narrow passes find the cuts; the third is the result.
    """
    picked = token_picks(tokens, top_k)
    if capacity_factor <= 0:
        return picked.withColumn("picks", F.transform("picks", lambda p: p.withField("kept", F.lit(True))))
    cuts = queue_cuts(assignments(picked), capacity_factor)
    joined = join_on(picked, per_group(cuts, cuts.count()), BATCH, "left")
    marked = F.transform(
        "picks", lambda p: p.withField("kept", stays(F.col("cuts"), p["expert_id"], queue_key(p["logit"], F.col("token_id"))))
    )
    return joined.withColumn("picks", marked).withColumn("picks", _kept_softmax(F.col("picks"))).drop("cuts")


def assignments(picked: DataFrame) -> DataFrame:
    """One row per token and chosen expert."""
    return picked.select(*TOKEN, "num_experts", F.inline("picks"))


def _by_position(rows: DataFrame, sums: dict[str, Column], num_experts: int) -> DataFrame:
    """Sums of arrays by position, one row per layer and position: one buffer per layer, no row per token and expert."""
    arrays = rows.select("layer", *[column.alias(name) for name, column in sums.items()])
    totals = [F.sum(F.get(name, F.lit(e))).alias(f"{name}_{e}") for name in sums for e in range(num_experts)]
    added = arrays.groupBy("layer").agg(F.count("*").alias("_tokens"), *totals)
    cells = [F.struct(F.lit(e).alias("expert_id"), *[F.col(f"{name}_{e}").alias(name) for name in sums]) for e in range(num_experts)]
    return added.select("layer", "_tokens", F.inline(F.array(*cells)))


def mean_weights(tokens: DataFrame, weights: Column, num_experts: int) -> DataFrame:
    """Mean of an array of weights per layer and expert, from one scan with one exchange of a row per layer and task."""
    sums = _by_position(tokens, {"_sum": weights}, num_experts)
    return sums.select("layer", "expert_id", (F.coalesce("_sum", F.lit(0.0)) / F.col("_tokens")).alias("mean_weight"))


def expert_sums(dispatched: DataFrame, num_experts: int) -> DataFrame:
    """All figures per layer and expert of dispatched tokens, idle experts included, from one scan.

    ``mean_weight`` of the kept, ``mean_probability`` of the full softmax, tokens before (``raw_tokens``) and after capacity
    (``tokens``), and the share of all tokens that is dispatched.
    """

    def at_expert(value) -> Column:
        places = F.sequence(F.lit(0), F.lit(num_experts - 1))
        return F.transform(
            places,
            lambda e: F.aggregate("picks", F.lit(0.0), lambda total, p: total + F.when(p["expert_id"] == e, value(p)).otherwise(F.lit(0.0))),
        )

    sums = {
        "_weight": at_expert(lambda p: p["weight"]),
        "_probability": softmax(F.col("logits")),
        "_raw": at_expert(lambda p: F.lit(1.0)),
        "_kept": at_expert(lambda p: p["kept"].cast("double")),
    }
    cells = _by_position(dispatched, sums, num_experts)
    share = {name: F.coalesce(f"_{name}", F.lit(0.0)) / F.col("_tokens") for name in ("weight", "probability", "kept")}
    return cells.select(
        "layer",
        "expert_id",
        "_tokens",
        share["weight"].alias("mean_weight"),
        share["probability"].alias("mean_probability"),
        F.col("_raw").cast("long").alias("raw_tokens"),
        F.col("_kept").cast("long").alias("tokens"),
        share["kept"].alias("dispatch_share"),
    )


def balance_loss(experts: DataFrame) -> DataFrame:
    """Experts times the sum of dispatch share times mean full softmax, per layer, from ``expert_sums``.

    The rows of a layer come from one row, so nothing is shuffled again.
    """
    product = F.col("dispatch_share") * F.col("mean_probability")
    return experts.groupBy("layer").agg((F.count("*") * F.sum(product)).alias("balance_loss"))
