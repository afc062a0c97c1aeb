"""Routing of tokens to experts: weights, top-k, capacity, load and balance.

The input has one row per token and layer: ``layer, batch_id, token_id`` and
``logits``, an array with one value per expert. What concerns one token is
computed inside its row, without a shuffle; only per-expert sums are shuffled,
after Spark has combined them on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.columns import sigmoid, softmax
from runloom.operators.grouped import GROUP_ROWS, join_on
from runloom.operators.queues import capacity_marks

TOKEN = ("layer", "batch_id", "token_id")
#: Fixed values of the statistics.
DEFAULT_TOP_K = 2
EPSILON = 1e-8
LOG_EPSILON = 1e-9
ACTIVE_SOFTMAX = 0.01
ACTIVE_SIGMOID = 0.1
HOT_FACTOR = 2
BALANCE_COEFFICIENT = 0.01


def to_token_rows(long: DataFrame) -> DataFrame:
    """Long logits (a row per expert) to one row per token; experts are numbered from 0."""
    pairs = F.array_sort(F.collect_list(F.struct("expert_id", "logit")))
    return long.groupBy(*TOKEN).agg(F.transform(pairs, lambda p: p["logit"]).alias("logits"))


def _spread(tokens: DataFrame, weights: Column) -> DataFrame:
    """One row per token and expert with its weight."""
    return tokens.select(*TOKEN, F.posexplode(weights).alias("expert_id", "weight"))


def router_softmax(tokens: DataFrame) -> DataFrame:
    """Weights that sum to 1 over the experts of a token."""
    return _spread(tokens, softmax(F.col("logits")))


def router_sigmoid(tokens: DataFrame) -> DataFrame:
    """An independent weight per expert."""
    return _spread(tokens, F.transform("logits", sigmoid))


def token_picks(tokens: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """Token rows with ``picks``, their ``top_k`` best experts in order; 2 if ``top_k`` is not positive.

    ``weight`` is the softmax over the chosen experts, ``choice`` counts from 0 for
    the best. Equal logits go to the lower expert. Experts not listed have weight 0.
    """
    k = top_k if top_k > 0 else DEFAULT_TOP_K
    # Without a comparison of its own this sort is many times faster than ``array_sort``.
    ranked = F.sort_array(
        F.transform("logits", lambda x, i: F.struct((-x).alias("minus"), i.alias("expert_id")))
    )
    chosen = tokens.withColumn("_best", F.slice(ranked, 1, k)).withColumn(
        "_weights", softmax(F.transform("_best", lambda b: -b["minus"]))
    )
    picks = F.transform(
        "_best",
        lambda b, i: F.struct(
            i.alias("choice"),
            b["expert_id"].alias("expert_id"),
            (-b["minus"]).alias("logit"),
            F.get("_weights", i).alias("weight"),
        ),
    )
    return chosen.select(*tokens.columns, F.size("logits").alias("num_experts"), picks.alias("picks"))


def topk_route(tokens: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """The picks of ``token_picks``, one row each."""
    return token_picks(tokens, top_k).select(*TOKEN, "num_experts", F.inline("picks"))


def topk_or_dense(tokens: DataFrame, num_experts: int, top_k: int = 0) -> DataFrame:
    """The softmax form: top-k only for ``0 < top_k < num_experts``, otherwise all experts."""
    k = top_k if 0 < top_k < num_experts else num_experts
    return topk_route(tokens, k)


def capacity_enforce(
    assigned: DataFrame, tokens: DataFrame, capacity_factor: float, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Mark as ``kept`` the best assignments of each expert and batch, up to its capacity.

    Capacity is ``ceil(capacity_factor * tokens / experts)`` and does not grow with
    top-k; a factor of 0 or less keeps everything. Ties go to the lower token id. The assignments
    are not shuffled, see ``dispatch``, which also has the form that stays in token rows. ``group_rows`` bounds what one task
    ranks of the level that holds a cut.
    """
    if capacity_factor <= 0:
        return assigned.withColumn("kept", F.lit(True))
    sizes = tokens.groupBy("layer", "batch_id").agg(F.count("*").alias("_tokens"))
    return capacity_marks(assigned, capacity_factor, sizes, group_rows)


def renormalize_kept(assigned: DataFrame) -> DataFrame:
    """Softmax again over the kept experts of each token; dropped ones get 0, never NaN.

    For assignments that come as rows; ``dispatch`` has it inside token rows, without a shuffle.
    """
    token = Window.partitionBy(*TOKEN)
    shifted = F.exp(F.col("logit") - F.max(F.when(F.col("kept"), F.col("logit"))).over(token))
    power = F.when(F.col("kept"), shifted).otherwise(0.0)
    weight = F.when(F.col("kept"), F.col("_power") / F.sum("_power").over(token)).otherwise(0.0)
    return assigned.withColumn("_power", power).withColumn("weight", weight).drop("_power")


def overflow_fraction(assigned: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Dropped assignments over all token x expert cells, and over assignments."""
    dropped = F.count_if(~F.col("kept"))
    cells = F.count_if(F.col("choice") == 0) * F.max("num_experts")
    return assigned.groupBy(*keys).agg(
        (dropped / cells).alias("overflow_fraction"),
        (dropped / F.count("*")).alias("dropped_share"),
    )


def _grid(tokens: DataFrame, num_experts: int | None) -> DataFrame:
    """One row per layer and expert, idle experts included, with the layer's token count."""
    # A known number of experts saves reading the logits.
    number = F.lit(num_experts) if num_experts else F.max(F.size("logits"))
    layers = tokens.groupBy("layer").agg(F.count("*").alias("_tokens"), number.alias("_experts"))
    experts = F.explode(F.sequence(F.lit(0), F.col("_experts") - 1)).alias("expert_id")
    return layers.select("layer", "_tokens", experts)


def mean_expert_weights(
    tokens: DataFrame, weights: DataFrame, num_experts: int | None = None
) -> DataFrame:
    """Mean weight per layer and expert over all tokens, absent weights counting as 0."""
    sums = weights.groupBy("layer", "expert_id").agg(F.sum("weight").alias("_sum"))
    mean = F.coalesce("_sum", F.lit(0.0)) / F.col("_tokens")
    return (
        _grid(tokens, num_experts)
        .join(sums, ["layer", "expert_id"], "left")
        .select("layer", "expert_id", mean.alias("mean_weight"))
    )


def expert_table(
    tokens: DataFrame, assigned: DataFrame, num_experts: int | None = None
) -> DataFrame:
    """Per layer and expert: mean weight, tokens before (``raw_tokens``) and after capacity
    (``tokens``), and the share of all tokens that is dispatched.

    One pass over the assignments; what follows works on this small table.
    """
    sums = assigned.groupBy("layer", "expert_id").agg(
        F.sum("weight").alias("_sum"),
        F.count("*").alias("_raw"),
        F.count_if("kept").alias("_kept"),
    )
    cells = _grid(tokens, num_experts).join(sums, ["layer", "expert_id"], "left")
    kept = F.coalesce("_kept", F.lit(0))
    return cells.select(
        "layer",
        "expert_id",
        "_tokens",
        (F.coalesce("_sum", F.lit(0.0)) / F.col("_tokens")).alias("mean_weight"),
        F.coalesce("_raw", F.lit(0)).alias("raw_tokens"),
        kept.alias("tokens"),
        (kept / F.col("_tokens")).alias("dispatch_share"),
    )


def expert_load_stats(counts: DataFrame) -> DataFrame:
    """Per layer: max over mean load, hot experts and sample variance of the counts."""
    average = F.avg("tokens").over(Window.partitionBy("layer"))
    return (
        counts.withColumn("_mean", average)
        .groupBy("layer")
        .agg(
            (F.max("tokens") / (F.max("_mean") + EPSILON)).alias("max_over_mean_load"),
            F.count_if(F.col("tokens") > HOT_FACTOR * F.col("_mean")).alias("hot_expert_count"),
            F.var_samp("tokens").alias("load_variance"),
            F.sum("raw_tokens").alias("raw_tokens"),
            F.sum("tokens").alias("kept_tokens"),
        )
    )


def _entropy(share: Column) -> Column:
    return -F.sum(share * F.ln(share + LOG_EPSILON))


def _variation() -> Column:
    return F.stddev_samp("mean_weight") / (F.avg("mean_weight") + EPSILON)


def routing_stats(means: DataFrame, active_above: float = ACTIVE_SOFTMAX) -> DataFrame:
    """Per layer: entropy, coefficient of variation and number of active experts."""
    total = F.sum("mean_weight").over(Window.partitionBy("layer"))
    return (
        means.withColumn("_share", F.col("mean_weight") / (total + EPSILON))
        .groupBy("layer")
        .agg(
            _entropy(F.col("_share")).alias("weight_entropy"),
            _variation().alias("weight_cv"),
            F.count_if(F.col("mean_weight") > active_above).alias("active_experts"),
        )
    )


def collapse_stats(means: DataFrame) -> DataFrame:
    """Per layer: extremes and sample deviation of the means; collapse is 1 - variation."""
    return means.groupBy("layer").agg(
        F.max("mean_weight").alias("max_weight"),
        F.min("mean_weight").alias("min_weight"),
        F.stddev_samp("mean_weight").alias("router_weight_std"),
        (1 - _variation()).alias("collapse_score"),
    )


def balance_dense(means: DataFrame) -> DataFrame:
    """Experts times the sum of squared mean probabilities, per layer."""
    squares = F.sum(F.col("mean_weight") * F.col("mean_weight"))
    return means.groupBy("layer").agg((F.count("*") * squares).alias("balance_loss"))


def balance_sparse(probabilities: DataFrame, experts: DataFrame) -> DataFrame:
    """Experts times the sum of dispatch share times mean full softmax, per layer."""
    product = F.col("dispatch_share") * F.col("mean_weight")
    shares = experts.select("layer", "expert_id", "dispatch_share")
    return (
        probabilities.join(shares, ["layer", "expert_id"])
        .groupBy("layer")
        .agg((F.count("*") * F.sum(product)).alias("balance_loss"))
    )


def balance_variance(means: DataFrame) -> DataFrame:
    """Sample variance of the mean weights, per layer."""
    return means.groupBy("layer").agg(F.var_samp("mean_weight").alias("balance_loss"))


def balance_total(losses: DataFrame, coefficient: float = BALANCE_COEFFICIENT) -> DataFrame:
    """Coefficient times the mean of the layers' losses; zeros are left out, 0 if none remain."""
    nonzero = F.avg(F.nullif(F.col("balance_loss"), F.lit(0.0)))
    return losses.agg(F.coalesce(coefficient * nonzero, F.lit(0.0)).alias("balance_loss"))


#: Scalar names of the sparse router, with the columns they come from
#: and the name of the mean over layers where there is one.
LAYER_SCALARS = {
    "weight_entropy": ("entropy", "global_entropy"),
    "weight_cv": ("cv", "global_cv"),
    "active_experts": ("active_experts", "global_active_experts"),
    "max_over_mean_load": ("max_over_mean_load", "global_max_over_mean_load"),
    "hot_expert_count": ("hot_expert_count", None),
    "overflow_fraction": ("overflow_fraction", "global_overflow_fraction"),
    "collapse_score": ("collapse_score", None),
    "router_weight_std": ("router_weight_std", None),
}


def layer_metric_log(layer_stats: DataFrame, losses: DataFrame) -> DataFrame:
    """Statistics per layer (a column each) and losses to named scalars ``(tag, value)``."""
    present = [c for c in LAYER_SCALARS if c in layer_stats.columns]
    numbers = layer_stats.select("layer", *[F.col(c).cast("double").alias(c) for c in present])
    names = F.create_map(*[F.lit(x) for c in present for x in (c, LAYER_SCALARS[c][0])])
    per_layer = numbers.unpivot(["layer"], present, "_name", "value").select(
        F.format_string("routing/layer%02d/%s", "layer", names[F.col("_name")]).alias("tag"), "value"
    )
    wide = [c for c in present if LAYER_SCALARS[c][1]]
    tags = [f"routing/{LAYER_SCALARS[c][1]}" for c in wide]
    means = numbers.agg(*[F.avg(c).alias(t) for c, t in zip(wide, tags)])
    overall = means.unpivot([], [f"`{t}`" for t in tags], "tag", "value")
    total = balance_total(losses).select(
        F.lit("routing/balance_loss").alias("tag"), F.col("balance_loss").alias("value")
    )
    return per_layer.unionByName(overall).unionByName(total)


def sparse_layer_stats(experts: DataFrame) -> DataFrame:
    """All per-layer statistics of a sparse router after capacity, from its expert table."""
    overflow = experts.groupBy("layer").agg(
        (F.sum(F.col("raw_tokens") - F.col("tokens")) / F.sum("_tokens")).alias("overflow_fraction")
    )
    stats = routing_stats(experts).join(expert_load_stats(experts), "layer")
    return stats.join(overflow, "layer")


def global_expert_load(means: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over layers per expert, then max, mean, their ratio and entropy, per group if ``keys`` are given."""
    experts = means.groupBy(*keys, "expert_id").agg(F.avg("mean_weight").alias("mean_weight"))
    # One row per expert: the number of experts bounds the arrays.
    loads = experts.groupBy(*keys).agg(F.collect_list("mean_weight").alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    loads = loads.withColumn("total", total).withColumn("mean", F.col("total") / F.size("w"))
    shares = F.transform("w", lambda x: x / (F.col("total") + EPSILON))
    entropy = -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.ln(p + LOG_EPSILON))
    return loads.select(
        *keys,
        F.array_max("w").alias("max_mean_expert_weight"),
        F.col("mean").alias("mean_expert_weight"),
        (F.array_max("w") / (F.col("mean") + EPSILON)).alias("max_mean_ratio"),
        entropy.alias("expert_weight_entropy"),
    )


def token_counts_mean(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over layers of the tokens per expert, per group if ``keys`` are given."""
    return counts.groupBy(*keys, "expert_id").agg(F.avg("tokens").alias("mean_tokens"))


def with_expert_figures(report: DataFrame, means: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A benchmark report with its expert load and ``per_expert_token_counts``, by expert; null without experts."""
    # One entry per expert: the number of experts bounds the arrays.
    entries = F.array_sort(F.collect_list(F.struct("expert_id", "mean_tokens")))
    tokens = token_counts_mean(counts, keys).groupBy(*keys).agg(entries.alias("_e"))
    tokens = tokens.select(*keys, F.col("_e.mean_tokens").alias("per_expert_token_counts"))
    return join_on(join_on(report, global_expert_load(means, keys), keys, "left"), tokens, keys, "left")


def hot_expert_flags(counts: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Per expert: count, mean of its group and whether it exceeds twice that mean."""
    average = F.avg(tokens).over(Window.partitionBy(*keys))
    return counts.withColumn("group_mean", average).withColumn(
        "is_hot", F.col(tokens) > HOT_FACTOR * F.col("group_mean")
    )


def expert_heatmap(means: DataFrame, num_experts: int) -> DataFrame:
    """Layer x expert matrix, a column per expert."""
    wide = means.groupBy("layer").pivot("expert_id", list(range(num_experts))).agg(F.first("mean_weight"))
    return wide.select("layer", *[F.col(str(e)).alias(f"expert_{e}") for e in range(num_experts)])


def contribution_box(means: DataFrame) -> DataFrame:
    """Per expert over the layers: minimum, quartiles, maximum; and one collapse score.

    The score is 1 - population deviation over mean of the experts' means.
    """
    experts = means.groupBy("expert_id").agg(
        F.percentile("mean_weight", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("_q"),
        F.avg("mean_weight").alias("_mean"),
    )
    score = 1 - F.stddev_pop("_mean") / (F.avg("_mean") + EPSILON)
    names = ("low", "q1", "median", "q3", "high")
    return experts.select(
        "expert_id",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(names)],
        experts.agg(score.alias("score")).scalar().alias("collapse_score"),
    )
