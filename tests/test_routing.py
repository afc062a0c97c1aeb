"""Routing against a dense numpy model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import routing

EXPERTS, LAYERS, TOKENS = 4, 2, 40


@pytest.fixture(scope="module")
def logits():
    """Logits [layer, token, expert]: one favourite expert, one never chosen, some ties."""
    values = np.random.default_rng(4).normal(size=(LAYERS, TOKENS, EXPERTS)).round(1)
    values[:, :, 0] += 3
    values[:, :, 3] -= 9
    return values


@pytest.fixture(scope="module")
def tokens(spark, logits):
    rows = [(l, 0, t, [float(x) for x in logits[l, t]]) for l in range(LAYERS) for t in range(TOKENS)]
    return spark.createDataFrame(rows, "layer INT, batch_id INT, token_id INT, logits ARRAY<DOUBLE>")


def softmax(x):
    finite = np.where(np.isneginf(x).all(-1, keepdims=True), 0, x)
    powers = np.exp(finite - finite.max(-1, keepdims=True))
    return powers / powers.sum(-1, keepdims=True)


def dense(rows, column="weight"):
    out = np.zeros((LAYERS, TOKENS, EXPERTS))
    for r in rows:
        out[r.layer, r.token_id, r.expert_id] = getattr(r, column)
    return out


def top(logits, k):
    chosen = np.zeros(logits.shape, bool)
    np.put_along_axis(chosen, np.argsort(-logits, axis=-1, kind="stable")[..., :k], True, -1)
    return chosen


def capped(logits, k, factor):
    """Chosen cells that stay within capacity, lower token first among equals."""
    chosen = top(logits, k)
    capacity = math.ceil(factor * TOKENS / EXPERTS)
    kept = np.zeros(chosen.shape, bool)
    for layer in range(LAYERS):
        for e in range(EXPERTS):
            queue = sorted(np.flatnonzero(chosen[layer, :, e]), key=lambda t: (-logits[layer, t, e], t))
            kept[layer, queue[:capacity], e] = True
    return chosen, kept


def test_softmax_and_sigmoid(tokens, logits):
    np.testing.assert_allclose(dense(routing.router_softmax(tokens).collect()), softmax(logits))
    np.testing.assert_allclose(dense(routing.router_sigmoid(tokens).collect()), 1 / (1 + np.exp(-logits)))


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([(0, 0, 0, [1000.0, 1000.0, -1000.0])], "layer INT, batch_id INT, token_id INT, logits ARRAY<DOUBLE>")
    assert [r.weight for r in routing.router_softmax(df).collect()] == [0.5, 0.5, 0.0]


def test_long_and_wide_forms_agree(tokens):
    long = tokens.select("layer", "batch_id", "token_id", F.posexplode("logits").alias("expert_id", "logit"))
    assert sorted(routing.to_token_rows(long.repartition(5)).collect()) == sorted(tokens.collect())


@pytest.mark.parametrize("k", [0, 1, 2, 3, 9])
def test_topk(tokens, logits, k):
    rows = routing.topk_route(tokens, k).collect()
    chosen = top(logits, min(k or 2, EXPERTS))
    np.testing.assert_allclose(dense(rows), softmax(np.where(chosen, logits, -np.inf)))
    assert len(rows) == chosen.sum()


def test_ties_go_to_the_lower_expert(spark):
    df = spark.createDataFrame([(0, 0, 0, [1.0, 2.0, 2.0, 2.0])], "layer INT, batch_id INT, token_id INT, logits ARRAY<DOUBLE>")
    assert [r.expert_id for r in routing.topk_route(df).collect()] == [1, 2]


@pytest.mark.parametrize("k", [0, 2, 4])
def test_softmax_form_is_dense_without_k(tokens, k):
    assert routing.topk_or_dense(tokens, EXPERTS, k).count() == LAYERS * TOKENS * (k or EXPERTS)


@pytest.mark.parametrize("factor", [0.05, 0.5, 1.25])
def test_capacity(tokens, logits, factor):
    assigned = routing.capacity_enforce(routing.topk_route(tokens), tokens, factor)
    chosen, kept = capped(logits, 2, factor)
    assert (dense(assigned.collect(), "kept") == kept).all()
    weights = dense(routing.renormalize_kept(assigned).collect())
    expected = np.where(kept.any(-1, keepdims=True), softmax(np.where(kept, logits, -np.inf)), 0)
    np.testing.assert_allclose(weights, expected)
    assert factor > 1 or (weights.sum(-1) == 0).any()          # some tokens lose every expert
    for row in routing.overflow_fraction(assigned).collect():
        dropped = (chosen & ~kept)[row.layer]
        assert row.overflow_fraction == pytest.approx(dropped.mean())
        assert row.dropped_share == pytest.approx(dropped.sum() / chosen[row.layer].sum())


def test_capacity_off(tokens):
    off = routing.capacity_enforce(routing.topk_route(tokens), tokens, 0)
    assert off.filter(~F.col("kept")).count() == 0


@pytest.fixture(scope="module")
def kept(tokens):
    return routing.capacity_enforce(routing.topk_route(tokens), tokens, 1.25)


def test_load(tokens, logits, kept):
    chosen, stays = capped(logits, 2, 1.25)
    counts = routing.expert_table(tokens, kept)
    rows = counts.collect()
    assert len(rows) == LAYERS * EXPERTS                       # the idle expert is listed
    for r in rows:
        assert (r.raw_tokens, r.tokens) == (chosen[r.layer, :, r.expert_id].sum(), stays[r.layer, :, r.expert_id].sum())
    for r in routing.expert_load_stats(counts).collect():
        n = stays[r.layer].sum(0)
        assert r.max_over_mean_load == pytest.approx(n.max() / (n.mean() + 1e-8))
        assert r.hot_expert_count == (n > 2 * n.mean()).sum()
        assert r.load_variance == pytest.approx(n.var(ddof=1))
    for r in routing.token_counts_mean(counts).collect():
        assert r.mean_tokens == pytest.approx(stays.sum(1).mean(0)[r.expert_id])
    for r in routing.hot_expert_flags(counts, ["layer"]).collect():
        n = stays[r.layer].sum(0)
        assert r.is_hot == (n[r.expert_id] > 2 * n.mean())


def test_statistics_of_means(tokens, logits, kept):
    weights = dense(routing.renormalize_kept(kept).collect())
    means = routing.mean_expert_weights(tokens, routing.renormalize_kept(kept))
    expected = weights.mean(1)
    got = np.zeros((LAYERS, EXPERTS))
    for r in means.collect():
        got[r.layer, r.expert_id] = r.mean_weight
    np.testing.assert_allclose(got, expected)
    for r in routing.routing_stats(means).collect():
        m = expected[r.layer]
        p = m / (m.sum() + 1e-8)
        assert r.weight_entropy == pytest.approx(-(p * np.log(p + 1e-9)).sum())
        assert r.weight_cv == pytest.approx(m.std(ddof=1) / (m.mean() + 1e-8))
        assert r.active_experts == (m > 0.01).sum()
    for r in routing.collapse_stats(means).collect():
        m = expected[r.layer]
        assert (r.max_weight, r.min_weight) == (pytest.approx(m.max()), pytest.approx(m.min()))
        assert r.collapse_score == pytest.approx(1 - m.std(ddof=1) / (m.mean() + 1e-8))
    for r in routing.contribution_box(means).collect():
        column = expected[:, r.expert_id]
        assert [r.low, r.q1, r.median, r.q3, r.high] == pytest.approx(np.quantile(column, [0, 0.25, 0.5, 0.75, 1]))
        over = expected.mean(0)
        assert r.collapse_score == pytest.approx(1 - over.std() / (over.mean() + 1e-8))
    row = routing.global_expert_load(means).first()
    over = expected.mean(0)
    assert row.max_mean_ratio == pytest.approx(over.max() / (over.mean() + 1e-8))
    heat = routing.expert_heatmap(means, EXPERTS).orderBy("layer").collect()
    np.testing.assert_allclose([r[1:] for r in heat], expected)


def test_balance(spark, tokens, logits, kept):
    probabilities = softmax(logits).mean(1)
    means = routing.mean_expert_weights(tokens, routing.router_softmax(tokens))
    losses = {r.layer: r.balance_loss for r in routing.balance_dense(means).collect()}
    assert losses == pytest.approx({l: EXPERTS * (probabilities[l] ** 2).sum() for l in range(LAYERS)})
    shares = capped(logits, 2, 1.25)[1].mean(1)
    sparse = {r.layer: r.balance_loss for r in routing.balance_sparse(means, routing.expert_table(tokens, kept)).collect()}
    assert sparse == pytest.approx({l: EXPERTS * (shares[l] * probabilities[l]).sum() for l in range(LAYERS)})
    variance = {r.layer: r.balance_loss for r in routing.balance_variance(means).collect()}
    assert variance == pytest.approx({l: probabilities[l].var(ddof=1) for l in range(LAYERS)})
    table = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 4.0)], "layer INT, balance_loss DOUBLE")
    assert routing.balance_total(table).first()[0] == pytest.approx(0.03)
    assert routing.balance_total(table.filter("layer = 1")).first()[0] == 0


def test_metric_log(tokens, kept):
    experts = routing.expert_table(tokens, routing.renormalize_kept(kept))
    probabilities = routing.mean_expert_weights(tokens, routing.router_softmax(tokens))
    losses = routing.balance_sparse(probabilities, experts)
    log = {r.tag: r.value for r in routing.layer_metric_log(routing.sparse_layer_stats(experts), losses).collect()}
    assert {"routing/layer00/entropy", "routing/layer01/hot_expert_count", "routing/global_overflow_fraction", "routing/balance_loss"} <= set(log)
    assert log["routing/global_cv"] == pytest.approx((log["routing/layer00/cv"] + log["routing/layer01/cv"]) / 2)
    assert "routing/global_hot_expert_count" not in log


def test_metric_log_of_sigmoid_routing(tokens):
    means = routing.mean_expert_weights(tokens, routing.router_sigmoid(tokens))
    stats = routing.routing_stats(means, routing.ACTIVE_SIGMOID).join(routing.collapse_stats(means), "layer")
    tags = {r.tag for r in routing.layer_metric_log(stats, routing.balance_variance(means)).collect()}
    assert {"routing/layer00/collapse_score", "routing/layer01/router_weight_std"} <= tags


def test_rows_of_a_token_are_not_shuffled(tokens):
    for routed in (routing.router_softmax(tokens), routing.topk_route(tokens)):
        assert "Exchange" not in routed._jdf.queryExecution().executedPlan().toString()
