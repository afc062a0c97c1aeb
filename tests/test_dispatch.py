"""Dispatch inside token rows against a dense model, and its plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.functions.columns import softmax
from runloom.operators import dispatch, queues, routing

EXPERTS = 4
SCHEMA = "layer INT, batch_id INT, token_id INT, logits ARRAY<DOUBLE>"


def rows(logits):
    """Logits [layer, batch, token, expert] as rows; token ids are not in reading order."""
    shape = logits.shape
    return [
        (l, b, (t * 7) % shape[2], [float(x) for x in logits[l, b, t]])
        for l in range(shape[0]) for b in range(shape[1]) for t in range(shape[2])
    ]


def dense_dispatch(data, k, factor):
    """By row: (expert, kept, weight) of each pick."""
    found, queue = {}, {}
    for l, b, t, x in data:
        picks = sorted(range(len(x)), key=lambda e: (-x[e], e))[:k]
        found[l, b, t] = [[e, True, x[e]] for e in picks]
        for e in picks:
            queue.setdefault((l, b, e), []).append((-x[e], t))
    sizes = {}
    for l, b, t, _ in data:
        sizes[l, b] = sizes.get((l, b), 0) + 1
    for (l, b, e), members in queue.items():
        capacity = math.ceil(factor * sizes[l, b] / EXPERTS)
        for _, t in sorted(members)[capacity:]:
            next(p for p in found[l, b, t] if p[0] == e)[1] = False
    for picks in found.values():
        top = max((p[2] for p in picks if p[1]), default=0)
        total = sum(math.exp(p[2] - top) for p in picks if p[1])
        for p in picks:
            p[2] = math.exp(p[2] - top) / total if p[1] else 0.0
    return found


@pytest.fixture(scope="module", params=["spread", "ties", "equal", "large"])
def case(request, spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(2, 3, 120, EXPERTS))
    if request.param == "ties":
        values = values.round(0)
    if request.param == "equal":
        values[:] = 1.5
    if request.param == "large":  # queues far beyond the number of quantiles
        values = rng.normal(size=(1, 1, 5000, EXPERTS)).round(3)
        values[..., 0] += 2
    data = rows(values) if request.param != "large" else [(0, 0, t, [float(x) for x in values[0, 0, t]]) for t in range(5000)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.mark.parametrize("factor", [0.02, 0.5, 1.25, 9.0])
def test_dispatch_equals_the_dense_model(case, factor):
    data, tokens = case
    expected = dense_dispatch(data, 2, factor)
    got = dispatch.dispatch(tokens, 2, factor).collect()
    assert len(got) == len(data)
    for r in got:
        want = expected[r.layer, r.batch_id, r.token_id]
        assert [(p.expert_id, p.kept) for p in r.picks] == [(e, kept) for e, kept, _ in want]
        assert [p.weight for p in r.picks] == pytest.approx([w for *_, w in want])


def test_marks_of_rows_agree_with_token_rows(case):
    _, tokens = case
    marked = routing.capacity_enforce(routing.topk_route(tokens), tokens, 0.7)
    inside = dispatch.assignments(dispatch.dispatch(tokens, 2, 0.7))
    names = ["layer", "batch_id", "token_id", "expert_id", "kept"]
    assert sorted(marked.select(names).collect()) == sorted(inside.select(names).collect())


def test_figures_by_position(case):
    _, tokens = case
    dispatched = dispatch.dispatch(tokens, 2, 0.7)
    by_row = routing.expert_table(tokens, dispatch.assignments(dispatched), EXPERTS)
    by_position = dispatch.expert_sums(dispatched, EXPERTS)
    key = lambda r: (r.layer, r.expert_id)
    for a, b in zip(sorted(by_row.collect(), key=key), sorted(by_position.collect(), key=key)):
        assert (key(a), a.raw_tokens, a.tokens) == (key(b), b.raw_tokens, b.tokens)
        assert (a.mean_weight, a.dispatch_share) == (pytest.approx(b.mean_weight), pytest.approx(b.dispatch_share))
    means = routing.mean_expert_weights(tokens, routing.router_softmax(tokens))
    losses = {r.layer: r.balance_loss for r in routing.balance_sparse(means, by_row).collect()}
    assert {r.layer: r.balance_loss for r in dispatch.balance_loss(by_position).collect()} == pytest.approx(losses)
    dense = {key(r): r.mean_weight for r in means.collect()}
    assert {key(r): r.mean_weight for r in dispatch.mean_weights(tokens, softmax(F.col("logits")), EXPERTS).collect()} == pytest.approx(dense)


def test_no_capacity_keeps_all_and_empty_tables_stay_empty(spark):
    data = rows(np.random.default_rng(1).normal(size=(1, 1, 9, EXPERTS)))
    free = dispatch.dispatch(spark.createDataFrame(data, SCHEMA), 2, 0)
    assert all(p.kept for r in free.collect() for p in r.picks)
    none = spark.createDataFrame([], SCHEMA)
    assert dispatch.dispatch(none, 2, 1.25).collect() == []
    assert dispatch.expert_sums(dispatch.dispatch(none, 2, 1.25), EXPERTS).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_assignments_are_not_shuffled(spark):
    data = rows(np.random.default_rng(2).normal(size=(2, 2, 50, EXPERTS)))
    tokens = spark.createDataFrame(data, SCHEMA)
    dispatched = dispatch.dispatch(tokens, 2, 0.5)
    text = plan(dispatched)
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    # One shuffle of a row per layer and task for all figures and the loss.
    assert plan(dispatch.balance_loss(dispatch.expert_sums(dispatched, EXPERTS))).count("Exchange hashpartitioning") == 1


def test_cuts_hold_one_map_per_batch(spark):
    data = rows(np.random.default_rng(2).normal(size=(1, 3, 50, EXPERTS)))
    assigned = routing.topk_route(spark.createDataFrame(data, SCHEMA))
    cuts = queues.queue_cuts(assigned, 0.3).collect()
    assert {(r.layer, r.batch_id) for r in cuts} == {(0, b) for b in range(3)}
    assert all(set(r.cuts) <= set(range(EXPERTS)) for r in cuts)
