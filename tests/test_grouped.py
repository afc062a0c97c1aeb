"""Large-group forms against brute force: tiny limits make every group large."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import grouped
from runloom.operators.latency import GROUP, benchmark_report, stall_ratio
from runloom.operators.routing import capacity_enforce
from runloom.operators.series import rolling_percentiles, smooth_centered, step_durations
from runloom.session import checkpointed, scratch_path


def make_rows(seed, n=600):
    """One key holds more than a third of the rows; values have many ties; one key is null."""
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", "c", None]
    return [(i, rng.choice(keys), round(rng.choice([rng.random() * 50, 7.0, 7.0]), 1)) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    rows = make_rows(1)
    return rows, spark.createDataFrame(rows, "id INT, key STRING, value DOUBLE").repartition(5)


def grouped_rows(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    return groups


def test_largest_group(spark, hot):
    rows, df = hot
    assert grouped.largest_group(df, ["key"]) == max(map(len, grouped_rows(rows).values()))
    assert grouped.largest_group(df.limit(0), ["key"]) == 0


@pytest.mark.parametrize("limit", [20, 10_000])
def test_row_positions(hot, limit):
    rows, df = hot
    order = [F.desc("value"), "id"]
    got = {r["id"]: r["position"] for r in grouped.row_positions(df, ["key"], order, group_rows=limit).collect()}
    for group in grouped_rows(rows).values():
        for place, row in enumerate(sorted(group, key=lambda r: (-r[2], r[0])), 1):
            assert got[row[0]] == place
    assert len(got) == len(rows)


def test_row_positions_of_the_whole_table(hot):
    rows, df = hot
    got = grouped.row_positions(df, [], ["id"], group_rows=10).collect()
    assert {r["id"]: r["position"] for r in got} == {r[0]: r[0] + 1 for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_exact_percentiles(spark, seed, limit):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, "id INT, key STRING, value DOUBLE")
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "high": 1.0}
    got = {r["key"]: r for r in grouped.exact_percentiles(df, ["key"], "value", shares, limit).collect()}
    expected = grouped_rows(rows)
    assert set(got) == set(expected)
    for key, group in expected.items():
        for name, share in shares.items():
            assert got[key][name] == pytest.approx(np.quantile([r[2] for r in group], share))


@pytest.mark.parametrize("limit", [1, 100])
def test_percentiles_of_missing_and_single_values(spark, limit):
    rows = [("none", None), ("none", None), ("one", 3.0), ("one", None), ("tie", 2.0), ("tie", 2.0), ("tie", 2.0)]
    df = spark.createDataFrame(rows, "key STRING, value DOUBLE")
    got = {r["key"]: r["p"] for r in grouped.exact_percentiles(df, ["key"], "value", {"p": 0.5}, limit).collect()}
    assert got == {"none": None, "one": 3.0, "tie": 2.0}


@pytest.mark.parametrize("limit", [120, 10_000])
def test_rolling_percentiles(hot, limit):
    rows, df = hot
    got = {r["id"]: r for r in rolling_percentiles(df, ["key"], ["id"], "value", group_rows=limit).collect()}
    assert len(got) == len(rows)
    for group in grouped_rows(rows).values():
        values = [r[2] for r in group]
        for i, row in enumerate(group):
            frame = values[max(0, i - 99): i + 1]
            for name, share in (("p50", 50), ("p95", 95), ("p99", 99)):
                assert got[row[0]][name] == pytest.approx(np.percentile(frame, share))


@pytest.mark.parametrize("limit", [25, 10_000])
@pytest.mark.parametrize("width", [1, 5, 10, 70])
def test_smooth_centered(hot, limit, width):
    rows, df = hot
    smoothed = smooth_centered(df, width, keys=["key"], order="id", group_rows=limit)
    got = {r["id"]: r["smoothed"] for r in smoothed.collect()}
    assert len(got) == len(rows)
    for group in grouped_rows(rows).values():
        values = [r[2] for r in group]
        if len(values) >= width:
            values = np.convolve(values, np.ones(width) / width, mode="same")
        for row, value in zip(group, values):
            assert got[row[0]] == pytest.approx(value)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_step_durations(spark, limit):
    rng = random.Random(5)
    rows = [(i, rng.choice("hha"), rng.randrange(500)) for i in range(300)]
    df = spark.createDataFrame(rows, "id INT, key STRING, at INT")
    df = df.withColumn("ts", F.timestamp_millis(F.col("at").cast("long")))
    got = {r["id"]: r["elapsed_ms"] for r in step_durations(df, ["key"], "ts", "id", limit).collect()}
    for key in "ha":
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert got[group[0][0]] is None
        for before, row in zip(group, group[1:]):
            assert got[row[0]] == row[2] - before[2]


@pytest.mark.parametrize("limit", [5, 10_000])
def test_capacity_of_a_crowded_expert(spark, limit):
    rng = random.Random(9)
    rows = [(0, 0, t, 4, 0, 0 if rng.random() < 0.8 else rng.randrange(4), float(rng.randrange(5))) for t in range(200)]
    df = spark.createDataFrame(
        rows, "layer INT, batch_id INT, token_id INT, num_experts INT, choice INT, expert_id INT, logit DOUBLE"
    )
    got = {r["token_id"]: r["kept"] for r in capacity_enforce(df, df, 1.25, limit).collect()}
    capacity = int(np.ceil(1.25 * 200 / 4))
    for expert in range(4):
        queue = sorted((r for r in rows if r[5] == expert), key=lambda r: (-r[6], r[2]))
        for place, row in enumerate(queue):
            assert got[row[2]] == (place < capacity)


def test_report_is_the_same_for_large_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xxxy"), rng.choice(["p", "q"]), rng.expovariate(1), rng.randrange(90)) for _ in range(500)]
    df = spark.createDataFrame(rows, "method STRING, workload STRING, latency_s DOUBLE, output_tokens INT")
    small = {(r.method, r.workload): r.asDict() for r in benchmark_report(df).collect()}
    large = {(r.method, r.workload): r.asDict() for r in benchmark_report(df, group_rows=8).collect()}
    assert small.keys() == large.keys() and len(small) == 4
    for key, row in small.items():
        for name, value in row.items():
            assert large[key][name] == (pytest.approx(value) if isinstance(value, float) else value)
    assert stall_ratio(df, GROUP, 8).count() == 4


def test_scratch_and_checkpoint_use_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(folder)
    assert folder.removeprefix("file://") in spark.sparkContext.getCheckpointDir()
    assert checkpointed(spark.range(3)).count() == 3
