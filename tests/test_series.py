"""Latency and series operators on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from runloom.operators import latency, series, summary


def log(spark, rows):
    return spark.createDataFrame(rows, "run STRING, tag STRING, step BIGINT, value DOUBLE")


def test_zero_median_and_zero_time(spark):
    rows = [("m", "w", 0.0, 5), ("m", "w", 0.0, 5), ("m", "w", 0.0, 0)]
    df = spark.createDataFrame(rows, "method STRING, workload STRING, latency_s DOUBLE, output_tokens INT")
    row = latency.benchmark_report(df).first()
    assert (row.throughput_tokens_per_sec, row.tail_amplification, row.stall_ratio) == (0.0, 0.0, 0.0)
    assert (row.num_requests, row.total_output_tokens) == (3, 10)


def test_given_tail_wins(spark):
    report = spark.createDataFrame([(1.0, 4.0, 9.0), (1.0, 4.0, None)], "latency_p50_ms DOUBLE, latency_p99_ms DOUBLE, given DOUBLE")
    got = [r.tail_amplification for r in latency.tail_amplification(report, "given").collect()]
    assert got == [9.0, pytest.approx(4.0)]


def test_cdf_fills_the_last_point(spark):
    names = "method STRING, workload STRING, latency_p50_ms DOUBLE, latency_p95_ms DOUBLE, latency_p99_ms DOUBLE, latency_p999_ms DOUBLE"
    report = spark.createDataFrame([("m", "w", 1.0, 2.0, 10.0, None)], names)
    points = [(r.latency_ms, r.cdf) for r in latency.latency_cdf_points(report).collect()]
    assert points == [(0.0, 0.0), (1.0, 0.5), (2.0, 0.95), (10.0, 0.99), (pytest.approx(11.0), 0.999)]


def test_comparison_needs_both_methods(spark):
    report = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "y", 3)], "method STRING, workload STRING, n INT")
    rows = [r.asDict() for r in latency.compare_runs(report, "a", "b").collect()]
    assert rows == [{"workload": "x", "a_method": "a", "a_n": 1, "b_method": "b", "b_n": 2}]


def test_tail_and_final(spark):
    df = log(spark, [("r", "t", i, float(i)) for i in range(1, 61)] + [("s", "t", 1, 2.0)])
    assert {r.run: r.tail_mean for r in series.tail_mean(df).collect()} == {"r": 35.5, "s": 2.0}
    assert {r.run: r.final_value for r in series.final_value(df).collect()} == {"r": 60.0, "s": 2.0}


def test_tail_is_limited_before_the_shuffle(spark):
    plan = series.tail_mean(log(spark, [("r", "t", 1, 1.0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit"):]


def test_short_series_is_not_smoothed(spark):
    df = log(spark, [("r", "t", i, float(i)) for i in range(4)])
    assert [r.smoothed for r in series.smooth_centered(df, 5).orderBy("step").collect()] == [0, 1, 2, 3]
    true = series.smooth_centered(df, 3, true_average=True).orderBy("step").collect()
    assert [r.smoothed for r in true] == [0.5, 1, 2, 2.5]


def test_fallback(spark):
    df = log(spark, [("r", "a", 1, 1.0), ("r", "b", 1, 9.0), ("s", "b", 1, 2.0), ("t", "c", 1, 3.0)])
    got = sorted((r.run, r.tag) for r in series.series_fallback(df, ["a", "b"]).collect())
    assert got == [("r", "a"), ("s", "b")]


def test_rank_skew(spark):
    df = log(spark, [
        ("r", "train/step_time_ms/rank0/p50", 1, 10.0), ("r", "train/step_time_ms/rank0/p50", 2, 20.0),
        ("r", "train/step_time_ms/rank1/p50", 1, 30.0), ("r", "train/step_time_ms/rank1/p95", 1, 99.0),
        ("r", "step_time_ms/rank2/p50", 1, 1.0),
        ("one", "step_time_ms/rank0/p50", 1, 5.0), ("none", "train/step_time_ms/p50", 1, 5.0),
    ])
    got = {(r.run, r.rank): (r.median, r.skew) for r in series.rank_step_skew(df).collect()}
    assert got == {("r", 0): (15.0, pytest.approx(2.0)), ("r", 1): (30.0, pytest.approx(2.0)), ("one", 0): (5.0, None)}


def test_distribution(spark):
    df = log(spark, [("r", "t", i, float(i)) for i in range(11)] + [("flat", "t", 1, 3.0)])
    rows = series.step_time_distribution(df, bins=5, tags=["t"]).collect()
    bins = {r.bin: r.points for r in rows if r.run == "r"}
    assert bins == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    flat = [r for r in rows if r.run == "flat"][0]
    assert (flat.low, flat.median, flat.high, flat.bin, flat.points) == (3.0, 3.0, 3.0, 0, 1)


def test_distribution_takes_the_first_tag_of_a_run(spark):
    df = log(spark, [
        ("r", "train/step_time_ms/p50", 1, 4.0), ("r", "step_time_ms/p50", 1, 90.0), ("r", "train/step_time_ms/rank1/p50", 1, 70.0),
        ("s", "step_time_ms/p50", 1, 6.0), ("none", "train/step_time_ms/rank0/p50", 1, 8.0),
    ])
    assert {(r.run, r.median, r.points) for r in series.step_time_distribution(df).collect()} == {("r", 4.0, 1), ("s", 6.0, 1)}


def test_idle_time_is_no_step(spark):
    marks = [(1, "end", 0), (2, "begin", 10), (3, "end", 110), (4, "begin", 5000), (5, "begin", 5010), (6, "end", 5110), (7, "end", 6000)]
    df = spark.createDataFrame(marks, "id INT, kind STRING, ms INT").select("id", "kind", F.lit("k").alias("key"), F.timestamp_millis("ms").alias("ts"))
    for rows in (100, 2):
        got = series.step_durations(df, ["key"], "ts", "id", rows, "kind").orderBy("id").collect()
        assert [(r.id, r.elapsed_ms) for r in got] == [(3, 100.0), (6, 100.0)]


def test_timing_log(spark):
    df = spark.createDataFrame([("r", None, 1, 5.0), ("r", None, 2, 7.0), ("s", 3, 1, 2.0)], "run STRING, rank INT, step BIGINT, elapsed_ms DOUBLE")
    got = {(r.run, r.tag, r.step): r.value for r in series.timing_log(df).collect()}
    assert len(got) == 9 and got["r", "train/step_time_ms/p50", 2] == 6.0 and got["s", "train/step_time_ms/rank3/p99", 1] == 2.0


def test_few_groups_need_no_shuffle_of_requests(spark):
    df = spark.createDataFrame([("m", "w", 1.0, 5)], "method STRING, workload STRING, latency_s DOUBLE, output_tokens INT")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = latency.stall_ratio(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_published_perplexities(spark):
    losses = spark.createDataFrame([(1.172,), (1.143,), (1.155,), (1.134,)], "loss DOUBLE")
    got = [r[0] for r in losses.select(summary.perplexity(F.col("loss"))).collect()]
    assert got == [3.23, 3.14, 3.17, 3.11]


def test_summaries_keep_runs_without_metrics(spark):
    runs = spark.createDataFrame([("r",), ("bare",)], "run STRING")
    df = log(spark, [("r", "train/loss", 1, 2.0), ("r", "train/loss", 2, 1.23456), ("r", "train/routing/global_cv", 1, 0.5)])
    evals = spark.createDataFrame([("r", 1.0)], "run STRING, eval_loss DOUBLE")
    rows = {r.run: r for r in summary.run_summary(runs, df, evals).collect()}
    assert rows["r"].final_train_loss == 1.2346 and rows["r"].final_eval_perplexity == round(math.e, 2)
    assert rows["r"].mean_load_cv == 0.5 and rows["r"].mean_routing_entropy is None
    assert rows["bare"].asDict() == {c: "bare" if c == "run" else None for c in summary.HEADERS}
    report = spark.createDataFrame(
        [("r", "bursty", 12.34, 50.0)], "method STRING, workload STRING, latency_p50_ms DOUBLE, latency_p99_ms DOUBLE"
    )
    wide = {r.run: r for r in summary.run_summary_wide(runs, df, evals, report).collect()}
    assert (wide["r"].p99_latency_bursty, wide["r"].tail_amp_bursty) == (50.0, 4.052)
    assert wide["r"].p99_latency_homogeneous is None and wide["bare"].tail_amp_bursty is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["TIMESTAMP_NTZ", "TIMESTAMP"])
def test_times_do_not_depend_on_the_zone(spark, zone, kind):
    """Daylight saving time begins between the two times in one of the zones."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        mark = "Z" if kind == "TIMESTAMP" else ""
        texts = spark.createDataFrame(
            [(1, "k", f"2024-03-10 01:59:59.500001{mark}"), (2, "k", f"2024-03-10 04:00:00{mark}")], "id INT, key STRING, at STRING"
        )
        df = texts.select("id", "key", F.col("at").cast(kind).alias("ts"))
        assert [r.arrival_s for r in latency.arrival_offsets(df, ["key"], "ts").orderBy("id").collect()] == [0, 7200.499999]
        assert [r.elapsed_ms for r in series.step_durations(df, ["key"], "ts", "id").orderBy("id").collect()] == [None, 7200499.999]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
