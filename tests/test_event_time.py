"""Streams in event time: order, late rows, restart, and a chain of two stateful operators."""

import datetime as dt
import random

import numpy as np
import pytest

from runloom.streaming import event_time, rolling

START = dt.datetime(2024, 3, 30, 20)
SCHEMA = "key STRING, at TIMESTAMP_NTZ, id BIGINT, value DOUBLE, kind STRING"


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rolling.STATE_STORE)


def made(n, seed=3):
    """Rows over ten hours with ties in time, one hot key and one without a name."""
    rng = random.Random(seed)
    return [
        (rng.choice(["hot", "hot", "b", None]), START + dt.timedelta(seconds=60 * rng.randrange(600)), i, rng.random(), rng.choice(["begin", "end"]))
        for i in range(n)
    ]


def closing(hours=40):
    return [("closing", START + dt.timedelta(hours=hours), -1, 0.0, "end")]


def feed(spark, tmp_path, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, transform):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        transform(stream)
        .writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    return query, spark.read.parquet(str(tmp_path / "out")).collect()


def interleaved(rows, parts):
    """Every part covers the whole time."""
    return [rows[i::parts] for i in range(parts)]


def expected_rolling(rows, window):
    found = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(group):
            found[row[2]] = np.percentile([r[3] for r in group[max(0, i - window + 1) : i + 1]], [50, 95, 99])
    return found


def rolled(window):
    return lambda s: event_time.rolling_percentiles(s, ["key"], "at", ["id"], "value", "11 hours", rows=window)


@pytest.mark.parametrize("window", [1, 7])
def test_interleaved_files_equal_the_batch_form(spark, tmp_path, window):
    rows = made(300)
    feed(spark, tmp_path, [*interleaved(rows, 3), closing()])
    _, out = run(spark, tmp_path, rolled(window))
    expected = expected_rolling(rows, window)
    assert {r.id for r in out} == set(expected) and len(out) == len(rows)
    assert {r.id: r.key for r in out} == {r[2]: r[0] for r in rows}
    for r in out:
        assert [r.p50, r.p95, r.p99] == pytest.approx(expected[r.id])


def test_state_survives_a_restart(spark, tmp_path):
    rows = made(200, seed=5)
    parts = interleaved(rows, 2)
    feed(spark, tmp_path, parts[:1])
    _, out = run(spark, tmp_path, rolled(9))
    assert out == []  # the watermark has passed nothing yet
    feed(spark, tmp_path, [parts[1], closing()])
    _, out = run(spark, tmp_path, rolled(9))
    expected = expected_rolling(rows, 9)
    assert {r.id for r in out} == set(expected)
    for r in out:
        assert [r.p50, r.p95, r.p99] == pytest.approx(expected[r.id])


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    rows = made(60, seed=6)
    late = [("hot", START - dt.timedelta(hours=1), 1000 + i, 1.0, "end") for i in range(4)]
    # A part of its own lets the watermark pass before the late rows come.
    feed(spark, tmp_path, [rows, closing(30), closing(31), late, closing(50)])
    counter = event_time.LateRows()
    spark.streams.addListener(counter)
    try:
        query, out = run(spark, tmp_path, rolled(5))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(counter)
    assert {r.id for r in out if r.id >= 0} == {r[2] for r in rows}
    assert counter.rows[str(query.id)] == len(late)


def expected_pairs(rows, expiry=None):
    found = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for before, row in zip(group, group[1:]):
            elapsed = (row[1] - before[1]).total_seconds() * 1000
            if (before[4], row[4]) == ("begin", "end") and (expiry is None or elapsed <= expiry):
                found[row[2]] = elapsed
    return found


@pytest.mark.parametrize("expiry", [None, 120_000])
def test_pairs_in_order_of_time(spark, tmp_path, expiry):
    rows = made(240, seed=8)
    feed(spark, tmp_path, [*interleaved(rows, 3), closing()])
    _, out = run(spark, tmp_path, lambda s: event_time.step_pairs(s, ["key"], "at", ["id"], "kind", "11 hours", expiry))
    assert {r.id: r.elapsed_ms for r in out} == expected_pairs(rows, expiry)


def test_pairs_feed_rolling_step_times(spark, tmp_path):
    rows = made(240, seed=9)
    feed(spark, tmp_path, [*interleaved(rows, 3), closing()])

    def chain(stream):
        pairs = event_time.step_pairs(stream, ["key"], "at", ["id"], "kind", "11 hours")
        return rolling.stream_rolling_percentiles(pairs, "key", ["end_micros", "id"], "elapsed_ms", 4)

    _, out = run(spark, tmp_path, chain)
    pairs, at = expected_pairs(rows), {r[2]: (r[0], r[1]) for r in rows}
    assert {r.id: r.elapsed_ms for r in out} == pairs
    for r in out:
        group = sorted((i for i in pairs if at[i][0] == r.key), key=lambda i: (at[i][1], i))
        place = group.index(r.id)
        frame = [pairs[i] for i in group[max(0, place - 3) : place + 1]]
        assert [r.p50, r.p95, r.p99] == pytest.approx(np.percentile(frame, [50, 95, 99]))


def test_times_without_value_and_empty_stream(spark, tmp_path):
    feed(spark, tmp_path, [[("a", None, 1, 1.0, "end"), ("a", START, 2, None, "end")], closing()])
    _, out = run(spark, tmp_path, rolled(3))
    assert [(r.id, r.p50) for r in out] == [(2, None)] or [(r.id, np.isnan(r.p50)) for r in out] == [(2, True)]
