"""The last points of each series, kept by a stream."""

import random

from runloom.operators import summary
from runloom.streaming.tail_log import SCHEMA, TailLog


def points(seed, n=200):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b"]), rng.choice(["train/loss", "train/routing/global_cv", "x"]), rng.randrange(1000), rng.random()) for _ in range(n)]


def last(rows, count):
    found = []
    for key in {r[:2] for r in rows}:
        found += sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[2], -r[3]))[:count]
    return sorted(found)


def test_versions_follow_the_micro_batches(spark, tmp_path):
    log, rows = TailLog(spark, str(tmp_path / "tails"), points=5), points(1)
    assert log.read().collect() == []
    for batch in range(4):
        log.update(spark.createDataFrame(rows[batch * 50 : batch * 50 + 50], SCHEMA), batch)
        assert sorted(map(tuple, log.read().collect())) == last(rows[: batch * 50 + 50], 5)
    # A micro-batch that runs again replaces its own version.
    log.update(spark.createDataFrame(rows[150:], SCHEMA), 3)
    assert sorted(map(tuple, log.read().collect())) == last(rows, 5)
    assert sorted(map(tuple, log.read(before=2).collect())) == last(rows[:100], 5)


def test_summary_over_several_triggers_and_a_restart(spark, tmp_path):
    rows = points(2, 400)
    log = TailLog(spark, str(tmp_path / "tails"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        log.follow(stream).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for part in range(4):
        spark.createDataFrame(rows[part::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == 1:
            run()
    run()
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run STRING")
    evals = spark.createDataFrame([("a", 1.0)], "run STRING, eval_loss DOUBLE")
    whole = summary.run_summary(runs, spark.createDataFrame(rows, SCHEMA), evals)
    kept = summary.run_summary(runs, log.read(), evals)
    assert sorted(whole.collect(), key=repr) == sorted(kept.collect(), key=repr)
    assert log.read().count() <= 6 * 50
