"""Rolling percentiles over several micro-batches."""

import random

import numpy as np
import pytest

from runloom.streaming import rolling


@pytest.mark.parametrize("window", [1, 5, 100])
def test_state_goes_on_between_batches(spark, tmp_path, window):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "b"]), rng.random()) for i in range(300)]
    schema = "step BIGINT, key STRING, value DOUBLE"
    for batch in range(3):
        part = rows[batch * 100:(batch + 1) * 100]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rolling.STATE_STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (
        rolling.stream_rolling_percentiles(stream, "key", ["step"], "value", window)
        .writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(str(tmp_path / "out"))
    )
    run.awaitTermination()
    got = {r.step: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 300
    for key in ("hot", "b"):
        group = [r for r in rows if r[1] == key]
        for i, row in enumerate(group):
            frame = [r[2] for r in group[max(0, i - window + 1): i + 1]]
            assert [got[row[0]].p50, got[row[0]].p95, got[row[0]].p99] == pytest.approx(np.percentile(frame, [50, 95, 99]))
