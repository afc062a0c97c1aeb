"""Records as variants, approximate percentiles, manifests and joins that are counted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import latency, raw_records
from runloom.sources import records as record_files

LINES = [
    (0, '{"instruction": "a", "output": "b"}'),
    (1, '{"instruction": "a", "output": null}'),
    (2, '{"instruction": "a"}'),
    (3, '{"instruction": null, "output": {"x": 1}, "more": [1, {"y": null}]}'),
    (4, "[1, 2]"),
    (5, "not json"),
    (6, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return raw_records.parse_records(spark.createDataFrame(LINES, "id BIGINT, value STRING"))


def test_an_explicit_null_is_a_key(parsed):
    assert tuple(raw_records.validate_keys(parsed, "alpaca").first()) == (7, False, 4)
    errors = raw_records.key_errors(parsed, "alpaca").collect()
    assert {(r.id, r.error) for r in errors} == {(i, f"Sample {i}: Missing required keys") for i in (2, 4, 5, 6)}
    assert tuple(raw_records.validate_keys(parsed.where("id < 2"), "alpaca").first()) == (2, True, 0)
    assert tuple(raw_records.validate_keys(parsed.where("id < 0"), "alpaca").first()) == (0, True, 0)


def test_unknown_fields_survive(parsed):
    found = raw_records.other_fields(parsed, ["instruction", "output"]).select("id", "field", F.to_json("value").alias("v"))
    assert [tuple(r) for r in found.collect()] == [(3, "more", '[1,{"y":null}]')]


def test_leaves_of_any_layout(spark):
    text = '{"a": [0.5, {"b": "x"}], "c": {"d": {"e": {"f": 1}}}, "n": null, "t": true, "z": []}'
    rows = raw_records.parse_records(spark.createDataFrame([("r", text)], "run STRING, value STRING"))
    found = {r.path: (r.number, r.text) for r in raw_records.leaves(rows, levels=3).collect()}
    assert found == {
        "a/0": (0.5, None), "a/1/b": (None, "x"), "c/d/e": (None, '{"f":1}'), "n": (None, None), "t": (None, "true"), "z": (None, "[]"),
    }


def test_merged_sketches_keep_the_rank_error(spark):
    rng = random.Random(2)
    rows = [("m", "w", rng.lognormvariate(0, 1), i % 24) for i in range(60_000)] + [("m", "one", 2.0, 0), ("m", "none", None, 0)]
    requests = spark.createDataFrame(rows, "method STRING, workload STRING, latency_s DOUBLE, hour INT")
    hourly = latency.latency_sketches(requests, [*latency.GROUP, "hour"])
    assert hourly.count() == 26
    merged = latency.sketch_percentiles(latency.merge_sketches(hourly))
    whole = latency.sketch_percentiles(latency.latency_sketches(requests))
    values = np.sort([r[2] * 1000 for r in rows if r[1] == "w"])
    for report in (merged, whole):
        found = {r.workload: r for r in report.collect()}
        assert found["one"].latency_p50_ms == 2000.0 and found["none"].latency_p99_ms is None
        assert found["w"].num_requests == 60_000
        for name, share in latency.PERCENTILES.items():
            rank = np.searchsorted(values, found["w"][name], side="right") / len(values)
            assert abs(rank - share) <= latency.rank_error() + 1 / len(values)


def test_manifest_is_counted_while_writing(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("instruction"), F.when(F.col("id") < 9, "validation").otherwise("train").alias("split"))
    manifest = record_files.write_splits_counted(rows, str(tmp_path / "out"), "alpaca")
    assert (manifest["num_train_samples"], manifest["num_val_samples"]) == (91, 9)
    assert spark.read.json(str(tmp_path / "out")).count() == 100
    empty = record_files.write_splits_counted(rows.where("split = 'x'"), str(tmp_path / "none"), "alpaca")
    assert (empty["num_train_samples"], empty["num_val_samples"]) == (0, 0)
