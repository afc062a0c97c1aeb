"""Exact sampling, shuffling, splitting."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from runloom.operators import sampling


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(3000).repartition(7)


@pytest.mark.parametrize("wanted", [1, 17, 2999, 3000, 5000])
def test_sample_is_exact(ids, wanted):
    got = {r.id for r in sampling.sample_exact(ids, "id", wanted).collect()}
    assert got == set(order(range(3000))[:wanted])


def test_sample_of_all(ids):
    assert sampling.sample_exact(ids, "id", None).count() == 3000


def test_sample_of_nothing(spark):
    assert sampling.sample_exact(spark.range(0), "id", 5).count() == 0


@pytest.mark.parametrize("fraction", [0.0, 0.0001, 0.1, 0.333, 1.0])
def test_splits(ids, fraction):
    for split, held_out in (
        (sampling.split_exact_floor, math.floor(3000 * fraction)),
        (sampling.split_library, math.ceil(3000 * fraction)),
    ):
        rows = split(ids, "id", fraction).collect()
        assert len(rows) == 3000
        assert {r.id for r in rows if r.split == "validation"} == set(order(range(3000))[:held_out])


def test_shuffle(ids):
    expected = order(range(3000), 7)
    assert [r.id for r in sampling.seeded_shuffle(ids, "id", 7).collect()] == expected
    places = {r.id: r.position for r in sampling.shuffle_positions(ids, "id", 7).collect()}
    assert places == {i: place for place, i in enumerate(expected, 1)}


def test_text_ids(spark):
    names = [f"doc-{i}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = {r.name for r in sampling.sample_exact(df, "name", 9).collect()}
    assert got == set(order(names)[:9])


@pytest.mark.parametrize("rows", [10, 3000, 9999])
def test_head(ids, rows):
    expected = set(range(min(rows, 3000)))
    assert {r.id for r in sampling.head_sample(ids, "id", rows).collect()} == expected
    assert sampling.head_sample(ids.withColumn("tied", F.lit(1)), "tied", rows).count() == len(expected)


def test_row_index_is_dense(spark):
    df = spark.range(0, 1000, 1, 6).withColumnRenamed("id", "x").filter(F.col("x") % 3 != 0)
    got = sorted((r.id, r.x) for r in sampling.add_row_index(df).collect())
    assert [i for i, _ in got] == list(range(len(got)))
    assert [x for _, x in got] == sorted(x for x in range(1000) if x % 3)


def test_split_does_not_shuffle_the_rows(ids):
    """Only keys are shuffled, inside the scalar; the rows are tagged where they lie."""
    wide = ids.withColumn("payload", F.lit("x"))
    plan = sampling.split_exact_floor(wide, "id")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("scalar-subquery")[0]
    assert "Join" not in top and "Window" not in top and "Sort" not in top
