"""Tables that grow with the input are not broadcast, however small Spark takes them to be."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from runloom.llm import contamination, jaccard_join, simhash


@pytest.fixture()
def joins(monkeypatch):
    """The names of written tables with the joins by broadcast that each one's plan has."""
    found, parquet = {}, DataFrameWriter.parquet

    def note(writer, path, *args, **kwargs):
        found.setdefault(path.rsplit("/", 1)[-1].split("-")[0], []).append(broadcasts(writer._df))
        return parquet(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", note)
    return found


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_near_duplicates_are_not_broadcast(spark, joins):
    docs = spark.createDataFrame([(i, f"the cat sat on the mat and saw {i // 2}") for i in range(20)], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert {"buckets", "stars", "labels", "edges"} <= set(joins)
    assert broadcasts(out) == 0 and not any(map(sum, joins.values()))
    assert all(r.component_id <= r.doc_id - r.doc_id % 2 for r in out.collect())


def test_first_copies_are_not_broadcast(spark, joins, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    words = [f"w{i}" for i in range(60)]
    # Of three texts two differ at the end and one in the middle, which fingerprints need not connect.
    texts = [" ".join([f"g{i // 3}", *words[:30], *([f"n{i}"] if i % 3 == 1 else words[30:31]), *words[31:], f"e{i}"]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = simhash.first_copies(docs)
    assert {"near", "buckets", "labels", "members", "alive", "pairs", "asked", "sets", "links", "first"} <= set(joins)
    assert broadcasts(out) == 0 and not any(map(sum, joins.values()))
    assert [r.doc_id for r in out.collect()] == [0]


def test_many_rows_of_a_benchmark_are_not_broadcast(spark, monkeypatch):
    probes = spark.range(3).select(F.explode(F.sequence(F.lit(0), "id")).alias("id"))
    assert broadcasts(spark.range(5).join(contamination._maybe_broadcast(probes), "id")) == 1
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 2)
    assert broadcasts(spark.range(5).join(contamination._maybe_broadcast(probes), "id")) == 0
