"""Leaves placed without their records, against the leaves of whole records."""

from pyspark.sql import functions as F

from runloom.llm import fixity

SCHEMA = "p LONG, u STRING, h STRING, size STRING, file STRING"


def pages(spark):
    rows = [(n, f"http://h/{n}", "é" * (n % 50), "x", "y") for n in range(500)]
    rows += [(None, f"u{n}", None, "x", "y") for n in range(300)] + [(7, None, "z" * 200_000, "x", "y"), (7, "http://h/7", "é" * 7, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_leaves_equal_those_of_whole_records(spark):
    given = pages(spark)
    placed = fixity.placed_leaves(given, "p", "u", "h", per_file=100, changes={"cut": lambda r: r.substr(1, 10)})
    whole = fixity.layout(given, "p", "u", "h", per_file=100)
    records = {(r.file, r.hash): r.size for r in fixity.leaves(whole).collect()}
    assert {(r.file, r.hash): r.size for r in placed.collect()} == records
    # Records follow each other without a gap, from offset 0 on.
    ends = {}
    for r in sorted(placed.collect(), key=lambda r: (r.file, r.offset)):
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.size
    assert placed.where(F.length("cut") != 64).count() == 0


def test_pages_without_id_are_spread(spark):
    placed = fixity.placed_leaves(pages(spark), "p", "u", "h")
    assert placed.where("page IS NULL").select("file").distinct().count() > 100
    assert fixity.placed_leaves(pages(spark).limit(0), "p", "u", "h").collect() == []


def test_records_are_not_shuffled(spark):
    plan = fixity.placed_leaves(pages(spark), "p", "u", "h")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(file") < plan.index("sha2")


def test_two_empty_sides(spark):
    none = fixity.placed_leaves(pages(spark).limit(0), "p", "u", "h").select("file", "offset", "size", "hash")
    assert fixity.audit(none, none).collect() == []
