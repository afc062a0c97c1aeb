"""Contexts that are rare but tell the next byte are states of the tree, whatever else there is to read."""

import pytest
from pyspark.sql import functions as F

from runloom.llm import suffix_tree


def test_rare_contexts_are_states(spark):
    # The pattern stands 14 times in 3.4 MB: below a share of 5e-6, though a z tells what follows it.
    rows = [(0, "azvq"), (1, "aqvz"), *((i, "zvq") for i in range(2, 16)), *((i, "the cat sat on the mat " * 1000) for i in range(16, 166))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    scored = suffix_tree.score_texts(docs, F.col("doc_id") > 1).where("doc_id < 2")
    right, wrong = (r.spelled_score for r in scored.orderBy("doc_id").collect())
    assert right > wrong + 5  # before: as likely as each other


@pytest.mark.parametrize("total, gain", [(0, 20.0), (25, 20.0), (500, 20.0), (10**6, 20.0), (10**9, 20.0), (10**6, 0.5), (10**6, 0.0)])
def test_least_count_leaves_out_no_gain(total, gain):
    least = suffix_tree._least_count(total, gain)
    # Contexts that occur n times among total bytes, whose one next byte no other context has.
    assert all(n * suffix_tree.math.log(total / n) < gain for n in range(1, least))
