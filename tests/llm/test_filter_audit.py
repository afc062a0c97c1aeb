"""The filter audit against removal in every order, document by document."""

import itertools

import numpy as np
import pytest

from runloom.llm import filter_audit

DOCS = "doc_id BIGINT, lang STRING, text STRING, part INT, mask STRING"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


def plain(docs, labels):
    """docs: (id, lang, text) -> one row per part, order and step."""
    texts = {}
    for i, _, t in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    flagged = []
    for i, lang, text in docs:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        least = texts.get(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": least is not None and (i is None or i > least),
        }
        good = any(j == i and q == 1 for j, q, _ in labels if j is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if j is not None)
        flagged.append((lang or "", fails, good, toxic))
    rows = {}
    shapley = {}
    for part in {f[0] for f in flagged}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in flagged if f[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [f for f in left if f[1][letter]]
                left = [f for f in left if not f[1][letter]]
                rows[part, "".join(order), step] = [
                    len(left), len(removed), sum(f[1][letter] for f in gone),
                    sum(f[0] == part and [k for k, v in f[1].items() if v] == [letter] for f in flagged),
                    sum(f[2] for f in removed), sum(f[3] for f in removed),
                ]
                gone += removed
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in rows.items()}


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(3)
    flagged = filter_audit.measured(frame)
    flagged = filter_audit.with_labels(flagged, spark.createDataFrame(labels, LABELS), "doc_id", {"good": "quality", "toxic": "toxic"})
    rows = filter_audit.audit(flagged, "ABCDE", weights=["good", "toxic"]).collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows})
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def test_every_order_equals_removal_by_hand(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, "en", long), (2, "en", long), (2, "en", long), (3, "de", long), (0, "de", "Short TEXT"), (4, None, None), (5, "", ""),
        (None, "en", long), (None, "en", "only here"), (None, "fr", "only here"), (6, "fr", "a " * 5000), (7, "fr", long + " #"),
        (8, "fr", "É" * 50 + "ABCDEF"), (9, "fr", "É" * 54 + "ABCDEF"), (10, "en", "A" * 300_000), (11, "en", " ".join(f"W{i}" for i in range(100))),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (0, None, 1), (None, 1, 1), (4, 1, 1), (99, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "en", "x")], []) == plain([(1, "en", "x")], [])


@pytest.mark.parametrize("filters", range(1, 6))
def test_min_plus_product_gives_the_first_failing_step(filters):
    orders, steps = filter_audit.removal_steps(filters)
    assert steps.shape == (2**filters, len(orders))
    for mask in range(2**filters):
        for order, step in zip(orders, steps[mask]):
            hits = [i for i, f in enumerate(order, 1) if mask >> f & 1]
            assert step == hits[0] if hits else step > filters


def test_other_filters_and_no_weights(spark):
    rows = [("a", True, None), ("a", False, True), (None, True, True)]
    flagged = spark.createDataFrame(rows, "host STRING, x BOOLEAN, y BOOLEAN")
    found = filter_audit.audit(flagged, ["x", "y"], part_col="host").collect()
    assert {tuple(r) for r in found} == {
        ("a", "xy", 1, 1, 1, 0, 1, 2), ("a", "xy", 2, 0, 1, 0, 1, 2), ("a", "yx", 1, 1, 1, 0, 1, 2), ("a", "yx", 2, 0, 1, 0, 1, 2),
        ("", "xy", 1, 0, 1, 0, 0, 1), ("", "xy", 2, 0, 0, 1, 0, 1), ("", "yx", 1, 0, 1, 0, 0, 1), ("", "yx", 2, 0, 0, 1, 0, 1),
    }
    assert np.array_equal(filter_audit.removal_steps(2)[0], [[0, 1], [1, 0]])
