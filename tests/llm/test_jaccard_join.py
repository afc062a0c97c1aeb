"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from runloom.llm import jaccard_join
from runloom.llm.jaccard_join import similar_groups

SCHEMA = "doc_id BIGINT, text STRING, id STRING, prefix INT, token INT"


def sets_of(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def expected(rows, size=4, percent=85):
    """All pairs compared; the least id of each row's component, nulls last."""
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def joined(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in similar_groups(df, **options).collect()), key=repr)


def near_copies(n, words, changes, seed):
    """Copies of one text with some words changed, and a few strangers that share passages."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(words)] = f"new{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    return rows + [(n + i, " ".join(base[:40] + [f"other{i}-{j}" for j in range(60)])) for i in range(10)]


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("rounds", [1, 2])
def test_a_group_of_near_copies(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    rows = near_copies(60, 120, 9, seed=2)
    assert joined(spark, rows) == expected(rows)


def test_edge_cases(spark):
    word = [f"a{i}" for i in range(30)]
    text = " ".join(word)
    rows = [
        (5, text), (3, text.upper().replace(" ", "\t\n")), (None, text), (7, None), (8, ""), (8, " \t"), (None, None),
        (9, "one two"), (10, "one  two"), (11, "one two three"), (12, "ONE TWO three four"), (13, "one two three four"),
        (14, " ".join(word[:29] + ["b"])), (14, " ".join(word[:29] + ["b"])), (15, "é É"), (16, "É é"), (17, "a" * 200_000),
        (None, "lonely words here now"), (18, " ".join(f"x{i % 7}" for i in range(20_000))),
    ]
    assert joined(spark, rows) == expected(rows)


@pytest.mark.parametrize("size, percent", [(5, 80), (2, 50), (1, 100)])
def test_other_sizes(spark, size, percent):
    rng = random.Random(size)
    rows = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(14)))) for i in range(80)]
    assert joined(spark, rows, size=size, percent=percent) == expected(rows, size, percent)


def test_empty_table(spark):
    assert joined(spark, []) == []


def test_prefixes_and_filters_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(10_000, n, replace=False)
        b = np.concatenate([a[rng.random(n) < 0.93], rng.choice(np.arange(10_000, 20_000), int(rng.integers(0, 5)))])
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= 85 * (n + len(b) - shared):
            order = rng.permutation(20_000)
            firsts = [sorted(x, key=lambda v: order[v])[: jaccard_join.prefix_length(len(x), 85)] for x in (a, b)]
            assert set(firsts[0]) & set(firsts[1])
            assert shared >= jaccard_join.least_shared(n + len(b), 85)
