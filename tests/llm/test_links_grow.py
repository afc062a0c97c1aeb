"""Links of a group of near-copies that no single member connects: they grow with the group, not with its square."""

import itertools
import random

import numpy as np

from runloom.llm import jaccard_join
from runloom.llm.components import components


def near_group(n, seed=3):
    """Texts with three of eight places changed: a fourth of their pairs share two places, which 80 percent asks for."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    places = list(itertools.combinations(range(10, 180, 22), 3))
    for i in range(n):
        words = list(base)
        for at in rng.choice(places):
            words[at] = f"new{i}x{at}"
        yield i, " ".join(words)


def test_links_grow_with_the_group(spark):
    n = 1000
    df = spark.createDataFrame(list(near_group(n)), "doc_id LONG, text STRING")
    texts = jaccard_join.marked(df, "doc_id", "text")
    points = jaccard_join.points_of(jaccard_join.described(texts, 5, 80))
    found = jaccard_join.links_between(points, texts, 5, 80)
    assert {r.label for r in components(found, "a", "b").collect()} == {points.agg({"id": "min"}).first()[0]}
    assert components(found, "a", "b").count() == n
    assert found.count() < 40 * n  # before: 79,706


def test_few_of_each():
    rng = np.random.default_rng(2)
    a, b = np.triu_indices(60, 1)
    order = rng.permutation(len(a)).astype(np.uint64)
    kept = set(jaccard_join._few_of_each(a, b, order, 5).tolist())
    firsts = [np.flatnonzero((a == x) | (b == x)) for x in range(60)]
    assert kept == {int(p) for places in firsts for p in sorted(places, key=lambda p: order[p])[:5]}
    assert len(jaccard_join._few_of_each(a, b, order, 60)) == len(a)
    # What some of the pairs leave out, all of them leave out too.
    part = np.sort(np.concatenate([jaccard_join._few_of_each(a[:900], b[:900], order[:900], 5), np.arange(900, len(a))]))
    assert {int(part[p]) for p in jaccard_join._few_of_each(a[part], b[part], order[part], 5)} == kept
