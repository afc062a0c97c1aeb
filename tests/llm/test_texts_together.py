"""N-grams of many texts at once: the same as of each alone, without a step of Python per word."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import jaccard_join

ODD = [b"", b" ", b"a", b"A b", b"a\x0bb\x1cc d e", b"a b c d e", b"\0 \0\0 \0\0\0 a", b"x" * 63 + b" " + b"x" * 64 + b" " + b"x" * 65, b""]


def _calls(work):
    """How many functions Python calls, its own and others."""
    seen = [0]
    sys.setprofile(lambda frame, event, arg: seen.__setitem__(0, seen[0] + event.endswith("call")))
    try:
        work()
    finally:
        sys.setprofile(None)
    return seen[0]


def _many(count, words, seed=5):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(10**9)}" for _ in range(words)).encode() for _ in range(count)]


@pytest.mark.parametrize("size", [1, 3, 4])
def test_ngrams_are_those_of_the_words(size):
    r = random.Random(size)
    texts = ODD + [b" ".join(r.choices([b"a", b"B", b"b", b"longer-than-eight", b"longer-than-eighT!"], k=r.randrange(30))) for _ in range(200)]
    keys, counts = jaccard_join.ngrams(texts, size)
    words = [t.lower().split() for t in texts]
    want = [tuple(w[i : i + size]) for w in words if w for i in range(max(1, len(w) - size + 1))]
    assert counts.tolist() == [max(1, len(w) - size + 1) if w else 0 for w in words]
    assert len(set(zip(want, keys.tolist()))) == len(set(want)) == len(set(keys.tolist()))
    assert keys.tolist() == [k for t in texts for k in jaccard_join.ngrams([t], size)[0].tolist()]
    distinct, n = jaccard_join._distinct(keys.copy(), counts)
    ends = np.cumsum(counts)
    assert [sorted(set(keys[e - c : e].tolist())) for e, c in zip(ends, counts)] == [x.tolist() for x in np.split(distinct, np.cumsum(n)[:-1])]


def test_words_that_differ_in_one_byte_or_in_length():
    words = {b"x" * n + c + b"x" * m for n in range(70) for m in (0, 1, 7, 8, 9) for c in (b"", b"y", b"z", b"\0", b"\x0f")} - {b""}
    keys, _ = jaccard_join.ngrams([b" ".join(words)], 1)
    assert len(set(keys.tolist())) == len(words)


def test_ngrams_without_calls_per_word():
    texts = _many(200, 200)
    assert _calls(lambda: jaccard_join.ngrams(texts, 4)) < 0.05 * 200 * 200


def test_described_without_calls_per_word(spark):
    texts = _many(300, 150)
    column = pa.array([t.decode() for t in texts])
    groups = list(jaccard_join._groups(column))
    assert [t for g in groups for t in g] == texts
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)] + [(900, None), (901, "a b")], "doc long, text string")
    rows = jaccard_join.described(jaccard_join.marked(frame, "doc", "text"), 4, 85).orderBy("doc").collect()
    assert [r.n for r in rows] == [147] * 300 + [0, 1]
    assert [len(r.prefix) for r in rows] == [jaccard_join.prefix_length(147, 85)] * 300 + [0, 1]
    assert [sum(r.cells) for r in rows] == [r.n for r in rows]
