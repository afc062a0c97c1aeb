"""Vocabularies by frequency, and texts encoded by them."""

import random
from collections import Counter

import pytest

from runloom.operators import vocabulary

DOCS = "id BIGINT, text STRING"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["Été", "a b", "x"]
    rows = [(i, " ".join(rng.choices(words, weights=[2 ** (-j / 4) for j in range(len(words))], k=rng.randrange(60)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, " \n\t "), (63, "hot " * 500), (64, "only once")]


def counted(texts, min_count=1, size=None):
    counts = Counter(w for _, t in texts for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w)
    ranked = sorted(((w, n) for w, n in counts.items() if n >= min_count), key=lambda p: (-p[1], p[0].encode()))
    return {w: (n, i) for i, (w, n) in enumerate(ranked[:size], 1)}


@pytest.mark.parametrize("min_count, size", [(1, None), (2, None), (1, 7), (3, 10), (1, 1000)])
def test_ids_follow_counts_then_bytes(spark, texts, min_count, size):
    known = vocabulary.build_vocabulary(spark.createDataFrame(texts, DOCS).repartition(4), size=size, min_count=min_count)
    assert {r.word: (r["count"], r.id) for r in known.collect()} == counted(texts, min_count, size)


@pytest.mark.parametrize("size", range(1, 9))
def test_ties_at_the_cut(spark, size):
    rows = [(0, "b b c c a a d d e")]
    known = vocabulary.build_vocabulary(spark.createDataFrame(rows, DOCS), size=size)
    assert {r.word: (r["count"], r.id) for r in known.collect()} == counted(rows, 1, size)


@pytest.mark.parametrize("hot_words", [0, 3, 1000])
@pytest.mark.parametrize("min_count", [1, 2])
def test_encoding(spark, texts, hot_words, min_count):
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    known = vocabulary.build_vocabulary(docs, min_count=min_count)
    ids = counted(texts, min_count)
    got = {r.id: r.input_ids for r in vocabulary.encode(docs, known, "id", hot_words=hot_words).collect()}
    for i, text in texts:
        words = None if text is None else [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        assert got[i] == (None if words is None else [ids.get(w, (0, 0))[1] for w in words])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    known = vocabulary.build_vocabulary(none, size=5)
    assert known.collect() == [] and vocabulary.encode(none, known, "id").collect() == []
    unknown = vocabulary.encode(spark.createDataFrame([(1, "a b")], DOCS), known, "id").collect()
    assert [r.input_ids for r in unknown] == [[0, 0]]


def test_frequent_words_are_no_shuffle_key(spark, texts):
    docs = spark.createDataFrame(texts, DOCS)
    known = vocabulary.build_vocabulary(docs)
    for hot_words, joins in ((1000, ["LeftOuter"]), (3, ["Inner", "LeftAnti"])):
        plan = vocabulary.encode(docs, known, "id", hot_words=hot_words)._jdf.queryExecution().executedPlan().toString()
        assert all(any("BroadcastHashJoin" in line and kind in line for line in plan.splitlines()) for kind in joins)


def test_words_are_looked_up_once_a_part(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, "same words in all of the texts " * 50) for i in range(300)], DOCS).coalesce(1)
    known = vocabulary.build_vocabulary(docs)
    seen = []
    monkeypatch.setattr(vocabulary, "written", lambda df, name: seen.append((name, df.cache())) or seen[-1][1])
    assert vocabulary.encode(docs, known, "id").where("size(input_ids) = 350").count() == 300
    parts = dict(seen)["parts"]
    assert parts.selectExpr("sum(size(_words))").first()[0] == 7 * parts.count() < 300
    # Parts as small as a text, and one text of many parts, give the same ids.
    expected = sorted(vocabulary.encode(spark.createDataFrame(texts, DOCS), known, "id").collect())
    monkeypatch.setattr(vocabulary, "PART_BYTES", 1)
    assert sorted(vocabulary.encode(spark.createDataFrame(texts, DOCS), known, "id").collect()) == expected


def test_texts_of_one_id_are_put_together_by_place(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a"), (None, None), (2, "b")], DOCS)
    known = spark.createDataFrame([("a", 3, 1), ("b", 2, 2), ("c", 1, 3)], "word string, count long, id int")
    for hot_words in (100, 1):
        got = {r.id: r.input_ids for r in vocabulary.encode(docs, known, "id", hot_words=hot_words).collect()}
        assert got == {1: [1, 3, 2], None: None, 2: [2]}
