"""The near-copy stage of the pipeline against all pairs compared by their shingles, and rows judged one by one."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runloom.llm import simhash


def shingles(text, n=5):
    w = brute.words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(texts, threshold=0.8):
    """For each text the first one that it is connected to."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and len(a & b) / len(a | b) >= threshold:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(texts))]


def kept_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())


def edited(words, changes, rng):
    out = list(words)
    for at in rng.sample(range(len(words)), changes):
        out[at] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_stage_equals_all_pairs(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    for _ in range(25):  # groups about the threshold, some of them chains whose ends are not similar
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 200]))]
        for _ in range(5):
            texts.append(" ".join(edited(base, rng.choice([0, 1, 2, 4, 6]), rng)))
            base = edited(base, rng.choice([0, 2, 4]), rng)
    texts += [None, "", " \n", "two words", "Two  words", "two word"]
    rows = list(enumerate(texts))
    roots = groups(texts)
    bits = [brute.simhash(t) for t in texts]
    others = lambda i: [j for j, a in enumerate(roots) if a == roots[i] and shingles(texts[j]) != shingles(texts[i])]
    far = [i for i in range(len(texts)) if others(i) and min(bin(bits[i] ^ bits[j]).count("1") for j in others(i)) > 4]
    assert far  # pairs that fingerprints within 4 bits do not join
    expected = [i for i, a in enumerate(roots) if a == i]
    assert [i for i, _ in kept_ids(spark, rows)] == expected


def test_rows_are_judged_one_by_one(spark):
    rng = random.Random(5)
    text = [f"w{rng.randrange(4000)}" for _ in range(150)]
    copy, other = " ".join(edited(text, 1, rng)), " ".join(edited(text, 150, rng))
    text = " ".join(text)
    assert [i for i, _ in kept_ids(spark, [(7, text), (7, copy)])] == [7]  # near copies under one id
    assert [t for _, t in kept_ids(spark, [(None, text), (None, copy), (None, other)])].count(other) == 1
    assert len(kept_ids(spark, [(None, text), (None, copy), (None, other)])) == 2  # near copies without ids
    assert kept_ids(spark, [(1, text), (2, copy), (2, other), (None, text)]) == [(1, text), (2, other)]
    assert kept_ids(spark, [(3, text), (3, text)]) == [(3, text)]


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a  B", "y")], "doc_id LONG, text STRING, mark STRING")
    assert [tuple(r) for r in simhash.first_copies(df).collect()] == [(1, "a b", "x")]
    assert simhash.first_copies(df.where(F.lit(False))).count() == 0


def test_contaminated_rows_go_alone(spark, tmp_path):
    rng = random.Random(9)
    item, clean = (" ".join(f"w{rng.randrange(4000)}" for _ in range(40)) for _ in range(2))
    spark.createDataFrame([(1, item)], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, clean), (None, None), (1, item), (1, clean), (2, clean)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {tuple(r) for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()}
    assert got == {(None, clean), (None, None), (1, clean), (2, clean)}
