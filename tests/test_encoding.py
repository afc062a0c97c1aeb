"""Masks, padding, batches and plugged-in tokenizers."""

import os

import pytest
from pyspark.sql import functions as F

from runloom.functions.tokenizers import EOS_ID, arrow_tokenizer, words
from runloom.operators import encoding

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, "a b c\n", "d e"), (2, "a b c d e f g\n", "h"), (3, "a\n", ""), (4, "a\n", "b " * 30)]
    return spark.createDataFrame(rows, "id INT, prompt STRING, output STRING")


def test_words(spark):
    text = " a\tb\n\nc\x0bd\r\ne  f "
    df = spark.createDataFrame([(text,), ("",), ("  ",)], "t STRING")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [list("abcdef"), [], []]


@pytest.mark.parametrize("limit", [1, 3, 4, 7, 100])
def test_masks(pairs, limit):
    for row in encoding.encode_words(pairs, max_length=limit).collect():
        prompt, output = len(row.prompt.split()), len(row.output.split())
        size = min(limit, prompt + output + 1)
        assert len(row.input_ids) == len(row.labels) == len(row.attention_mask) == size
        masked = min(prompt, size)
        assert row.labels == [-100] * masked + row.input_ids[masked:]
        assert row.num_response_tokens == size - masked
        if size > prompt + output:
            assert row.input_ids[-1] == EOS_ID


def test_untrainable_rows_are_dropped(pairs):
    kept = encoding.filter_trainable(encoding.encode_words(pairs, max_length=4))
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_padding_to_a_fixed_length(pairs):
    for row in encoding.encode_padded(pairs, "output", max_length=8, pad_id=-1).collect():
        size = min(8, len(row.output.split()))
        assert len(row.input_ids) == 8 and row.labels == row.input_ids
        assert row.attention_mask == [1] * size + [0] * (8 - size)
        assert row.input_ids[size:] == [-1] * (8 - size)


def test_batches(spark):
    rows = [(i, "p " * (1 + i % 5) + "\n", "r " * (1 + i * 7 % 23)) for i in range(53)]
    df = spark.createDataFrame(rows, "id INT, prompt STRING, output STRING")
    encoded = encoding.encode_words(df)
    sizes = {r.id: len(r.input_ids) for r in encoded.collect()}
    batches = {}
    for row in encoding.pad_batches(encoded, "id", batch_size=8).collect():
        batches.setdefault(row.batch, []).append(row)
    assert sorted(map(len, batches.values())) == [5] + [8] * 6
    for batch in batches.values():
        longest = max(sizes[r.id] for r in batch)
        width = -(-longest // 8) * 8
        for row in batch:
            gap = width - sizes[row.id]
            assert row.width == width == len(row.input_ids) == len(row.labels) == len(row.attention_mask)
            assert row.labels[sizes[row.id]:] == [-100] * gap
            assert row.attention_mask == [1] * sizes[row.id] + [0] * gap


def test_plugged_in_tokenizer(spark):
    def make_letters():
        return lambda texts: [[ord(c) for c in text] for text in texts]

    df = spark.createDataFrame([("ab",), (None,), ("",)], "text STRING")
    rows = encoding.tokenize(df, tokenizer=arrow_tokenizer(make_letters)).collect()
    assert [r.input_ids for r in rows] == [[97, 98], None, []]


def test_plugged_in_tokenizer_gets_bounded_slices(spark):
    def make_counter():
        return lambda texts: [[len(texts), len(text)] for text in texts]

    # Nulls, empty texts and one text above the bound among them, all in one Arrow batch.
    texts = ["x" * 100_000] * 35 + [None, "", "y" * 1_500_000, None] + ["z"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").coalesce(1)
    got = {r.id: r.input_ids for r in encoding.tokenize(df, tokenizer=arrow_tokenizer(make_counter)).collect()}
    assert [None if got[i] is None else got[i][1] for i in range(len(texts))] == [None if t is None else len(t) for t in texts]
    assert all(n is None or n[0] * 100_000 <= 1 << 20 for i, n in got.items() if i < 35) and got[37][0] == 1


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_subword_tokenizer(spark):
    def make_encoder():
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(VOCABULARY)
        return lambda texts: [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]

    tokenizer = arrow_tokenizer(make_encoder)
    rows = [(1, "### Response:\n", "Paris is the capital."), (2, "### Response:\n", "")]
    df = spark.createDataFrame(rows, "id INT, prompt STRING, output STRING")
    encode = make_encoder()
    for row in encoding.encode_masked(df, tokenizer, "!", max_length=8).collect():
        full = encode([row.prompt + row.output + "!"])[0][:8]
        masked = len(encode([row.prompt])[0])
        assert row.input_ids == full
        assert row.labels == ([-100] * masked + full[masked:])[: len(full)]
