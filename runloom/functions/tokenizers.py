"""Tokenizers: text column to ``ARRAY<INT>``.

The default cuts at white space and hashes each word, wholly inside the JVM.
Any Python tokenizer can be plugged in through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id of the end-of-sequence marker; word ids start above it.
EOS_ID = 0
#: Id used to fill up short sequences.
PAD_ID = 0
VOCABULARY = 2**28 - 1

#: Characters that a plugged-in tokenizer is given at once, unless one text has more.
SLICE_CHARS = 1 << 20

Encoder = Callable[[list[str]], list[list[int]]]
#: From a text column and an optional length limit to an ``ARRAY<INT>`` column.
Tokenizer = Callable[..., Column]


def words(text: Column) -> Column:
    """Runs of characters without white space.

    Plain replacing and splitting takes half the time of a regular expression.
    """
    spaced = text
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.filter(F.split(spaced, " "), lambda word: word != "")


def word_ids(tokens: Column, portable: bool = False) -> Column:
    """A positive id per word: fast by default, or from MD5 where other engines must agree."""
    if portable:
        return F.transform(
            tokens, lambda t: (F.conv(F.md5(t.cast("binary")).substr(1, 7), 16, 10)).cast("int") + 1
        )
    return F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(VOCABULARY)) + 1).cast("int"))


def default_tokenizer(text: Column, limit: int | None = None) -> Column:
    """Hashed words; ``limit`` cuts before the hashing."""
    return word_ids(_cut(words(text), limit))


def portable_tokenizer(text: Column, limit: int | None = None) -> Column:
    """As the default, with ids that other engines can compute too."""
    return word_ids(_cut(words(text), limit), portable=True)


def _cut(tokens: Column, limit: int | None) -> Column:
    return tokens if limit is None else F.slice(tokens, 1, limit)


def _slices(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in order, as many at once as ``SLICE_CHARS`` allows, and one at least."""
    ends = np.cumsum([len(text) if text else 0 for text in texts])
    begin, before = 0, 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield texts.iloc[begin:stop]
        begin, before = stop, ends[stop - 1]


def arrow_tokenizer(make_encoder: Callable[[], Encoder]) -> Tokenizer:
    """Turn a Python tokenizer into a column function.

    ``make_encoder`` runs once per task and returns a function from a list of
    texts to a list of id lists. A batch is encoded and handed back in slices of
    ``SLICE_CHARS``, so the ids that a task holds do not grow with the batch.
    """

    def tokenizer(text: Column, limit: int | None = None) -> Column:
        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = make_encoder()
            for texts in (part for batch in batches for part in _slices(batch)):
                encoded = iter(encoder(texts.dropna().tolist()))
                yield pd.Series([next(encoded)[:limit] if known else None for known in texts.notna()], dtype=object)

        return encode(text)

    return tokenizer
