"""Token ids, label masks, padding and counts.

A tokenizer here is a function from a text column and a length limit to ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.tokenizers import (
    EOS_ID,
    PAD_ID,
    Tokenizer,
    default_tokenizer,
    word_ids,
    words,
)
from runloom.operators.sampling import SEED, shuffle_positions
from runloom.session import written

#: Fixed value: the label that a loss function leaves out.
IGNORED = -100


def tokenize(
    df: DataFrame,
    text: str = "text",
    max_length: int | None = None,
    tokenizer: Tokenizer = default_tokenizer,
    name: str = "input_ids",
) -> DataFrame:
    """Ids of a text, cut at ``max_length``."""
    return df.withColumn(name, tokenizer(F.col(text), max_length))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row ``inline``.

    A filter on a plain column is pushed below it by copying its expression; one on
    the output of a generator is not, so costly expressions run once per row.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def encode_words(
    df: DataFrame,
    prompt: str = "prompt",
    response: str = "output",
    max_length: int = 512,
    portable: bool = False,
) -> DataFrame:
    """``encode_masked`` for the default tokenizer.

    Every prompt ends in a line break, so the words of the full text are those of
    the prompt, those of the response and the end marker: each text is cut once.
    The counts come from the word lists, so a query that needs no ids hashes none.
    """
    cut = compute_once(df, _prompt=words(F.col(prompt)), _response=words(F.col(response)))
    total = F.size("_prompt") + F.size("_response") + 1
    kept = F.slice(F.concat("_prompt", "_response"), 1, max_length)
    ids = F.slice(F.concat(word_ids(kept, portable), F.array(F.lit(EOS_ID))), 1, max_length)
    counted = cut.withColumn("num_tokens", F.least(F.lit(max_length), total))
    return _mask(counted.withColumn("input_ids", ids), F.size("_prompt")).drop("_prompt", "_response")


def encode_masked(
    df: DataFrame,
    tokenizer: Tokenizer,
    eos: str,
    prompt: str = "prompt",
    response: str = "output",
    max_length: int = 512,
) -> DataFrame:
    """``input_ids`` of the full text and ``labels`` with the prompt masked out.

    Prompt and full text are tokenized apart, so the mask is as long as the
    prompt alone, whatever the tokenizer merges at the border. ``num_tokens`` and
    ``num_response_tokens`` count the ids and the unmasked ones.
    """
    encoded = compute_once(
        df,
        input_ids=tokenizer(F.concat(prompt, response, F.lit(eos)), max_length),
        _prompt=tokenizer(F.col(prompt), max_length),
    ).withColumn("num_tokens", F.size("input_ids"))
    return _mask(encoded, F.size("_prompt")).drop("_prompt")


def _mask(df: DataFrame, prompt_size: Column) -> DataFrame:
    masked = F.least(prompt_size, F.col("num_tokens"))
    labels = F.transform("input_ids", lambda token, i: F.when(i < masked, IGNORED).otherwise(token))
    return df.withColumns(
        {
            "labels": labels,
            "attention_mask": F.array_repeat(F.lit(1), F.col("num_tokens")),
            "num_response_tokens": F.col("num_tokens") - masked,
        }
    )


def filter_trainable(df: DataFrame) -> DataFrame:
    """Keep rows with at least one unmasked label."""
    return df.filter(F.col("num_response_tokens") > 0)


def encode_padded(
    df: DataFrame,
    text: str = "text",
    max_length: int = 512,
    tokenizer: Tokenizer = default_tokenizer,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Ids cut or filled to ``max_length``; labels are a copy, padding included."""
    cut = df.withColumn("_ids", tokenizer(F.col(text), max_length))
    gap = F.lit(max_length) - F.size("_ids")
    return (
        cut.withColumn("input_ids", F.concat("_ids", F.array_repeat(F.lit(pad_id), gap)))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), gap)),
        )
        .withColumn("labels", F.col("input_ids"))
        .drop("_ids")
    )


def pad_batches(
    df: DataFrame,
    id_col: str,
    batch_size: int,
    multiple: int = 8,
    pad_id: int = PAD_ID,
    seed: int = SEED,
) -> DataFrame:
    """Put rows into seeded batches and fill each batch to its longest row.

    The width is rounded up to a multiple. Positions and widths are found on ids
    and lengths alone, which are written once; the arrays are shuffled once, by the last join.
    """
    lengths = written(df.select(id_col, F.col("num_tokens").alias("_size")), "lengths")
    batch = Window.partitionBy("batch")
    widths = (
        shuffle_positions(lengths, id_col, seed)
        .withColumn("batch", F.floor((F.col("position") - 1) / batch_size))
        .withColumn("width", (F.ceil(F.max("_size").over(batch) / multiple) * multiple).cast("int"))
        .select(id_col, "batch", "width")
    )

    def filled(name: str, value: int) -> Column:
        gap = F.col("width") - F.size(name)
        return F.concat(name, F.array_repeat(F.lit(value), gap))

    return df.join(widths, id_col).withColumns(
        {
            "input_ids": filled("input_ids", pad_id),
            "attention_mask": filled("attention_mask", 0),
            "labels": filled("labels", IGNORED),
        }
    )


def split_counts(df: DataFrame) -> DataFrame:
    """Rows, tokens and unmasked tokens per split."""
    return df.groupBy("split").agg(
        F.count("*").alias("num_examples"),
        F.sum("num_tokens").alias("num_tokens"),
        F.sum("num_response_tokens").alias("num_response_tokens"),
    )
