"""Whole jobs made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from runloom.operators import chats, encoding, records, sampling
from runloom.operators.encoding import Tokenizer
from runloom.sources.records import read_records, write_splits_counted

#: Columns of the manifest.
MANIFEST = "format STRING, num_train_samples BIGINT, num_val_samples BIGINT, train_file STRING, validation_file STRING"


def prepare_training_data(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    data_format: str = "alpaca",
    validation_split: float = 0.1,
    max_samples: int | None = None,
    seed: int = sampling.SEED,
    schema: str | T.StructType | None = None,
    file_format: str | None = None,
) -> dict[str, object]:
    """Read, sample, split and write a record set; return its manifest.

    Records are numbered when read, so sample and split are exact and repeatable. ``schema`` names
    the fields of a format that ``register_format`` added, or further fields to keep.
    """
    rows = read_records(spark, input_path, data_format, schema, spread=False, file_format=file_format)
    rows = sampling.add_row_index(records.format_hook(rows, data_format), "_id")
    rows = sampling.sample_exact(rows, "_id", max_samples, seed)
    split = sampling.split_exact_floor(rows, "_id", validation_split, seed).drop("_id")
    data = f"{output_dir.rstrip('/')}/data"
    manifest = write_splits_counted(split, data, data_format)
    info = spark.createDataFrame([tuple(manifest.values())], MANIFEST)
    info.repartition(1).write.mode("overwrite").json(f"{output_dir.rstrip('/')}/dataset_info")
    return manifest | {
        "train_file": f"{data}/{manifest['train_file']}",
        "validation_file": f"{data}/{manifest['validation_file']}",
    }


def validate_data_format(
    spark: SparkSession, path: str, data_format: str = "alpaca"
) -> tuple[DataFrame, DataFrame]:
    """The one-row report of a record set and its error rows."""
    rows = sampling.add_row_index(read_records(spark, path, data_format, spread=False))
    return records.validate_format(rows, data_format), records.format_errors(rows, data_format)


def encode_instructions(
    df: DataFrame,
    id_col: str = "id",
    max_length: int = 512,
    fraction: float = 0.05,
    max_samples: int | None = None,
    seed: int = sampling.SEED,
) -> DataFrame:
    """Instruction records to split, masked examples."""
    head = df if max_samples is None else sampling.head_sample(df, id_col, max_samples)
    split = sampling.split_library(head, id_col, fraction, seed)
    return encoding.encode_words(records.render_prompt(split), max_length=max_length)


def encode_pairs(
    pairs: DataFrame,
    id_col: str,
    max_length: int = 1024,
    fraction: float = 0.05,
    max_samples: int | None = None,
    seed: int = sampling.SEED,
    tokenizer: Tokenizer | None = None,
    eos: str = "</s>",
) -> DataFrame:
    """First turns of chats (``instruction, response``) to split, masked, trainable examples.

    Incomplete chats are counted in the split, then dropped before any text is
    rendered or tokenized.
    """
    pool = sampling.sample_exact(pairs, id_col, max_samples, seed)
    split = sampling.split_library(pool, id_col, fraction, seed)
    prompts = records.render_prompt(chats.filter_complete_pairs(split), extra=None)
    if tokenizer is None:
        encoded = encoding.encode_words(prompts, response="response", max_length=max_length)
    else:
        encoded = encoding.encode_masked(
            prompts, tokenizer, eos, response="response", max_length=max_length
        )
    return encoding.filter_trainable(encoded)
