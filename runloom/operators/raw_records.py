"""Records and result files as VARIANT: what a JSON text says, before a schema drops or fills anything.

Under a schema an absent key and an explicit null look alike, and unknown fields are gone. Here both stay apart, and
files of any layout can be taken to pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.records import REQUIRED


def parse_records(lines: DataFrame, text: str = "value", name: str = "record") -> DataFrame:
    """Add the JSON text of a column as a variant; null if it is not JSON."""
    return lines.withColumn(name, F.try_parse_json(text))


def has_key(record: Column, key: str) -> Column:
    """Whether an object has the key, also with an explicit null; false for anything else than an object."""
    return F.coalesce(F.try_variant_get(record, f"$['{key}']", "variant").isNotNull(), F.lit(False))


def _lacks(record: str, data_format: str) -> Column:
    required, _ = REQUIRED.get(data_format, ([], ""))
    lacking = F.lit(False)
    for key in required:
        lacking = lacking | ~has_key(F.col(record), key)
    return lacking


def validate_keys(records: DataFrame, data_format: str, record: str = "record") -> DataFrame:
    """One row: ``num_samples``, ``is_valid``, ``num_errors``; a key with an explicit null is there."""
    return records.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.bool_and(~_lacks(record, data_format)), F.lit(True)).alias("is_valid"),
        F.count_if(_lacks(record, data_format)).alias("num_errors"),
    )


def key_errors(records: DataFrame, data_format: str, record: str = "record", index: str = "id") -> DataFrame:
    """One row per record that lacks a required key, numbered by ``index``."""
    _, text = REQUIRED.get(data_format, ([], ""))
    message = F.concat(F.lit("Sample "), F.col(index).cast("string"), F.lit(f": {text}"))
    return records.where(_lacks(record, data_format)).select(index, message.alias("error"))


def other_fields(records: DataFrame, known: Sequence[str], record: str = "record", keys: Sequence[str] = ("id",)) -> DataFrame:
    """The fields of each object that are not among the known ones: ``field`` and its ``value`` as a variant."""
    fields = records.sparkSession.tvf.variant_explode(F.col(record).outer())
    found = records.select(*keys, record).lateralJoin(fields)
    return found.where(F.col("key").isNotNull() & ~F.col("key").isin(*known)).select(*keys, F.col("key").alias("field"), "value")


def leaves(records: DataFrame, record: str = "record", keys: Sequence[str] = ("run",), levels: int = 4) -> DataFrame:
    """All values of a document of unknown layout: their ``path`` of keys and positions, and ``number`` or ``text``.

    Objects and arrays below ``levels`` levels come out whole, as JSON in ``text``; so do empty ones.
    """
    rows = records.select(*keys, F.lit("").alias("path"), F.col(record).alias("_value"))
    for _ in range(levels):
        parts = records.sparkSession.tvf.variant_explode_outer(F.col("_value").outer())
        step = F.coalesce("key", F.col("pos").cast("string"))
        rows = rows.lateralJoin(parts).select(
            *keys,
            F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), step).alias("path"),
            F.coalesce("value", "_value").alias("_value"),
        )
    number = F.try_variant_get("_value", "$", "double")
    is_number = F.schema_of_variant("_value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return rows.select(
        *keys,
        "path",
        F.when(is_number, number).alias("number"),
        F.when(~is_number & ~F.is_variant_null("_value"), F.coalesce(F.try_variant_get("_value", "$", "string"), F.to_json("_value"))).alias("text"),
    )
