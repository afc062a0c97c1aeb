"""Read and write record sets. Any Hadoop file system URI works as a path."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.sources.json_arrays import read_json_arrays

_CHAT = "ARRAY<STRUCT<`from`: STRING, value: STRING>>"
_MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"

#: Columns of each record format.
SCHEMAS = {
    "alpaca": "instruction STRING, input STRING, output STRING",
    "sharegpt": f"conversations {_CHAT}",
    "messages": f"messages {_MESSAGES}",
    "text": "text STRING",
}
#: Column that holds the text of a line that is not valid JSON.
CORRUPT = "_corrupt_record"


#: Endings of compressed files, which do not tell the form.
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")
_FORMS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv"}


def form_of(spark: SparkSession, path: str) -> str:
    """``jsonl``, ``json`` or ``csv``: by the ending of the name, else by the first line.

    A first line that opens an array, or an object that it does not close, is a document of JSON;
    anything else is one record per line. Compression endings do not count.
    """
    name = path.rstrip("/").lower()
    for ending in _PACKED:
        name = name.removesuffix(ending)
    for ending, form in _FORMS.items():
        if name.endswith(ending):
            return form
    first = spark.read.text(path).where("trim(value) <> ''").head()
    line = first["value"].strip() if first else ""
    whole = line.startswith("[") or (line.startswith("{") and not line.endswith("}"))
    return "json" if whole else "jsonl"


def read_records(
    spark: SparkSession,
    path: str,
    data_format: str = "alpaca",
    schema: str | T.StructType | None = None,
    keep_corrupt: bool = False,
    spread: bool = True,
    multi_line: bool = True,
    file_format: str | None = None,
) -> DataFrame:
    """Read record files: one record per line, JSON documents, or CSV with a header.

    ``file_format`` is ``jsonl``, ``json`` or ``csv``; without it ``form_of`` decides, so a folder of parts,
    compressed files and the output of ``write_splits`` are read whole. Files of different forms in
    one folder need separate calls. The schema is fixed, so nothing is inferred; ``schema`` names
    further fields of the records to keep, or the fields of a format of one's own.

    JSON arrays are read in ranges of bytes by all cores, see ``json_arrays``. With ``spread`` false one task reads each
    file, which keeps the order of its rows. A CSV file is one task's too, unless ``multi_line`` is false because no text holds a line
    break.
    """
    columns = schema or SCHEMAS.get(data_format)
    if columns is None:
        raise ValueError(f"the format {data_format!r} needs a schema")
    columns = T.StructType.fromDDL(columns) if isinstance(columns, str) else columns
    if keep_corrupt:
        columns = T.StructType([*columns.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(columns).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    form = file_format or form_of(spark, path)
    if form == "jsonl":
        return reader.json(path)
    if form == "csv":
        return reader.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    if spread:
        return read_json_arrays(spark, path, columns, CORRUPT if keep_corrupt else None)
    return reader.option("multiLine", True).json(path)


def read_split_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    data_format: str = "alpaca",
    schema: str | T.StructType | None = None,
    file_format: str | None = None,
) -> DataFrame:
    """One file set per split, tagged by ``split``."""
    parts = [
        read_records(spark, path, data_format, schema, file_format=file_format).withColumn("split", F.lit(split))
        for split, path in paths.items()
    ]
    return concat_splits(*parts)


def concat_splits(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, duplicates included."""
    return reduce(DataFrame.unionByName, parts)


def write_splits(df: DataFrame, path: str, file_format: str = "json") -> None:
    """Write one folder per split."""
    df.write.mode("overwrite").partitionBy("split").format(file_format).save(path)


def write_splits_counted(df: DataFrame, path: str, data_format: str, file_format: str = "json") -> dict[str, object]:
    """``write_splits``, and the manifest of ``dataset_info`` counted while the rows are written, without a second read."""
    seen = Observation()
    counts = [F.count_if(F.col("split") == split).alias(name) for split, name in SPLIT_COUNTS.items()]
    write_splits(df.observe(seen, *counts), path, file_format)
    found = seen.get
    numbers = {name: found.get(name, 0) for name in SPLIT_COUNTS.values()}
    return {"format": data_format} | numbers | {"train_file": "split=train", "validation_file": "split=validation"}


#: Splits and what the manifest calls their rows.
SPLIT_COUNTS = {"train": "num_train_samples", "validation": "num_val_samples"}


def dataset_info(df: DataFrame, data_format: str) -> DataFrame:
    """One row: the format, rows per split and where each split lies."""
    return df.agg(
        F.lit(data_format).alias("format"),
        F.count_if(F.col("split") == "train").alias("num_train_samples"),
        F.count_if(F.col("split") == "validation").alias("num_val_samples"),
        F.lit("split=train").alias("train_file"),
        F.lit("split=validation").alias("validation_file"),
    )
