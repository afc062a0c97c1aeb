"""A word vocabulary with dense ids by frequency, and texts encoded by it.

Building reads the texts once: a task counts its words before it hands them over, so a shuffle gets a word some times a task, not
as often as it occurs. A count of counts gives the least count that a wanted size lets in. Ids follow the counts, words of equal
counts in byte order.

Encoding looks up words by part, a few megabytes of texts: a part sends each distinct word once. Frequent words stay local: a fixed
number of them is broadcast. Only what they do not cover is joined by word with the rest of the vocabulary, so no frequent word is
ever the key of a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.grouped import row_positions
from runloom.session import written

#: Id of words that the vocabulary lacks; the most frequent word has the next one.
UNKNOWN_ID = 0
#: Frequent words that are broadcast.
HOT_WORDS = 100_000
#: Text bytes of a part, whose distinct words are looked up together.
PART_BYTES = 4 << 20
#: Distinct words that a task counts before it hands over.
TASK_WORDS = 500_000


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word`` and a ``count`` of it, some rows per word: a task adds up before it hands over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in _parts(batch.column(0).cast(pa.binary()).to_pylist()):
                for one in part:
                    counts.update(one.split() if one else ())
                if len(counts) > TASK_WORDS:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)

    return docs.select(text).mapInArrow(run, "word string, count long")


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "count"])


def _parts(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """The texts in order, so many at once that they have ``PART_BYTES`` or just more."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or b"")
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def least_count(counts: DataFrame, size: int) -> Column:
    """Scalar: the least count such that no more than ``size`` rows have it or more, by a count of counts.

    There are at most as many distinct counts as the root of twice the words, so one task may order them.
    """
    running = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0)
    levels = counts.groupBy("count").agg(F.count("*").alias("_rows"))
    return levels.withColumn("_upto", F.sum("_rows").over(running)).where(F.col("_upto") <= size).agg(F.min("count")).scalar()


def build_vocabulary(docs: DataFrame, text: str = "text", size: int | None = None, min_count: int = 1) -> DataFrame:
    """``word, count, id`` of the words that occur ``min_count`` times or more, the ``size`` most frequent of them.

    Ids are dense from 1 on: by count, then by the bytes of the word. Words are what stands between white space. Null
    texts have none. The table is written, so that ids stay as they are.
    """
    counted = _word_counts(docs, text).groupBy("word").agg(F.sum("count").alias("count"))
    counted = written(counted.where(F.col("count") >= min_count), "words")
    if size is not None:
        # One level below the cut may be needed in part: those words are ranked below.
        lowest = counted.where(F.col("count") < F.coalesce(least_count(counted, size), F.lit(2**62))).agg(F.max("count")).scalar()
        counted = counted.where(F.col("count") >= F.coalesce(lowest, F.lit(0)))
    ranked = row_positions(counted, [], [F.desc("count"), F.asc("word")], "id")
    if size is not None:
        ranked = ranked.where(F.col("id") <= size)
    return written(ranked.select("word", "count", F.col("id").cast("int").alias("id")), "vocabulary")


def encode(
    docs: DataFrame, vocabulary: DataFrame, id_col: str, text: str = "text", name: str = "input_ids", hot_words: int = HOT_WORDS
) -> DataFrame:
    """``id_col`` and the ids of each text's words, one row per text; ``id_col`` should be unique.

    Words that the vocabulary lacks have ``UNKNOWN_ID``, a null text has null ids. Dense ids bound the broadcast: no more than
    ``hot_words`` rows. Texts of one id are put together by the places of their words.
    """
    id_type = docs.schema[id_col].dataType
    numbered = docs.select(F.col(id_col).alias("_id_of"), F.col(text).alias("_text")).mapInArrow(
        _parts_coded,
        T.StructType([T.StructField("_ids_of", T.ArrayType(id_type)), *T.StructType.fromDDL("_codes array<array<int>>, _words array<string>")]),
    )
    # Numbers of parts must not change between the two uses of the table.
    parts = written(numbered.withColumn("_part", F.monotonically_increasing_id()), "parts")
    placed = parts.select("_part", F.posexplode("_words").alias("_at", "word"))
    hot = F.broadcast(vocabulary.where(F.col("id") <= hot_words).select("word", F.col("id").alias("_id")))
    rest = vocabulary.where(F.col("id") > hot_words).select("word", F.col("id").alias("_id"))
    if rest.isEmpty():
        found = placed.join(hot, "word", "left")
    else:
        found = placed.join(hot, "word").unionByName(placed.join(hot, "word", "left_anti").join(rest, "word", "left"))
    pair = F.struct("_at", F.coalesce("_id", F.lit(UNKNOWN_ID)).alias("_id"))
    known = found.groupBy("_part").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["_id"]).alias("_known"))
    ids = F.transform("_codes", lambda codes: F.transform(codes, lambda code: F.get("_known", code)))
    both = parts.select("_part", "_ids_of", "_codes").join(known, "_part", "left")
    encoded = both.select(F.inline(F.arrays_zip(F.col("_ids_of").alias(id_col), ids.alias(name)))).toDF(id_col, name)
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return encoded
    places = F.transform(name, lambda i, place: F.struct(place.alias("_place"), i.alias("_id")))
    merged = encoded.groupBy(id_col).agg(
        F.max(F.col(name).isNull()).alias("_none"), F.sort_array(F.flatten(F.collect_list(places))).alias("_pairs")
    )
    return merged.select(id_col, F.when(~F.col("_none"), F.transform("_pairs", lambda p: p["_id"])).alias(name))


def _parts_coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per part of a batch: its ids, its distinct words and each text's words as places among them."""
    for batch in batches:
        begin = 0
        for part in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
            own: dict[bytes, int] = {}
            # The characters that ``words`` cuts at are those of ``bytes.split``.
            codes = [None if text is None else [own.setdefault(word, len(own)) for word in text.split()] for text in part]
            ids = batch.column(0).slice(begin, len(part))
            begin += len(part)
            whole = pa.array([0, len(part)], pa.int32())
            arrays = [
                pa.ListArray.from_arrays(whole, ids),
                pa.ListArray.from_arrays(whole, pa.array(codes, pa.list_(pa.int32()))),
                pa.array([list(own)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["_ids_of", "_codes", "_words"])
