"""JSON arrays of any size, read by all cores.

A JSON array has no line breaks to divide it by. Here the text reader cuts the files at closing braces, so every split reads its own
range of bytes through Spark's file access. What a split's text means depends on whether it begins inside a string and how deep:
one pass sums up each split (its unescaped quotes, and its change of depth for either case), a running sum over the splits,
one row each, gives the true state, and a second pass emits the records that lie whole in a split. A record across
splits is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.grouped import join_on, per_group
from runloom.session import written

#: What decides the structure: quotes with the backslashes before them, and brackets.
_MARK = re.compile(r'\\+"|["{}\[\]]')
_SPLIT = ("file", "start")


def _marks(text: str, inside: bool) -> Iterator[tuple[int, int]]:
    """Place and change of depth of each bracket outside strings; the last item is the end, with whether it is inside a string."""
    for mark in _MARK.finditer(text):
        found = mark.group()
        if found[-1] == '"':
            inside ^= len(found) % 2 == 1  # an odd number of backslashes escapes the quote
        elif not inside:
            yield mark.end(), 1 if found in "{[" else -1
    yield -1, inside


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: quotes, first character, and for a begin outside or inside a string the least and the last depth."""
    splits: dict[tuple, list] = {}
    for value, file, start in _rows(batches):
        # state: first character, per case [inside, depth, least depth]
        split = splits.setdefault((file, start), [None, [False, 0, 0], [True, 0, 0]])
        text = value + "}"
        if split[0] is None and value.strip():
            split[0] = value.strip()[0]
        for case in split[1:]:
            for place, change in _marks(text, case[0]):
                if place < 0:
                    case[0] = bool(change)
                else:
                    case[1] += change
                    case[2] = min(case[2], case[1])
    rows = [(*key, first, int(out[0]), out[1], out[2], in_[1], in_[2]) for key, (first, out, in_) in splits.items()]
    columns = zip(*rows) if rows else [[]] * 8
    kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5)
    names = ["file", "start", "first", "quotes", "out_last", "out_least", "in_last", "in_least"]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _states(summaries: DataFrame) -> DataFrame:
    """Per split: whether it begins inside a string, how deep, the depth of records, and the split where an open record began."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    # The reader's last row of a file had no brace; the one added there is below the depth of any record.
    everything = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.when(F.first("first", ignorenulls=True).over(everything) == "[", 1).otherwise(0)
    known = summaries.withColumns({"inside": inside, "base": base})
    last = F.when(F.col("inside"), F.col("in_last")).otherwise(F.col("out_last"))
    least = F.when(F.col("inside"), F.col("in_least")).otherwise(F.col("out_least"))
    depth = F.coalesce(F.sum("last").over(before), F.lit(0))
    placed = known.withColumns({"last": last, "least": least}).withColumn("depth", depth)
    ends_open = F.col("depth") + F.col("last") > F.col("base")
    begins = F.when(ends_open & (F.col("depth") + F.col("least") <= F.col("base")), F.col("start"))
    opener = F.last(begins, ignorenulls=True).over(before)
    return placed.withColumn("opener", opener).select(*_SPLIT, "inside", "depth", "base", "opener")


def _pieces(whole: bool):
    """The records that lie whole in a split, or else the pieces of those that do not, with the split where each began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, []
        inside, depth, base, opener, parts = False, 0, 0, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[]] * 4
            found.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "opener", "start", "value"])

        def close() -> None:
            """A record that goes on in the next split leaves its beginning."""
            if parts and not whole:
                found.append((current[0], opener, current[1], "".join(parts)))

        for value, file, start, inside_, depth_, base_, opener_ in _rows(batches):
            if (file, start) != current:
                close()
                current, inside, depth, base, opener = (file, start), inside_, depth_, base_, opener_
                parts = [""] if depth > base else []
            text, at = value + "}", 0
            for place, change in _marks(text, inside):
                if place < 0:
                    inside = bool(change)
                    continue
                if change > 0 and depth == base and text[place - 1] == "{":
                    at, parts, opener = place - 1, [""], start
                depth += change
                if depth == base and parts:
                    parts.append(text[at:place])
                    complete = opener == start
                    if complete == whole:
                        found.append((file, opener, start, "".join(parts)))
                    parts = []
            if parts:
                parts.append(text[at:])
            if len(found) >= 1000:
                yield batch()
        if current is not None:
            close()
        yield batch()

    return run


def read_json_arrays(spark: SparkSession, path: str, schema: str | T.StructType, corrupt: str | None = None) -> DataFrame:
    """The objects of the JSON arrays in the files at ``path``, one row each, read in ranges of bytes.

    A file may also hold one object, or objects after each other. Strings may hold braces and escaped quotes, records may be nested
    and as large as memory allows for one. Fields that the schema lacks are left out, a record that does not parse has nulls and its text in
    the column ``corrupt`` if that is named. The order of rows is not that of the file.
    """
    # The next record begins after a closing brace, so a split's text ends with one that the reader took away.
    lines = spark.read.text(path, lineSep="}").select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    names = "file long, start long, first string, quotes long, out_last long, out_least long, in_last long, in_least long"
    states = written(_states(lines.mapInArrow(_summaries, names)), "splits")
    known = join_on(lines, per_group(states, states.count()), _SPLIT).select("value", *_SPLIT, "inside", "depth", "base", "opener")
    kinds = "file long, opener long, start long, value string"
    whole = known.mapInArrow(_pieces(True), kinds).select("value")
    parts = known.mapInArrow(_pieces(False), kinds).groupBy("file", "opener")
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), "").alias("value"))
    options = {"mode": "PERMISSIVE"} | ({"columnNameOfCorruptRecord": corrupt} if corrupt else {})
    records = whole.unionByName(joined.select("value"))
    return records.select(F.from_json("value", schema, options).alias("r")).select("r.*")
