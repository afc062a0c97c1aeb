"""Helpers shared by the operators on documents."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import scratch_path

#: Fixed value: the characters between words. ``bytes.split()`` splits at the same six.
SPACES = " \t\n\x0b\x0c\r"

#: Text bytes of a block on small data, and at most.
BLOCK_BYTES = 8 << 20
MAX_BLOCK_BYTES = 256 << 20

#: Entries of a worker's word cache; it is emptied when full.
CACHED_WORDS = 50_000

#: Texts of a batch that are Python objects at once.
SLICE_ROWS = 200


def free_name(base: str, *frames: DataFrame) -> str:
    """``base``, with underscores until no column of the frames has that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def words_of(text: Column) -> Column:
    """The words of a text between ASCII blanks; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join by sorting, however small Spark takes it to be.

    Its estimate knows neither how many rows an explode makes nor how far Parquet packs numbers, and a broadcast that was chosen by it
    is not taken back: it has to fit the driver. For tables that grow with the input.
    """
    return df.hint("merge")


def block_number(docs: DataFrame, text: str) -> int:
    """Into how many blocks the texts are dealt.

    Blocks exchange one message per pair of block and key range, so they grow with the
    square root of the data until a worker's memory is the limit.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    size = min(MAX_BLOCK_BYTES, max(BLOCK_BYTES, math.isqrt(total * (16 << 10))))
    return max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / size))


def blocked(docs: DataFrame, by: list[str], block: str, blocks: int) -> DataFrame:
    """``docs`` dealt evenly into blocks and kept as a bucketed table, so that later passes need no shuffle of texts."""
    table = f"blocks_{uuid.uuid4().hex}"
    (
        docs.withColumn(block, F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
        .repartition(blocks, block)
        .write.option("path", scratch_path(docs.sparkSession, "blocks"))
        .option("compression", "zstd")
        .bucketBy(blocks, block)
        .saveAsTable(table)
    )
    return docs.sparkSession.table(table)


class WordKeys(dict):
    """128-bit keys of words, kept while there is room."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        key = self[word] = xxhash.xxh3_128_digest(word)
        return key


_keys = WordKeys()


def word_keys(words: list[bytes]) -> np.ndarray:
    """The keys of words as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(map(_keys.__getitem__, words)), dtype="<u8").reshape(-1, 2)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The values of a text column in UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def each_text(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The values of a text column in UTF-8, few of them at a time; null is empty."""
    for begin in range(0, len(column), SLICE_ROWS):
        yield from as_bytes(column.slice(begin, SLICE_ROWS))


def each_string(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Like ``each_text``, as strings."""
    for begin in range(0, len(column), SLICE_ROWS):
        yield from (x or "" for x in column.slice(begin, SLICE_ROWS).to_pylist())


def give_back() -> None:
    """Free what earlier tasks left in this worker: workers live on, and their caches hang in cycles that are seldom collected."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that their leading bits are even."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each set in more than half of the hashes; none for no hashes."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):  # bounds what a very long text takes
        part = hashes[begin : begin + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def range_bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut into equal ranges of the key space."""
    step = (1 << 64) // ranges
    cuts = np.array([step * i for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes of equal weight together, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    rows = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(rows).view(dtype).ravel()
