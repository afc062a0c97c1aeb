"""Passages of benchmark items in documents, found by SimHash over item-sized windows.

Built-in functions only. A window can be similar to an item only if they share a shingle, and moving
a window on to its first shared shingle never makes it less similar; so the windows that start
at a shared shingle, or end with the document, are all that need a fingerprint. Fingerprints meet in
a multi-index: eight blocks of eight bits, of which one differs in at most radius / 8 bits for any
pair within the radius. An exact weighted similarity of shingles decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.columns import let
from runloom.llm import common

BLOCKS, BLOCK_BITS = 8, 8

#: Rows of a benchmark's shingles or probes up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Letters and digits in lower case; anything else parts words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, shingle: int, keep: bool = False) -> DataFrame:
    """``df``, its text only with ``keep``, with the number of words and the hashes of all runs of ``shingle`` words."""

    def hashes(words: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(words) - shingle)
        run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)])
        runs = F.when(F.size(words) >= shingle, F.transform(each, run)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(runs.alias("shingles"), F.size(words).alias("n_words"))

    # The words are bound once per row, or the optimizer may split the text anew for each of them.
    return df.withColumn("s", let(words_of(F.col(text)), hashes)).select(
        *[c for c in df.columns if keep or c != text], "s.shingles", "s.n_words"
    )


def simhash(shingles: Column) -> Column:
    """64 bits, each set in more than half of the hashes, repeats included."""
    bit = lambda b: F.aggregate(
        shingles, F.lit(0), lambda n, h: n + F.getbit(h, b)
    )
    bits = F.transform(F.sequence(F.lit(63), F.lit(0)), lambda b: (2 * bit(b) > F.size(shingles)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda x, b: F.shiftleft(x, 1).bitwiseOR(b))


def similarity(a: Column, b: Column) -> Column:
    """Shared weight over joint weight; a shingle weighs as often as it occurs."""
    both = F.array_intersect(a, b)
    times = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    counted = F.aggregate(both, F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    simple = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(simple, F.size(both)).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def block_values(fingerprint: Column) -> Column:
    """The blocks of a fingerprint with their numbers."""
    part = lambda k: F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), part(k).alias("value")) for k in range(BLOCKS)])


def near_masks(errors: int) -> list[int]:
    """All masks of a block with at most that many bits."""
    return [sum(1 << i for i in c) for n in range(errors + 1) for c in combinations(range(BLOCK_BITS), n)]


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else common.merged(df)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    radius: int = 23,
) -> DataFrame:
    """Document and item for every passage at ``threshold`` or more, with its best window.

    Columns: the ids, ``similarity``, ``first_word`` and ``last_word`` of the best window (the first of equal
    ones) and ``n_windows``, the windows that reach the threshold. A window has as many words as
    the item, or is the whole document if that is shorter. An item below ``shingle`` words is compared by
    runs of its own length. At a similarity of 0.8 about nine fingerprint bits differ, so radius 23
    leaves out a pair at the threshold with a chance below one in a million.

    Null or empty texts and items hold and match nothing. Repeated rows of one id give one result. Rows
    with a null id are found under the null id. Items of equal text are all reported. Empty tables
    give an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text"))
    length = F.size(words_of(F.col("item_text")))
    items = common.written(items.withColumn("run", F.least(length, F.lit(shingle))).where("run > 0"), "items")
    sizes = [r["run"] for r in items.select("run").distinct().orderBy("run").collect()]  # at most ``shingle`` numbers
    found = [
        _find_size(docs, items.where(F.col("run") == s).select("item", "item_text"), id_col, text_col, s, threshold, radius)
        for s in sizes or [shingle]
    ]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.withColumnsRenamed({"id": id_col, "item": item_col})


def _hits(rows: DataFrame, marks: DataFrame, shingle: int) -> DataFrame:
    """``id, digest, text`` of the rows that share a shingle with an item, and in ``seeds`` where and with items of what size."""
    seeds = F.collect_set(F.struct("place", "size")).alias("seeds")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # The text goes along to the aggregation, so that only documents with a hit are shuffled and none is read again.
        places = with_shingles(rows, "text", shingle, keep=True).select("id", "digest", "text", F.posexplode_outer("shingles").alias("place", "h"))
        return places.join(F.broadcast(marks), "h").groupBy("id", "digest").agg(seeds, F.first("text").alias("text"))
    places = with_shingles(rows, "text", shingle).select("id", "digest", F.posexplode_outer("shingles").alias("place", "h"))
    found = places.join(common.merged(marks), "h").groupBy("id", "digest").agg(seeds)
    found = found.withColumnsRenamed({"id": "seed_id", "digest": "seed_digest"})
    same = F.col("id").eqNullSafe(F.col("seed_id")) & (F.col("digest") == F.col("seed_digest"))
    return rows.join(found, same).groupBy("id", "digest").agg(F.first("seeds").alias("seeds"), F.first("text").alias("text"))


def _find_size(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, radius: int
) -> DataFrame:
    items = with_shingles(items, "item_text", shingle).withColumnsRenamed({"shingles": "item_shingles", "n_words": "size"})
    items = common.written(items.withColumn("item_fp", simhash(F.col("item_shingles"))), "items")
    marks = items.select(F.explode("item_shingles").alias("h"), "size").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    hit = _hits(rows, marks, shingle)
    hit = with_shingles(common.written(hit, "hits"), "text", shingle)
    last = lambda size: F.greatest(F.lit(0), F.size("shingles") - (size - shingle + 1))
    starts = F.array_distinct(
        F.transform("seeds", lambda s: F.struct(F.least(s["place"], last(s["size"])).alias("start"), s["size"].alias("size")))
    )
    windows = hit.select("id", "n_words", "shingles", F.explode_outer(starts).alias("w"))
    windows = windows.select(
        "id",
        "w.start",
        "w.size",
        F.least(F.col("n_words"), F.col("w.start") + F.col("w.size")).alias("stop"),
        F.slice("shingles", F.col("w.start") + 1, F.col("w.size") - shingle + 1).alias("shingles"),
    )
    windows = common.written(windows.withColumn("fp", simhash(F.col("shingles"))), "windows")
    masks = F.array(*[F.lit(m) for m in near_masks(radius // BLOCKS)])
    probes = items.withColumn("b", F.explode(block_values(F.col("item_fp"))))
    probes = probes.select("item", "size", "item_fp", "b.block", "b.value", F.explode(masks).alias("mask"))
    probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    asked = windows.withColumn("b", F.explode(block_values(F.col("fp")))).select("*", "b.block", "b.value").drop("b")
    near = asked.join(_maybe_broadcast(probes), ["size", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # A pair that meets in several blocks is compared in the first of them only.
    byte = (1 << BLOCK_BITS) - 1
    differing = lambda k: F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("item_fp")), BLOCK_BITS * k).bitwiseAND(F.lit(byte)))
    meeting = F.coalesce(*[F.when(differing(k) <= radius // BLOCKS, F.lit(k)) for k in range(BLOCKS)])
    near = near.where(F.col("block") == meeting)
    near = near.join(_maybe_broadcast(items.select(F.col("item").alias("item_"), "item_shingles")), F.col("item").eqNullSafe(F.col("item_")))
    near = near.withColumn("similarity", similarity(F.col("shingles"), F.col("item_shingles")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "stop"))
    passed = near.where(F.col("similarity") >= threshold).groupBy("id", "item")
    return passed.agg(best.alias("b"), F.countDistinct("start").alias("n_windows")).select(
        "id",
        "item",
        F.col("b.similarity").alias("similarity"),
        (-F.col("b.back")).cast("long").alias("first_word"),
        (F.col("b.stop") - 1).cast("long").alias("last_word"),
        "n_windows",
    )
