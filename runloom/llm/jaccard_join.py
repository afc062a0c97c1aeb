"""Texts whose word n-grams overlap, joined on rare-first prefixes.

All sets are sorted by one order, rare n-grams first. If two sets are similar enough, their prefixes of that order share an n-gram,
so only prefixes are joined. What meets there passes filters that cost no set: by length, by the position of the shared
n-gram (what can still follow it), and by suffix (the sizes of both sets in fixed ranges of the key space differ by no more than the
sets may). Only then are the two whole sets fetched and compared, once per pair.

Equal sets are one point, so thousands of copies cost no more than one text. A bucket of near-copies is first compared
with few of its members; what that connects needs no more. Only points that are not connected yet are compared in pairs: first
each with few of its possible partners, then with more, at last with all. After few random partners each, a dense group
hangs together, and what has no common label yet has few links left, so links grow with a group's size and not with its square.

Rareness comes from a table of counts by hash of the n-gram, over all texts. Any order gives the same result; a good one gives few candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm import common
from runloom.llm.components import components

#: Bits of the hash that n-grams are counted by: a table of 4 MB, at any size of the input.
COUNT_BITS = 20

#: Text bytes whose n-grams are made at once, and n-grams that are counted at once.
GROUP_BYTES, COUNTED = 1 << 19, 1 << 20

#: Bytes of a word up to which eight at a time are hashed for all words at once; longer ones, which are few, each alone.
LONG_WORD = 64

#: Which bytes part words, and the masks of the first 0 to 8 bytes of a number.
_BLANK = np.isin(np.arange(256), list(common.SPACES.encode()))
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

#: Parts that the table of counts is added up in, and the groups that add first.
COUNT_PARTS, COUNT_GROUPS = 16, 16

#: Members of a bucket that one task compares with each other; larger buckets are dealt out in pairs of blocks.
BUCKET_BLOCK = 2048

#: Pairs that a task looks at in one step.
PAIRS = 1 << 16

#: Rounds in which a bucket's members are compared with one of them, before those not yet connected are compared in pairs.
STAR_ROUNDS = 1

#: Partners in a bucket that a point is compared with first, and by how many times more they are in each further round.
FIRST_PARTNERS = 16

#: Pairs that a task holds before it leaves out those beyond a round's partners.
HELD_PAIRS = 1 << 20

#: Points of 40 bytes up to which those asked for are broadcast to find their texts again.
BROADCAST_ROWS = 1_000_000

#: Ranges of the key space that the suffix filter counts, one for each value of a key's first byte.
CELLS = 256

#: Pairs whose ranges are compared in one step.
CELL_PAIRS = 1 << 12


def ngrams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit keys of the texts' word n-grams, one text after the other in their order, and how many each has.

    A text of fewer words is one n-gram, an empty one has none. All texts are worked on at once, as arrays.
    """
    joined = b"\n".join([*texts, bytes(8)]).lower()
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    bounds = np.flatnonzero(np.diff(_BLANK[np.frombuffer(joined, np.uint8, begins[-1])], prepend=True))
    starts, ends = bounds[::2], bounds[1::2]
    keys = _word_hashes(joined, starts, ends - starts)
    first = np.searchsorted(starts, begins)
    words = np.diff(first)
    of = np.repeat(np.arange(len(texts)), words)
    width = np.minimum(words, size)[of]
    at = np.flatnonzero(np.arange(len(of)) + width <= first[1:][of])
    width, total = width[at].astype(np.uint64), np.zeros(len(at), np.uint64)
    for i in range(size):
        longer = total * np.uint64(0x9E3779B97F4A7C15) + keys[np.minimum(at + i, len(keys) - 1)]
        total = np.where(width > i, longer, total)
    return common.mixed(total + width), np.bincount(of[at], minlength=len(texts))


def _word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, of eight bytes at a time; eight more follow the last word."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keys = common.mixed(eights[starts] & _LOW_BYTES[np.minimum(sizes, 8)])
    keys = common.mixed(keys + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    for done in range(8, LONG_WORD, 8):
        more = more[sizes[more] > done]
        if not len(more):
            break
        part = eights[starts[more] + done] & _LOW_BYTES[np.minimum(sizes[more] - done, 8)]
        keys[more] = common.mixed(common.mixed(keys[more] + part))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        keys[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return keys


def _each_sorted(values: np.ndarray, counts: np.ndarray) -> None:
    """Sort the values of each text in place."""
    ends = np.cumsum(counts)
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        values[begin:end].sort()


def _distinct(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of each text, and how many each has; the n-grams given are sorted in place."""
    _each_sorted(grams, counts)
    of = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[fresh], np.bincount(of[fresh], minlength=len(counts))


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts in order, about ``GROUP_BYTES`` at a time."""
    held, size = [], 0
    for text in common.each_text(column):
        held.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` and ``text`` with two hashes of the text, by which a row is found again."""
    text = docs[text_col]
    return docs.select(
        docs[id_col].alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"), F.xxhash64(F.lit("second"), text).alias("second")
    )


def rareness(texts: DataFrame, size: int) -> np.ndarray:
    """How often the n-grams of each hash occur in the ``text`` of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, task, waiting, size_waiting = np.zeros(1 << COUNT_BITS, np.int64), 0, [], 0

        def add() -> None:
            if waiting:
                slots = (np.concatenate(waiting) & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
                np.add(counts, np.bincount(slots, minlength=len(counts)), out=counts)
                waiting.clear()

        common.give_back()
        for batch in batches:
            for group in _groups(batch.column("text")):
                waiting.append(ngrams(group, size)[0])
                size_waiting += len(waiting[-1])
                for text in group:
                    task = (task * 31 + len(text)) % COUNT_GROUPS
                if size_waiting >= COUNTED:
                    add()
                    size_waiting = 0
        add()
        if counts.any():
            # Few bytes where the counts are small, as they are in one task.
            parts = np.minimum(counts, (1 << 32) - 1).astype("<u4").reshape(COUNT_PARTS, -1)
            blobs = [common.planes(p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(COUNT_PARTS), pa.int32()), pa.array([task] * COUNT_PARTS, pa.int32()), pa.array(blobs)],
                names=["part", "task", "counts"],
            )

    def add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << COUNT_BITS) // COUNT_PARTS, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total += common.from_planes(blob, "<u4")
        blob = common.planes(np.minimum(total, (1 << 32) - 1).astype("<u4"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob])], names=["part", "counts"])

    parts = texts.select("text").mapInArrow(count, "part int, task int, counts binary")
    parts = parts.groupBy("part", "task").applyInArrow(add_up, "part int, counts binary")
    parts = parts.groupBy("part").applyInArrow(add_up, "part int, counts binary").collect()
    counts = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), np.uint32)
    for part, blob in parts:
        counts[part] = common.from_planes(bytes(blob), "<u4")
    return counts.ravel()


def tokens_of(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What n-grams are joined by: rare ones have small numbers.

    The count fills the upper 20 bits and those bits of the n-gram that did not choose the count the others. Two n-grams of one token
    count as one that a text has twice, which only adds pairs to be compared: what is shared does not get less.
    """
    count = counts[(grams & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return (np.minimum(count, np.uint64((1 << COUNT_BITS) - 1)) << np.uint64(64 - COUNT_BITS)) | (grams >> np.uint64(COUNT_BITS))


def prefix_length(n, percent: int):
    """Of two sets that are similar enough, each has one of the common members among so many first ones."""
    return n + (-percent * n // 100) + 1


def least_shared(total, percent: int):
    """How many members two sets of so many in all must share."""
    return -(-percent * total // (100 + percent))


def described(texts: DataFrame, size: int, percent: int, fingerprints: bool = False) -> DataFrame:
    """The rows without their ``text``, numbered, with what the join needs of each one's set: key, size, prefix and cells.

    The key has 128 bits. ``fp`` is the SimHash of the n-grams, repeats included, if asked for. The table is written, so numbers never change.
    """
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    return common.written(_described(numbered, rareness(texts, size), size, percent, fingerprints), "rows")


def points_of(rows: DataFrame, prefixes: bool = True) -> DataFrame:
    """One row per distinct set, named by its least row in ``id``, with the ``doc``, ``mark`` and ``second`` of one text that has it.

    Without ``prefixes``, which take most of the disk, they stay in ``rows`` alone, see ``prefixes_of``.
    """
    one = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark", "second")
    figures = ["n", *(["prefix"] if prefixes else []), "cells", "fp"]
    points = rows.groupBy("k1", "k2").agg(F.min("row").alias("id"), F.min(one).alias("one"), *[F.first(c).alias(c) for c in figures])
    points = points.select("k1", "k2", "id", "one.doc", "one.mark", "one.second", *figures)
    return common.written(points, "points")


def prefixes_of(rows: DataFrame) -> DataFrame:
    """The prefix of each row's set by the row's number, of which points have the least."""
    return rows.select(F.col("row").alias("id"), "prefix")


def _described(texts: DataFrame, counts: np.ndarray, size: int, percent: int, fingerprints: bool) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    carried = [f for f in texts.schema if f.name != "text"]
    figures = "k1 long, k2 long, n int, prefix array<long>, cells binary, fp long"
    schema = T.StructType([*carried, *T.StructType.fromDDL(figures)])

    def figures_of(group: list[bytes], order_of: np.ndarray) -> tuple[np.ndarray, ...]:
        grams, counts = ngrams(group, size)
        each = lambda x, n: np.split(x, np.cumsum(n)[:-1])
        marks = [common.majority_bits(x) if fingerprints else 0 for x in each(grams, counts)]
        s, n = _distinct(grams, counts)
        pair = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.tobytes()) for x in each(s, n)]), "<i8").reshape(-1, 2)
        of = np.repeat(np.arange(len(n)), n)
        spread = np.bincount(of * CELLS + (s >> np.uint64(56)).astype(np.int64), minlength=len(n) * CELLS).reshape(-1, CELLS)
        ranked = tokens_of(s, order_of)
        _each_sorted(ranked, n)
        length = np.where(n > 0, prefix_length(n, percent), 0)
        first = np.arange(len(ranked)) - (np.cumsum(n) - n)[of] < length[of]
        return pair, n, length, ranked[first].view(np.int64), np.minimum(spread, 255).astype(np.uint8), np.array(marks, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        order_of = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                parts = [figures_of(group, order_of) for group in _groups(batch.column("text"))]
                pair, sizes, lengths, prefixes, cells, marks = (np.concatenate(x) for x in zip(*parts))
                arrays = [
                    *[batch.column(f.name) for f in carried],
                    pa.array(pair[:, 0].copy()),
                    pa.array(pair[:, 1].copy()),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), pa.array(prefixes)),
                    pa.array([c.tobytes() for c in cells], pa.binary()),
                    pa.array(marks),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return texts.mapInArrow(run, schema)


def _may_be_similar(n_a: np.ndarray, n_b: np.ndarray, cells_a, cells_b, percent: int) -> np.ndarray:
    """Length and suffix filter: what the sizes, in all and by range, allow. ``cells`` give the ranges of a slice of the pairs."""
    total = n_a.astype(np.int64) + n_b
    least = least_shared(total, percent)
    passed = least <= np.minimum(n_a, n_b)
    for begin in range(0, len(total), CELL_PAIRS):
        part = slice(begin, begin + CELL_PAIRS)
        apart = np.abs(cells_a(part).astype(np.int16) - cells_b(part)).sum(axis=-1, dtype=np.int64)
        passed[part] &= apart <= (total - 2 * least)[part]
    return passed


def _filtered(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` that pass the filters by length and suffix."""

    def cells(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            a, b = (cells(batch.column(c)) for c in ("cells_a", "cells_b"))
            passed = _may_be_similar(n_a, n_b, a.__getitem__, b.__getitem__, percent)
            yield batch.select(["a", "b"]).filter(pa.array(passed))

    of = [points.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}")) for x in "ab"]
    both = pairs.join(common.merged(of[0]), "a").join(common.merged(of[1]), "b")
    return both.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(run, "a long, b long")


def _sets_of(asked: DataFrame, points: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``id`` and whole ``grams`` of the points asked for, from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                sets = [_distinct(*ngrams(group, size)) for group in _groups(batch.column("text"))]
                flat, counts = (np.concatenate(x) for x in zip(*sets))
                ends = np.cumsum([0, *counts]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "grams"])

    one = common.written(points.join(common.merged(asked), "id", "left_semi").select("id", "doc", "mark", "second"), "asked")
    one = F.broadcast(one) if one.count() <= BROADCAST_ROWS else common.merged(one)
    given = texts.withColumnsRenamed({"doc": "text_doc", "mark": "text_mark", "second": "text_second"})
    same = (F.col("mark") == F.col("text_mark")) & (F.col("second") == F.col("text_second")) & F.col("doc").eqNullSafe(F.col("text_doc"))
    found = given.join(one, same).select("id", "text").mapInArrow(run, "id long, grams array<long>")
    # Repeated rows give a point's text twice.
    return common.written(found.groupBy("id").agg(F.first("grams").alias("grams")), "sets")


def _verified(pairs: DataFrame, points: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    pairs = common.written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), points, texts, size)
    of = [sets.select(F.col("id").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab"]
    few = pairs.count() <= BROADCAST_ROWS  # so that Spark may broadcast them and leave the sets where they are
    both = (pairs if few else common.merged(pairs)).join(of[0], "a").join(common.merged(of[1]), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    total = (F.size("grams_a") + F.size("grams_b")).cast("long")
    return common.written(both.where((100 + percent) * shared >= percent * total).select("a", "b"), "links")


def verified_links(pairs: DataFrame, points: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of any pairs ``a``, ``b`` of points those that are similar enough, each once."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return _verified(_filtered(ordered, points, percent), points, texts, size, percent)


def _possible(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each bucket or pair of blocks that are not connected and pass the filters by length and position."""
    n, place, label, mine, token, i, j = (rows[c].to_numpy() for c in ("n", "pos", "label", "mine", "token", "i", "j"))
    after = n - place
    ends = np.append(_starts(token, i, j)[1:], len(n))
    partners = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(n)) - 1
    total, begin = np.concatenate([[0], np.cumsum(partners)]), 0
    while begin < len(n):
        # So many rows that their pairs fit; a row has fewer partners than its bucket has members.
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
        count = partners[begin:stop]
        a = np.repeat(np.arange(begin, stop), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[begin:stop] - total[begin], count)
        fits = (label[a] != label[b]) & ((mine[a] != mine[b]) | (i[a] == j[a]))
        # What can follow a shared n-gram bounds what is shared, and so do the lengths.
        fits &= np.minimum(after[a], after[b]) >= least_shared(n[a].astype(np.int64) + n[b], percent)
        yield a[fits], b[fits]
        begin = stop


def _by_bucket(work):
    """Rows come sorted by bucket; whole buckets, small ones by the thousand, are worked on at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(_starts(*[rows[c].to_numpy() for c in ("token", "i", "j")])[-1]) if rows.num_rows else 0
            held = rows.slice(last)
            if last:
                yield from work(rows.slice(0, last))
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def _with_partners(percent: int):
    """The rows that have a possible partner in their bucket. Few have, so only those are given their ranges."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        alive = np.zeros(rows.num_rows, bool)
        for a, b in _possible(rows, percent):
            alive[a] = alive[b] = True
        yield from rows.filter(pa.array(alive)).to_batches()

    return _by_bucket(work)


def _few_of_each(a: np.ndarray, b: np.ndarray, order: np.ndarray, partners: int) -> np.ndarray:
    """Places of the pairs that are among the first ``partners`` pairs of either end, by ``order``."""
    by_order = np.argsort(order, kind="stable")
    ends, of = np.stack([a[by_order], b[by_order]], axis=1).ravel(), np.repeat(by_order, 2)
    by_end = np.argsort(ends, kind="stable")
    starts = _starts(ends[by_end])
    rank = np.arange(len(ends)) - np.repeat(starts, np.diff(np.append(starts, len(ends))))
    return np.unique(of[by_end[rank < partners]])


def _block_pairs(percent: int, partners: int):
    """The possible pairs that pass the suffix filter too, each in the first open bucket that it shares.

    Of a point with more than so many ``partners`` in a bucket only those come that a hash of the pair puts first, and
    those that it is among the first of.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(-1, CELLS)
        lists = rows["earlier"].combine_chunks()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        earlier, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts) - counts
        found, held = [np.empty((0, 2), np.int64)], 0

        def first_ones() -> np.ndarray:
            pairs = np.concatenate(found)
            a, b = ids[pairs].T.astype(np.uint64)
            order = common.mixed(common.mixed(np.minimum(a, b)) + np.maximum(a, b))
            return pairs[_few_of_each(pairs[:, 0], pairs[:, 1], order, partners)]

        for a, b in _possible(rows, percent):
            near = _may_be_similar(n[a], n[b], lambda part, a=a: cells[a[part]], lambda part, b=b: cells[b[part]], percent)
            a, b = a[near], b[near]
            first = ~_meets_before(starts, counts, earlier, a, b)
            found.append(np.stack([a[first], b[first]], axis=1))
            held += len(found[-1])
            if held > HELD_PAIRS:
                # What is left out is beyond the partners among all pairs too.
                found, held = [first_ones()], 0
        yield _as_batch(np.unique(np.sort(ids[first_ones()], axis=1), axis=0))

    return _by_bucket(work)


def _meets_before(starts: np.ndarray, counts: np.ndarray, tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of a pair share an earlier n-gram of an open bucket: then the pair was found there."""
    met = np.zeros(len(a), bool)
    of, last = lambda x: tokens[starts[x] : starts[x] + counts[x]].tolist(), None
    for place in np.flatnonzero((counts[a] > 0) & (counts[b] > 0)):
        if a[place] != last:
            last = a[place]
            own = set(of(last))
        met[place] = not own.isdisjoint(of(b[place]))
    return met


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(changed)


def _as_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _open_members(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    """The members of buckets that are not wholly connected yet, with the ``label`` of what each belongs to."""
    if links is None:
        named = buckets.withColumn("label", F.col("id"))
    else:
        label = components(links, "a", "b").withColumnRenamed("node", "id")
        named = buckets.join(common.merged(label), "id", "left").withColumn("label", F.coalesce("label", "id"))
        named = common.written(named, "labels")
    ends = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    return named.join(common.merged(ends.where("low < high")), "token")


def links_between(
    points: DataFrame,
    texts: DataFrame,
    size: int,
    percent: int,
    known: DataFrame | None = None,
    block: int | None = None,
    prefixes: DataFrame | None = None,
) -> DataFrame:
    """Edges ``a``, ``b`` that connect every two points whose sets are similar enough; each is such a pair itself.

    ``known`` has edges that were found by other means; what they connect is not compared again. ``prefixes`` has
    those of the points if they do not have them themselves.
    """
    block = block or BUCKET_BLOCK
    listed = points if prefixes is None else points.select("id", "n").join(common.merged(prefixes), "id")
    postings = listed.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    ends = postings.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    buckets = common.written(postings.join(common.merged(ends.select("token")), "token"), "buckets")
    for _ in range(STAR_ROUNDS):
        # One member that belongs to the last label, compared with all that belong to others.
        members = common.written(_open_members(buckets, known), "members")
        if members.isEmpty():
            return known if known is not None else members.selectExpr("id AS a", "id AS b")
        heads = members.where("label = high").groupBy("token").agg(F.min("id").alias("head"))
        rest = members.where("label < high").join(common.merged(heads), "token")
        stars = rest.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
        found = _verified(_filtered(stars, points, percent), points, texts, size, percent)
        known = found if known is None else known.unionByName(found)
    pair = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks").cast("int") - 1),
            lambda other: F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j")),
        )
    )
    together = lambda df: df.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    partners = FIRST_PARTNERS
    while True:
        members = common.written(_open_members(buckets, known), "members")
        dealt = (
            members.withColumn("blocks", F.ceil(F.col("size") / block))
            .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .select("token", "id", "n", "pos", "label", "mine", pair.alias("pair"))
            .select("token", "pair.i", "pair.j", "id", "n", "pos", "label", "mine")
        )
        alive = common.written(together(dealt).mapInArrow(_with_partners(percent), dealt.schema), "alive")
        if alive.isEmpty():
            return known
        # The n-grams of buckets in which a point has a partner, no more than its prefix: a pair is taken in the first that it shares.
        opens = alive.groupBy("id").agg(F.collect_set(F.struct("pos", "token")).alias("opens"))
        earlier = F.transform(F.filter("opens", lambda x: x["pos"] < F.col("pos")), lambda x: x["token"])
        of_id = common.merged(points.select("id", "cells").join(common.merged(opens), "id"))
        full = alive.join(of_id, "id").select(*dealt.columns, "cells", earlier.alias("earlier"))
        rest = common.written(together(full).mapInArrow(_block_pairs(percent, partners), "a long, b long").distinct(), "candidates")
        known = common.written(known.unionByName(_verified(rest, points, texts, size, percent)), "links")
        most = rest.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().agg(F.max("count")).first()[0] or 0
        if most < partners:
            # A point of which pairs were left out would have so many.
            return known
        partners *= FIRST_PARTNERS


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    percent: int = 85,
    count_col: str = "n_shingles",
    component_col: str = "component_id",
) -> DataFrame:
    """Each row's id, the number of its distinct word n-grams and the smallest id that it is linked to, itself included.

    A-Z count as a-z; words are what stands between ASCII blanks. Two rows are linked if the distinct n-grams (``size`` words; a
    shorter text is one) that both have are at least ``percent`` percent of those that either has. Null and empty
    texts have none and are linked with nothing. One row per input row; repeated rows are linked. A null id is never the smallest; a component
    of null ids alone has a null one. An empty table gives an empty one; texts may be of any length; extra columns are ignored.

    N-grams are compared by 64-bit keys, sets of equal texts by 128 bits. No pair is left out, whatever the size of its bucket.
    """
    texts = marked(docs, id_col, text_col)
    rows = described(texts, size, percent)
    points = points_of(rows.where("n > 0"))
    label = components(links_between(points, texts, size, percent), "a", "b").withColumnRenamed("node", "id")
    named = points.select("k1", "k2", "id", "doc").join(common.merged(label), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = common.written(named, "classes")
    least = named.groupBy("label").agg(F.min("doc").alias("least"))
    of_set = named.join(common.merged(least), "label").select("k1", "k2", "least")
    return rows.select("doc", "n", "k1", "k2").join(common.merged(of_set), ["k1", "k2"], "left").select(
        F.col("doc").alias(id_col),
        F.col("n").cast("long").alias(count_col),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias(component_col),
    )
