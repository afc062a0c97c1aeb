"""A language model scored by a probabilistic suffix tree, beside a word-count baseline.

The model reads a text as bytes: its lower-cased words with one blank after each, then one end.
A context of up to ``depth`` bytes becomes a state of the tree if its next-byte distribution
diverges from that of the context one byte shorter, however rare it is. Each state's
distribution is smoothed with its parent's; a byte is scored in the longest state that ends
where it begins. A known word's chance blends its discounted share of the training words with the
chance of its bytes by the tree, which takes over the discounted mass. A word that no training
text has is one event, as in the baseline; its chance is that of words seen once. So both scores
are of the same events. The chance of all bytes, unknown words spelled out, is given beside it.

So the tree grows with the contexts of the corpus. Only its states and their next bytes come to the driver
and are sent to every task; ``min_share`` bounds them if asked for. Counts cover all training documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runloom.llm import common

#: The bytes that end a text and that part words; neither occurs inside a word.
END, BLANK = 10, 32

#: Bytes that are packed into numbers at once.
SLICE_BYTES = 2 << 20

#: Codes that are looked up at once, and bits of the place of a code in the table of those that were.
STEP, TABLE_BITS = 1 << 17, 20

_BLOB = "part int, block int, high binary, low binary, n binary, words long, tokens long, once long"


def _as_read(text: bytes) -> bytes:
    """The bytes that the model reads: words in lower case, a blank after each, then one end."""
    return b" ".join([*text.lower().split(), bytes([END])])


def _slices(texts: Iterable[bytes], depth: int) -> Iterator[np.ndarray]:
    """Each byte of the texts as they are read, in order, with the ``depth`` bytes before it in one number."""
    pad, held, size = bytes([END]) * depth, [], 0
    mask = np.uint64((1 << (8 * (depth + 1))) - 1)

    def packed(parts: list[bytes]) -> np.ndarray:
        data = bytes(7) + b"".join(parts)
        codes = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64) & mask
        lengths = np.array([len(p) for p in parts])
        own = np.ones(len(codes), bool)
        begins = np.cumsum(lengths) - lengths
        own[(begins[:, None] + np.arange(depth)).ravel()] = False
        return codes[own]

    for text in texts:
        text = pad + text
        for begin in range(depth, len(text), SLICE_BYTES):  # a long text goes in pieces that know what is before them
            held.append(text[begin - depth : begin + SLICE_BYTES])
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield packed(held)
                held, size = [], 0
    if held:
        yield packed(held)


def _token_numbers(read: bytes) -> tuple[np.ndarray, list[bytes]]:
    """For each token of what is read the number of its word among the distinct ones, and those; the end is an empty word."""
    data = np.frombuffer(read, np.uint8)
    ends = np.flatnonzero((data == BLANK) | (data == END)) + 1
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(read)]).dictionary_encode()
    return tokens.indices.to_numpy(), [x[:-1] for x in tokens.dictionary.to_pylist()]


def _gram_counts(depth: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for codes in _slices(map(_as_read, common.each_text(batch.column(text))), depth):
                keys, n = np.unique(codes, return_counts=True)
                grams.append(keys)
                counts.append(n)
                size += len(keys)
                if size > 4_000_000:
                    keys, n = merged()
                    if len(keys) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["gram", "n"])
                        grams, counts, size = [], [], 0
                    else:
                        grams, counts, size = [keys], [n], len(keys)
        if grams:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return run


@dataclass
class Level:
    """The states of one depth: contexts, how often each occurs, and their smoothed next bytes."""

    contexts: np.ndarray
    totals: np.ndarray
    entries: np.ndarray  # context and next byte in one number, sorted
    chances: np.ndarray


@dataclass
class SuffixTree:
    levels: list[Level]
    smoothing: float

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log10 of the chance of the last byte of each code after the bytes before it."""
        out = np.zeros(len(codes))
        open_at = np.arange(len(codes))  # those whose state or entry is still looked for
        entered = np.zeros(len(codes), bool)
        factor = np.zeros(len(codes))
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            mask = np.uint64((1 << (8 * (depth + 1))) - 1)
            entry = codes[open_at] & mask
            context = entry >> np.uint64(8)
            at = np.minimum(np.searchsorted(level.contexts, context), max(0, len(level.contexts) - 1))
            is_state = level.contexts[at] == context if len(level.contexts) else np.zeros(len(entry), bool)
            place = np.minimum(np.searchsorted(level.entries, entry), max(0, len(level.entries) - 1))
            found = (level.entries[place] == entry) & is_state if len(level.entries) else np.zeros(len(entry), bool)
            done = open_at[found]
            out[done] = factor[done] + np.log10(level.chances[place[found]])
            missed = is_state & ~found
            factor[open_at[missed]] += np.log10(self.smoothing / (level.totals[at[missed]] + self.smoothing))
            open_at = open_at[~found]
        out[open_at] = factor[open_at] - math.log10(256)
        return out

    def token_scores(self, texts: list[bytes]) -> np.ndarray:
        """Log10 of the chance of each token of the texts as they are read: a word with the blank after it, or the end."""
        sums, begun, remembered = [], 0.0, Remembered(self)
        for codes in _slices(texts, len(self.levels) - 1):
            scores = np.concatenate([remembered.log10(codes[i : i + STEP]) for i in range(0, len(codes), STEP)])
            last = codes & np.uint64(255)
            done = (last == BLANK) | (last == END)
            token = np.cumsum(done) - done
            total = np.bincount(token, scores, minlength=int(done.sum()) + 1)
            total[0] += begun
            begun = total[-1]
            sums.append(total[:-1])
        return np.concatenate(sums) if sums else np.empty(0)


class Remembered:
    """Chances by a tree that keeps the last code of each place in a table, as most codes come again and again."""

    def __init__(self, tree: SuffixTree):
        self.tree = tree
        # No code has all bits set: texts in UTF-8 have no such bytes.
        self.codes = np.full(1 << TABLE_BITS, 2**64 - 1, np.uint64)
        self.chances = np.zeros(1 << TABLE_BITS)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Like ``SuffixTree.log10``."""
        place = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.chances[place]
        missed = np.flatnonzero(self.codes[place] != codes)
        keys, inverse = np.unique(codes[missed], return_inverse=True)
        chances = self.tree.log10(keys)
        out[missed] = chances[inverse]
        own = place[missed]
        self.codes[own] = codes[missed]
        fits = self.codes[own] == codes[missed]  # of several codes of one place one stays
        self.chances[own[fits]] = out[missed[fits]]
        return out


def fit(docs: DataFrame, text: str, depth: int, min_share: float, min_gain: float, smoothing: float) -> SuffixTree:
    """The tree of the texts given.

    ``min_share``: a state's context makes up at least that share of all bytes; 0 leaves out none. ``min_gain``: knowing one
    more byte of context saves at least that many nats in all (its count times the Kullback-Leibler
    divergence from its parent's distribution). States whose descendant stays do so as well.
    """
    grams = docs.select(text).mapInArrow(_gram_counts(depth, text), "gram long, n long")
    grams = common.written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    masks = [(1 << (8 * (k + 1))) - 1 for k in range(depth + 1)]
    ways = F.explode(
        F.array(*[F.struct(F.lit(k).alias("depth"), F.col("gram").bitwiseAND(F.lit(m)).alias("entry")) for k, m in enumerate(masks)])
    )
    counts = grams.select(ways.alias("w"), "n").groupBy("w.depth", "w.entry").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("context", F.shiftrightunsigned("entry", 8))
    # A gram at the least share can only be in a context of that share, so rare contexts go before anything is joined. So do those
    # that occur too seldom for the least gain, with what is above them kept: what is above occurs no less often.
    totals = counts.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    least = max(min_share * total, _least_count(total, min_gain))
    frequent = totals.where((F.col("total") >= F.lit(least)) | (F.col("depth") == 0))
    entries = common.written(counts.join(common.merged(frequent), ["depth", "context"]), "entries")
    # The context without its first byte: one level up, and the high byte masked away.
    keep = F.element_at(F.array(*[F.lit((1 << (8 * k)) - 1) for k in range(depth)]), F.col("depth"))
    child = entries.where("depth > 0").withColumn("up", F.col("context").bitwiseAND(keep))
    parent = entries.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("context").alias("up"),
        (F.col("entry").bitwiseAND(F.lit(255))).alias("byte"),
        F.col("n").alias("up_n"),
        F.col("total").alias("up_total"),
    )
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") * F.col("up_total") / F.col("up_n")))
    gains = (
        child.withColumn("byte", F.col("entry").bitwiseAND(F.lit(255)))
        .join(common.merged(parent), ["depth", "up", "byte"])
        .groupBy("depth", "context")
        .agg(gain.alias("gain"))
        .where(F.col("gain") >= min_gain)
    )
    # A state, all that are above it, and the root.
    suffix = lambda k: F.struct(k.alias("depth"), F.col("context").bitwiseAND(F.element_at(ends, k)).alias("context"))
    ends = F.array(*[F.lit((1 << (8 * k)) - 1) for k in range(1, depth + 1)])
    states = gains.select(F.explode(F.transform(F.sequence(F.lit(1), "depth"), suffix)).alias("s")).select("s.*").distinct()
    tree = entries.join(common.merged(states), ["depth", "context"], "left_semi").unionByName(entries.where("depth = 0"))
    rows = tree.select("depth", "entry", "n", "total").toArrow()
    columns = {c: rows[c].to_numpy() for c in rows.column_names}
    levels: list[Level] = []
    for k in range(depth + 1):
        mine = columns["depth"] == k
        order = np.argsort(columns["entry"][mine].view(np.uint64))
        entry, n, all_n = (columns[c][mine][order] for c in ("entry", "n", "total"))
        entry = entry.view(np.uint64)
        if k:
            up = levels[k - 1]
            above = up.chances[np.searchsorted(up.entries, entry & np.uint64(masks[k - 1]))]
        else:
            above = np.full(len(entry), 1 / 256)
        chances = (n + smoothing * above) / (all_n + smoothing)
        contexts, first = np.unique(entry >> np.uint64(8), return_index=True)
        levels.append(Level(contexts, all_n[first].astype(float), entry, chances))
    return SuffixTree(levels, smoothing)


def _least_count(total: int, min_gain: float) -> int:
    """The least count of a context that can gain so much among that many bytes.

    No byte follows a context more often than the context above it, so n occurrences gain no more than n log(total / n).
    """
    counts = np.arange(1, min(1000, max(1, math.ceil(min_gain))) + 1)
    enough = np.flatnonzero(counts * np.log(np.maximum(total, 1) / counts) >= min_gain - 1e-6)
    return int(counts[enough[0]]) if len(enough) else 1


def _word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of distinct words by key, and the two parts of their keys in that order."""
    raw = b"".join([xxhash.xxh3_128_digest(w) for w in words])
    keys = np.frombuffer(raw, "<u8").reshape(-1, 2)
    low = (keys[:, 1] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((low, keys[:, 0]))
    return order, keys[order, 0], low[order]


def _sum_words(table: pa.Table) -> pa.Table:
    """For the blocks' words of one key range: the count of each in all blocks, and how many there are."""
    high = [np.frombuffer(x, np.uint64) for x in table["high"].to_pylist()]
    low = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
    n = np.concatenate([common.from_planes(x, np.int64) for x in table["n"].to_pylist()])
    sizes, high, low = [len(x) for x in high], np.concatenate(high), np.concatenate(low)
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
    sums = np.add.reduceat(n[order], np.flatnonzero(fresh))
    count = np.empty(len(n), np.int64)
    count[order] = sums[np.cumsum(fresh) - 1]
    parts, blocks, ends = table["part"].to_pylist(), table["block"].to_pylist(), np.cumsum(sizes)
    back = [common.planes(count[e - s : e]) for e, s in zip(ends, sizes)]
    # The totals of the range stand in its first row.
    words = [int((sums > 0).sum())] + [0] * (len(parts) - 1)
    tokens = [int(sums.sum())] + [0] * (len(parts) - 1)
    once = [int((sums == 1).sum())] + [0] * (len(parts) - 1)
    return _rows([(p, b, None, None, *x) for p, b, *x in zip(parts, blocks, back, words, tokens, once)])


def _rows(rows: list[tuple]) -> pa.Table:
    names = ("part", "block", "high", "low", "n", "words", "tokens", "once")
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 5,
    min_share: float = 0.0,
    min_gain: float = 20.0,
    smoothing: float = 20.0,
    discount: float = 0.9,
) -> DataFrame:
    """Score every text by the suffix tree and by word counts, both learned from rows where ``train`` holds.

    Returns id, ``is_train``, ``n_tokens`` (words and one end), ``n_known`` (tokens of the training texts),
    ``train_tokens``, ``base_score`` (sum of log10 of add-one unigram chances) and ``score`` (log10
    probability by the model) and ``spelled_score`` (log10 probability of the bytes by the tree alone). A
    token seen c times has the chance ``(1 - u) * (max(c - discount, 0) / N + discount * V / N * t)``, where t is the
    chance of its bytes by the tree and u = (words seen once + 1) / (N + 2), the chance of an unknown one. Letters A to Z are lower-cased; words part at ASCII blanks.

    A null text is empty: one token, the end. A null ``train`` counts as false. With no training text
    the tree gives every byte the same chance. Repeated rows are scored and counted each. Texts of any
    length are used whole. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("is_train"))
    blocks = common.block_number(rows, "text")
    table = common.blocked(rows, ["id", "text"], "block", blocks)
    tree = fit(table.where("is_train"), "text", depth, min_share, min_gain, smoothing)

    def send_words(part: pa.Table) -> pa.Table:
        read = [_as_read(x) for x in common.each_text(part["text"])]
        numbers, found = _token_numbers(b"".join(read))
        sizes = np.diff(np.flatnonzero(numbers == found.index(b"")), prepend=-1)
        learned = np.repeat(part["is_train"].to_numpy(), sizes)
        words = [i for i, word in enumerate(found) if word]
        order, high, low = _word_keys([found[i] for i in words])
        n = np.bincount(numbers[learned], minlength=len(found))[words][order]
        cuts, number = common.range_bounds(high, blocks), part["block"][0].as_py()
        out = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[p], cuts[p + 1])
            out.append((p, number, high[s].tobytes(), low[s].tobytes(), common.planes(n[s]), 0, 0, 0))
        return _rows(out)

    sums = table.groupBy("block").applyInArrow(send_words, _BLOB).groupBy("part").applyInArrow(_sum_words, _BLOB)
    sums = common.written(sums, "words")
    words, tokens, once = sums.agg(F.sum("words"), F.sum("tokens"), F.sum("once")).first()
    texts = table.where("is_train").count()
    n_train = (tokens or 0) + texts
    n_types = (words or 0) + (texts > 0)
    unseen = ((once or 0) + 1) / (n_train + 2)
    out_type = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("is_train", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("spelled_score", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(out_type)
    shipped = docs.sparkSession.sparkContext.broadcast([(x.contexts, x.totals, x.entries, x.chances) for x in tree.levels])

    def score(part: pa.Table, back: pa.Table) -> pa.Table:
        if not part.num_rows:
            return arrow.empty_table()
        read = [_as_read(x) for x in common.each_text(part["text"])]
        numbers, distinct = _token_numbers(b"".join(read))
        end = distinct.index(b"")
        words_here = np.flatnonzero(np.arange(len(distinct)) != end)
        order, _, _ = _word_keys([distinct[i] for i in words_here])
        found = sorted(zip(back["part"].to_pylist(), back["n"].to_pylist()))
        count = np.full(len(distinct), texts, np.int64)
        count[words_here[order]] = np.concatenate([np.empty(0, np.int64), *(common.from_planes(x, np.int64) for _, x in found)])
        seen = count[numbers].astype(float)
        sizes = np.diff(np.flatnonzero(numbers == end), prepend=-1)
        begins = np.cumsum(sizes) - sizes
        spelled = SuffixTree([Level(*x) for x in shipped.value], smoothing).token_scores(read)
        share = np.maximum(seen - discount, 0) / max(n_train, 1) + discount * n_types / max(n_train, 1) * 10**spelled
        scores = np.where(seen > 0, np.log10(np.maximum((1 - unseen) * share, 1e-300)), math.log10(unseen))
        per_text = lambda x: np.add.reduceat(x, begins)
        values = [
            part["id"],
            part["is_train"],
            sizes,
            per_text((seen > 0).astype(np.int64)),
            np.full(len(read), n_train),
            per_text(np.log10(seen + 1) - math.log10(n_train + n_types + 1)),
            per_text(scores),
            per_text(spelled),
        ]
        columns = [v if isinstance(v, pa.ChunkedArray) else pa.array(v, f.type) for v, f in zip(values, arrow)]
        return pa.table(columns, schema=arrow)

    return table.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, out_type)
