"""Removal of passages that an earlier document has, found by difference-cover anchors.

Hashing every window of a text moves more data than the text has. Here only windows
at positions of a difference cover modulo a period are hashed: of any two places that hold
the same long passage, some shift within the period is a cover position in both. So a
passage that repeats shares an aligned anchor, and only windows around anchors that occur
in two documents are extended to whole windows and compared.

Documents are dealt into blocks. A block sends each distinct key once, as a packed array,
and gets one bit per key back. A passage that a third of all documents hold is one key per
block, so no task gathers a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runloom.llm import common

#: Perfect difference sets by period.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}

#: Words whose places are judged in one step.
STEP = 1 << 18

_BLOB = "part int, block int, kind int, a binary, b binary, c binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors at least as long as itself, and its cover."""
    period = max(p for p in COVERS if p <= (window + 1) // 2)
    return period, COVERS[period]


class _Block:
    """The texts of one block as arrays of word keys, in order of their ids."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        ids = np.array([2**63 - 1 if x is None else x for x in table[id_col].to_pylist()], dtype=np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        # Words are many times as large as their text, so those of one text at a time are Python objects.
        self.texts = table[text_col].take(pa.array(self.order))
        keys, lengths = bytearray(), []
        for words in self.words():
            keys += common.word_keys(words).tobytes()
            lengths.append(len(words))
        self.lengths = np.array(lengths, dtype=np.int64)
        self.keys = np.frombuffer(keys, dtype="<u8").reshape(-1, 2)
        self.ends = np.cumsum(self.lengths)
        self.window = window
        self.period, self.cover = cover_for(window)
        self.anchor = window - self.period + 1
        self.doc_of = np.repeat(np.arange(len(ids)), self.lengths)

    def words(self) -> Iterator[list[bytes]]:
        """The words of each text in order."""
        return (text.split() for text in common.each_text(self.texts))

    def start_of(self, at: np.ndarray) -> np.ndarray:
        """Where the texts of these positions begin."""
        return (self.ends - self.lengths)[self.doc_of[at]]

    def end_of(self, at: np.ndarray) -> np.ndarray:
        return self.ends[self.doc_of[at]]

    def rolled(self, half: int, n: int) -> np.ndarray:
        """Keys of the n words from each position on."""
        column = self.keys[:, half]
        count = max(0, len(column) - n + 1)
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + column[i : i + count]
        return common.mixed(total)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of anchors by key, the number of their key, the keys, and whether two documents here share them."""
        rolled = self.rolled(0, self.anchor)
        at = np.concatenate([self._covered(begin, min(begin + STEP, len(rolled))) for begin in range(0, len(rolled), STEP)] or [np.empty(0, np.int64)])
        order = np.argsort(rolled[at], kind="stable")
        at, keys = at[order], rolled[at[order]]
        fresh = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        number = np.cumsum(fresh) - 1
        docs = self.doc_of[at]
        shared = np.zeros(int(fresh.sum()), bool)
        shared[number[1:][(docs[1:] != docs[:-1]) & ~fresh[1:]]] = True
        return at, number, keys[fresh], shared

    def _covered(self, begin: int, end: int) -> np.ndarray:
        """The positions in a range from which an anchor is hashed."""
        at = np.arange(begin, end)
        here = np.isin((at - self.start_of(at)) % self.period, self.cover)
        return at[here & (at + self.anchor <= self.end_of(at))]

    def candidates(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that hold a shared anchor by key, the number of their key, and its two halves."""
        at, number, _, shared = self.anchors()
        hit = at[(shared | flags)[number]]
        del at, number, shared
        first, last = self.start_of(hit), self.end_of(hit)
        marked = np.zeros(len(self.keys), bool)
        for shift in range(self.period):
            start = hit - shift
            inside = (start >= first) & (start + self.window <= last)
            marked[start[inside]] = True
        del hit, first, last
        starts = np.flatnonzero(marked)
        high = self.rolled(0, self.window)[starts]
        low = (self.rolled(1, self.window)[starts] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((low, high))
        starts, high, low = starts[order], high[order], low[order]
        fresh = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.empty(0, bool)
        return starts, np.cumsum(fresh) - 1, high[fresh], low[fresh]


def _flags(table: pa.Table, kind: int, cuts: np.ndarray) -> np.ndarray:
    """The bits that came back for the keys of a block, in their order."""
    flags = np.zeros(int(cuts[-1]), bool)
    rows = zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["a"].to_pylist())
    for _, part, bits in (r for r in rows if r[0] == kind):
        begin, end = cuts[part], cuts[part + 1]
        flags[begin:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - begin).astype(bool)
    return flags


def _blobs(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("part", "block", "kind", "a", "b", "c")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _shared_keys(table: pa.Table) -> pa.Table:
    """For the blocks' keys of one range: which keys come from two blocks."""
    blobs = [np.frombuffer(x, np.uint64) for x in table["a"].to_pylist()]
    keys = np.sort(np.concatenate(blobs))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    rows = []
    for part, block, blob in zip(table["part"].to_pylist(), table["block"].to_pylist(), blobs):
        found = np.isin(blob, twice, assume_unique=True) if len(twice) else np.zeros(len(blob), bool)
        rows.append((part, block, 1, np.packbits(found).tobytes(), None, None))
    return _blobs(rows)


def _earlier_keys(table: pa.Table) -> pa.Table:
    """For the blocks' windows of one range: which ones a smaller id elsewhere has."""
    high = [np.frombuffer(x, np.uint64) for x in table["a"].to_pylist()]
    low = [np.frombuffer(x, np.uint32) for x in table["b"].to_pylist()]
    ids = [common.from_planes(x, np.int64) for x in table["c"].to_pylist()]
    sizes = [len(x) for x in high]
    high, low, ids = np.concatenate(high), np.concatenate(low), np.concatenate(ids)
    order = np.lexsort((ids, low, high))
    h, w, i = high[order], low[order], ids[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
    least = i[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    earlier = np.empty(len(ids), bool)
    earlier[order] = i > least
    rows, begin = [], 0
    for part, block, size in zip(table["part"].to_pylist(), table["block"].to_pylist(), sizes):
        rows.append((part, block, 2, np.packbits(earlier[begin : begin + size]).tobytes(), None, None))
        begin += size
    return _blobs(rows)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    kept_col: str = "kept_text",
    words_col: str = "n_words",
    removed_col: str = "n_removed",
) -> DataFrame:
    """Each document with the words left that no earlier document's passage covers.

    A word goes if one of the windows of ``window`` words over it starts in a document with a
    smaller id too; windows are judged on the input. All columns stay; ``kept_col`` has the
    words that are left, joined by one space, and two columns count words and removed words.
    They replace columns of the same names.

    A null text has no words. A text below ``window`` words loses none. A null id counts as larger
    than every other, and equal ids are not smaller, so repeated rows keep the same words.
    An empty table gives an empty one. Very long texts are handled whole. Ids are integers.
    """
    block = common.free_name("block_of_rows", docs)
    blocks = common.block_number(docs, text_col)
    docs = docs.drop(kept_col, words_col, removed_col) if kept_col != text_col else docs.drop(words_col, removed_col)
    table = common.blocked(docs, [id_col, text_col], block, blocks)
    texts = table.select(block, id_col, text_col)

    def send_anchors(rows: pa.Table) -> pa.Table:
        _, _, keys, _ = _Block(rows, id_col, text_col, window).anchors()
        cuts, number = common.range_bounds(keys, blocks), rows[block][0].as_py()
        parts = np.flatnonzero(np.diff(cuts)).tolist()
        return _blobs([(p, number, 0, keys[cuts[p] : cuts[p + 1]].tobytes(), None, None) for p in parts])

    def send_windows(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _blobs([])
        own = _Block(rows, id_col, text_col, window)
        flags = _flags(back, 1, common.range_bounds(own.anchors()[2], blocks))
        starts, number, high, low = own.candidates(flags)
        ids = own.ids[own.doc_of[starts[np.searchsorted(number, np.arange(len(high)))]]]
        cuts, name = common.range_bounds(high, blocks), rows[block][0].as_py()
        return _blobs(
            [
                (p, name, 0, high[s].tobytes(), low[s].tobytes(), common.planes(ids[s]))
                for p in np.flatnonzero(np.diff(cuts)).tolist()
                for s in [slice(cuts[p], cuts[p + 1])]
            ]
        )

    columns = [c for c in docs.columns if c != kept_col]

    def cut(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return nothing
        own = _Block(rows, id_col, text_col, window)
        flags = _flags(back, 1, common.range_bounds(own.anchors()[2], blocks))
        starts, number, high, _ = own.candidates(flags)
        earlier = _flags(back, 2, common.range_bounds(high, blocks))
        ids = own.ids[own.doc_of[starts]]
        least = ids[np.searchsorted(number, np.arange(len(high)))]
        covered = starts[earlier[number] | (ids > least[number])]
        edge = np.zeros(len(own.keys) + 1, np.int64)
        np.add.at(edge, covered, 1)
        np.add.at(edge, covered + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        texts, removed = [], np.zeros(len(own.ids), np.int64)
        for i, words in enumerate(own.words()):
            begin, end = own.ends[i] - own.lengths[i], own.ends[i]
            out = gone[begin:end]
            removed[i] = out.sum()
            texts.append(b" ".join([w for w, g in zip(words, out.tolist()) if not g] if removed[i] else words))
        result = rows.select(columns).take(pa.array(own.order))
        added = {kept_col: pa.array(texts, pa.binary()).cast(pa.string()), words_col: pa.array(own.lengths), removed_col: pa.array(removed)}
        for name, values in added.items():
            result = result.append_column(name, values)
        return result

    by_block = lambda df: df.groupBy(block)
    named = lambda df: df.withColumn(block, F.col("block"))
    anchors = by_block(texts).applyInArrow(send_anchors, _BLOB)
    shared = common.written(anchors.groupBy("part").applyInArrow(_shared_keys, _BLOB), "shared")
    windows = by_block(texts).cogroup(by_block(named(shared))).applyInArrow(send_windows, _BLOB)
    earlier = common.written(windows.groupBy("part").applyInArrow(_earlier_keys, _BLOB), "earlier")
    schema = T.StructType(
        [docs.schema[c] for c in columns]
        + [T.StructField(kept_col, T.StringType()), T.StructField(words_col, T.LongType()), T.StructField(removed_col, T.LongType())]
    )
    nothing = to_arrow_schema(schema).empty_table()
    return by_block(table).cogroup(by_block(named(shared.unionByName(earlier)))).applyInArrow(cut, schema)
