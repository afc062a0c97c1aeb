"""Encoding with a SentencePiece vocabulary of the merge type, and decoding.

A text becomes symbols; an agenda of adjacent pairs, ordered by score and then by place,
always merges the best pair that is a piece. Pieces never run across the start of a
word, so a text falls into segments that are encoded apart, and a worker keeps the ids
of segments it has seen. New segments are merged together as arrays, each by its own agenda and
one pair in a step; long ones go one by one. Each newly encoded segment is compared with the
sentencepiece library, batch by batch.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runloom.llm import common

#: Fixed value: how a vocabulary writes a blank.
BLANK = "▁"

#: Segments longer than this are encoded anew each time.
CACHED_CHARACTERS = 64
#: Segments that a worker keeps of late; when they are as many, those not seen since the last time go.
CACHED_SEGMENTS = 100_000
#: Texts that are encoded at once.
SLICE_ROWS = 250
#: Symbols up to which the agenda is a list, or a row of an array.
SHORT = 24
#: Segments that are merged together.
MERGED_ROWS = 10_000


class Pieces:
    """A vocabulary, its agenda and the segments seen so far."""

    def __init__(self, model: str):
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        special = lambda i: library.is_control(i) or library.is_unknown(i) or library.is_byte(i)
        names = [library.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if not special(i)}
        self.ranks = {p: -library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = self.bytes if all(library.is_byte(i) for i in self.bytes) else None
        self.unknown = library.unk_id()
        across = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.segments = re.compile("(?s:.+)" if across else f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self._number_symbols(size)
        if library.normalize("x y") != f"{BLANK}x{BLANK}y":
            raise ValueError("a vocabulary that marks blanks and adds one in front is needed")

    def merge(self, segment: str) -> list[int]:
        """The ids of one segment, by the agenda."""
        symbols: list[str] = list(segment)
        if len(symbols) <= SHORT:
            self._merge_short(symbols)
        else:
            self._merge_long(symbols)
        return self._ids_of(symbols)

    def _ids_of(self, symbols: list[str]) -> list[int]:
        """The ids of merged symbols, empty ones left out; what is no piece becomes its bytes or unknown."""
        out: list[int] = []
        for symbol in symbols:
            if not symbol:
                continue
            number = self.ids.get(symbol)
            if number is not None:
                out.append(number)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _merge_short(self, symbols: list[str]) -> None:
        """The agenda of a few symbols is the list of their pairs' ranks; the first of the least is next."""
        rank, none = self.ranks.get, float("inf")
        agenda = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            least = min(agenda)
            if least == none:
                return
            i = agenda.index(least)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], none)

    def _number_symbols(self, size: int) -> None:
        """Numbers for what ``merge_short_ones`` works on: pieces have their ids, other characters and padding come behind."""
        extra = sorted({c for p in self.ids for c in p} - self.ids.keys())
        numbers = self.ids | {c: size + i for i, c in enumerate(extra)}
        self.size, self.other, self.padding = size, size + len(extra), size + len(extra) + 1
        self.number_of = np.full(0x110000, self.other, np.int64)
        for c, i in numbers.items():
            if len(c) == 1:
                self.number_of[ord(c)] = i
        halves = ((numbers.get(p[:i]), numbers.get(p[i:]), n) for p, n in self.ids.items() for i in range(1, len(p)))
        pairs = sorted((a << 32 | b, n) for a, b, n in halves if a is not None and b is not None)
        # The last one is never asked for.
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_ids = np.array([n for _, n in pairs] + [-1], np.int64)
        # No piece has the number -1, the last one.
        self.rank_of = np.full(size + 1, np.inf)
        self.length_of = [1] * self.padding
        for p, i in self.ids.items():
            self.rank_of[i], self.length_of[i] = self.ranks[p], len(p)

    def _merged_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the pieces that pairs of symbols make, -1 for none."""
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def merge_short_ones(self, segments: list[str]) -> list[bytes]:
        """The packed ids of segments of at most ``SHORT`` symbols, as ``merge`` gives them."""
        out: list[bytes] = [b""] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        for begin in range(0, len(order), MERGED_ROWS):
            places = order[begin : begin + MERGED_ROWS]
            for row, symbols in self._merged_rows([segments[i] for i in places]):
                used = symbols != self.padding
                whole = np.all((symbols < self.size) | ~used, axis=1)
                ends = np.cumsum(used.sum(axis=1)) * 4
                packed = symbols[used].astype(np.int32).tobytes()
                for r, known, a, b in zip(row.tolist(), whole.tolist(), [0, *ends.tolist()], ends.tolist()):
                    out[places[r]] = packed[a:b] if known else self._spelled(segments[places[r]], packed[a:b])
        return out

    def _spelled(self, segment: str, packed: bytes) -> bytes:
        """The packed ids of a segment whose symbols are not all pieces."""
        ends = list(accumulate(map(self.length_of.__getitem__, memoryview(packed).cast("i"))))
        return array("i", self._ids_of([segment[a:b] for a, b in zip([0, *ends], ends)])).tobytes()

    def _merged_rows(self, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of segments and, one row each, their symbols when no pair of them is a piece."""
        lengths = np.array([len(s) for s in segments])
        symbols = np.full((len(segments), max(lengths)), self.padding)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols[np.arange(symbols.shape[1]) < lengths[:, None]] = self.number_of[points]
        place = np.arange(len(segments))
        pairs = self._merged_pairs(symbols[:, :-1], symbols[:, 1:])
        while pairs.size:
            ranks = self.rank_of[pairs]
            at = ranks.argmin(axis=1)  # the first of the least
            going = np.take_along_axis(ranks, at[:, None], axis=1)[:, 0] < np.inf
            if not going.all():
                yield place[~going], symbols[~going]
                place, symbols, pairs, at = place[going], symbols[going], pairs[going], at[going]
            rows, width = np.arange(len(at)), symbols.shape[1] - 1
            symbols[rows, at] = pairs[rows, at]
            rest = np.ones(symbols.shape, bool)
            rest[rows, at + 1] = False
            symbols = symbols[rest].reshape(len(at), width)
            rest = np.ones(pairs.shape, bool)
            rest[rows, at] = False
            pairs = pairs[rest].reshape(len(at), width - 1)
            for beside in (at - 1, at):
                there = np.flatnonzero((beside >= 0) & (beside < width - 1))
                left = beside[there]
                pairs[there, left] = self._merged_pairs(symbols[there, left], symbols[there, left + 1])
        if len(place):
            yield place, symbols

    def _merge_long(self, symbols: list[str]) -> None:
        """The agenda as a heap; symbols merged away become empty."""
        n, ranks = len(symbols), self.ranks
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            rank = ranks.get(pair)
            if rank is not None:
                agenda.append((rank, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = right[i]
            # A symbol merged away is empty; a pair counts only if both its halves still stand.
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                wider = pair + symbols[k]
                rank = ranks.get(wider)
                if rank is not None:
                    heapq.heappush(agenda, (rank, i, wider))
            h = left[i]
            if h >= 0:
                wider = symbols[h] + pair
                rank = ranks.get(wider)
                if rank is not None:
                    heapq.heappush(agenda, (rank, h, wider))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers, checked against the library."""
        cut = [self.segments(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.seen) > CACHED_SEGMENTS:
            self.seen, self.before = {}, self.seen
        known, before = self.seen, self.before
        missing = [p for p in set().union(*cut) if p not in known]
        known.update((p, before[p]) for p in missing if p in before)
        fresh = [p for p in missing if p not in before]
        short = [p for p in fresh if len(p) <= SHORT]
        long = [p for p in fresh if len(p) > SHORT]
        packed = self.merge_short_ones(short) + [array("i", self.merge(p)).tobytes() for p in long]
        self._compare(short + long, packed)
        known.update(zip(short + long, packed))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for part in long:
            if len(part) > CACHED_CHARACTERS:
                del known[part]
        return out

    def _compare(self, segments: list[str], packed: list[bytes]) -> None:
        """An error if the library has other ids for a segment."""
        # It gives nothing for an empty text, which here is the blank in front alone.
        own = {p: x for p, x in zip(segments, packed) if len(p) > 1}
        wanted = self.library.encode([p[1:].replace(BLANK, " ") for p in own], num_threads=1) if own else []
        flat = np.fromiter(chain.from_iterable(wanted), np.int32)
        same = [4 * len(x) for x in wanted] == [len(x) for x in own.values()]
        if not same or flat.tobytes() != b"".join(own.values()):
            part = next(p for (p, x), ids in zip(own.items(), wanted) if array("i", ids).tobytes() != x)
            raise ValueError(f"ids of {part[:80]!r} differ from the library's")


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encode_decode(
    docs: DataFrame,
    model: str,
    text_col: str = "text",
    ids_col: str = "ids",
    count_col: str = "n_tokens",
    decoded_col: str = "decoded",
) -> DataFrame:
    """The ids of each text, how many there are, and the text decoded from them.

    No begin or end ids, no sampling. ``model`` is the path of the vocabulary file on every
    executor. A null or empty text has no ids and decodes to the empty text. Texts of any length
    are encoded whole; rows keep all other columns, and the three new ones replace columns of
    the same names. Repeated rows stay; an empty table gives an empty one.
    """
    docs = docs.drop(*{ids_col, count_col, decoded_col} - {text_col})
    hidden = common.free_name("text_to_encode", docs)
    new = {ids_col: T.ArrayType(T.IntegerType(), False), count_col: T.LongType(), decoded_col: T.StringType()}
    carried = [c for c in docs.columns if c not in new]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(n, t) for n, t in new.items()])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        own = pieces(model)
        for batch in batches:
            # Small slices bound what a batch of very long texts takes.
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                packed = own.encode([x or "" for x in part.column(hidden).to_pylist()])
                arrays = [np.frombuffer(x, np.int32) for x in packed]
                sizes = np.array([len(a) for a in arrays], np.int64)
                decoded = [own.library.decode(a.tolist()) if len(a) else "" for a in arrays]
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                values = {ids_col: ids, count_col: pa.array(sizes), decoded_col: pa.array(decoded, pa.string())}
                columns = [values[f.name] if f.name in values else part.column(f.name) for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.withColumn(hidden, F.col(text_col)).mapInArrow(run, schema)
