"""How filters interact: what each removes under every order in which they could be applied.

A document is only its failure mask: one bit per filter. With ``cost[mask, filter]`` 0 where the mask has the
filter and infinite elsewhere, and ``position[order, filter]`` the inverse permutation of an order, the min-plus
product ``min over filters of cost + position`` is the step at which that order removes documents of that mask.
So documents are counted by part and mask, combined before the shuffle, and everything else is scattered from
at most 2^filters weighted counts a part, whatever the number of documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm import common

#: What the filters of ``measured`` look for.
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders, and by failure mask and order the step that removes; beyond the last step: none does."""
    orders = np.array(list(itertools.permutations(range(filters))), np.int64).reshape(-1, filters)
    position = np.argsort(orders, axis=1) + 1
    has = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1
    cost = np.where(has, 0, filters + 1)
    return orders, (cost[:, None, :] + position[None]).min(axis=2, initial=filters + 1)


def _scattered(names: Sequence[str], weights: Sequence[str], part: str):
    """From the counts of a part's masks to one row per order and step."""
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, step = removal_steps(size)
        places = np.arange(len(orders)) * (size + 1)
        labels = ["".join(names[f] for f in order) for order in orders for _ in range(size)]
        steps = np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders))
        fails = (np.arange(1 << size)[:, None] >> np.arange(size)) & 1
        for batch in batches:
            for value, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                count = np.zeros((1 + len(weights), 1 << size), np.int64)
                for mask, *numbers in (tuple(m.values()) for m in masks):
                    count[:, mask] += numbers
                gone = np.zeros((1 + len(weights), len(orders) * (size + 1)), np.int64)
                for mask in np.flatnonzero(count[0]):
                    gone[:, places + step[mask] - 1] += count[:, [mask]]
                gone = gone.reshape(-1, len(orders), size + 1)[:, :, :size]
                removed = gone[0]
                kept = count[0].sum() - np.cumsum(removed, axis=1)
                share = np.zeros(size, np.int64)
                np.add.at(share, orders.ravel(), removed.ravel())
                columns = [
                    kept,
                    removed,
                    (count[0] @ fails)[orders] - removed,
                    count[0][1 << np.arange(size)][orders],
                    *gone[1:],
                    share[orders],
                ]
                arrays = [pa.array([value] * len(labels), pa.string()), pa.array(labels), pa.array(steps)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c.ravel()) for c in columns]], names=figures)

    figures = [part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails"]
    figures += [f"{w}_lost" for w in weights] + ["shapley"]
    return run, figures


def audit(flagged: DataFrame, filters: Sequence[str], part_col: str = "part", weights: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``flagged`` has a row per document, a boolean column per filter (true: the document fails it; null: it does not) and
    per weight (null: no). ``filter_order`` joins the filters' names. At its step a filter has ``kept`` documents left,
    ``removed`` some, found others ``redundant`` (failing it, removed before); ``unique_fails`` fail it alone,
    ``<weight>_lost`` are the removed ones with that weight, and ``shapley`` is what it removes over all orders.

    Orders are all permutations, so filters must be few (five have 120, eight 40,320). Other columns are ignored. A null
    part is the empty string. Repeated rows count each. An empty table gives an empty one.
    """
    mask = sum((F.coalesce(flagged[f], F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    rows = flagged.select(
        F.coalesce(flagged[part_col].cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        *[F.coalesce(flagged[w], F.lit(False)).cast("long").alias(f"w{i}") for i, w in enumerate(weights)],
    )
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(weights))]
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)
    # At most 2^filters entries a part.
    entry = F.struct("mask", "n", *[f"w{i}" for i in range(len(weights))])
    parts = counted.groupBy("part").agg(F.collect_list(entry).alias("masks"))
    run, figures = _scattered(list(filters), list(weights), part_col)
    kinds = [T.StringType(), T.StringType(), T.IntegerType(), *[T.LongType()] * (len(figures) - 3)]
    return parts.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(figures, kinds)]))


def failures(text: bytes) -> int:
    """The bits of the filters A to D that a text in UTF-8 fails, see ``measured``."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, CAPITALS))
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * capitals > 10 * points
    odd = len(text.translate(None, SYMBOLS)) < len(text)
    return few | same << 1 | loud << 2 | odd << 3


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Each row's ``id`` and ``part`` and whether it fails the filters ``A`` to ``E``.

    A: under 100 words. B: distinct words below 80 % of the words. C: capitals A-Z above 10 % of the code points.
    D: holds one of ``#$%&*|``. E: a row with a smaller id, anywhere in the table, has the same text. Words are
    what stands between ASCII blanks, case kept. A null text is an empty one. A null id comes after all others; rows
    without an id and repeated rows are no copies of each other. Texts are compared by 128-bit keys, whole, also very
    long ones. Extra columns are ignored. The figures are written to the shared folder, without the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            masks = pa.array([failures(t) for t in texts], pa.int32())
            keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<i8").reshape(-1, 2)
            arrays = [batch.column("id"), batch.column("part"), masks, pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "part", "mask", "k1", "k2"])

    given = docs.select(docs[id_col].alias("id"), docs[part_col].cast("string").alias("part"), docs[text_col].alias("text"))
    schema = T.StructType([*given.schema.fields[:2], *[T.StructField(n, k) for n, k in _FIGURES]])
    rows = common.written(given.mapInArrow(run, schema), "failures")
    # Most texts occur once and need no partner; of the others one smallest id each.
    least = rows.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copy = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    flags = [(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0).alias(f) for i, f in enumerate("ABCD")]
    return rows.join(least, ["k1", "k2"], "left").select("id", "part", *flags, copy.alias("E"))


_FIGURES = (("mask", T.IntegerType()), ("k1", T.LongType()), ("k2", T.LongType()))


def with_labels(flagged: DataFrame, labels: DataFrame, id_col: str, weights: dict[str, str]) -> DataFrame:
    """``flagged`` with a boolean column per weight: whether some label row of its ``id`` has a 1 in the named column.

    Rows without an id or labels have none. Rows without an id take no part in the join.
    """
    marks = [F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias(w) for w, c in weights.items()]
    of_id = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(*marks)
    flagged = common.written(flagged, "flagged")
    none = [F.lit(False).alias(w) for w in weights]
    joined = flagged.where("id IS NOT NULL").join(of_id, "id", "left")
    return joined.unionByName(flagged.where("id IS NULL").select("*", *none))
