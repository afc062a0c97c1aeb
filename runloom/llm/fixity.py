"""Fixity audit of WARC files by Merkle trees.

A leaf is the hash of one record with its place. The tree above it follows offsets: a node covers
an aligned range of bytes, its parent a range 16 times as wide, and the root the file. A node's hash
is that of its children's hashes in order. Two replicas are compared from the roots down; only children
of differing nodes are looked at, so an audit of sound files reads their roots alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm import common

#: Bits of the offset that one range of the lowest level covers, bits that each level adds, levels below the root.
LEAF_BITS, FANOUT_BITS, LEVELS = 16, 4, 6

#: Files that records of pages without an id are spread over.
SPREAD = 256

#: Fixed value: what parts the header of a record from its block, and records from each other.
LINE = "\r\n"


def response_record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record; a null address or payload is empty."""
    payload, url = F.coalesce(payload, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: response{LINE}WARC-Target-URI: "),
        url,
        F.lit(f"{LINE}Content-Type: text/html{LINE}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(LINE + LINE),
    )
    return F.concat(head, payload, F.lit(LINE + LINE)).cast("binary")


def _file_of(page: Column, per_file: int, *others: Column) -> Column:
    """The file of a page; pages without an id are spread over files of their own."""
    none = F.format_string("none-%03d.warc", F.pmod(F.xxhash64(*others), F.lit(SPREAD)))
    return F.when(page.isNotNull(), F.format_string("%08d.warc", F.floor(page / per_file))).otherwise(none)


def _offsets(rows: DataFrame, *order: str) -> DataFrame:
    """Where each record begins: after the sizes of those before it in its file."""
    before = W.partitionBy("file").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def layout(pages: DataFrame, id_col: str, url_col: str, payload_col: str, per_file: int = 1000) -> DataFrame:
    """Pages as records of WARC files: ``file``, ``offset``, ``record``, its ``size`` and the page's id.

    A file holds the pages of ``per_file`` ids in a row, in order of their ids; rows of equal id follow each other by
    the record's bytes. Rows with a null id are spread over files of their own. Null addresses and payloads are empty, other
    columns are ignored; records of any length are whole.
    """
    rows = pages.select(
        F.col(id_col).alias("page"),
        _file_of(F.col(id_col), per_file, F.col(url_col), F.col(payload_col)).alias("file"),
        response_record(F.col(url_col), F.col(payload_col)).alias("record"),
    )
    return _offsets(rows.withColumn("size", F.octet_length("record").cast("long")), "page", "record")


def placed_leaves(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, per_file: int = 1000, changes: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """The leaves of ``layout`` without its records: ``page``, ``file``, ``offset``, ``size`` and ``hash``.

    Records are hashed where they are read, so no record is shuffled to find its place. Each of the ``changes`` adds the hash of
    the record so changed, under its name. Rows of equal id follow each other by their hash.
    """
    record = response_record(F.col(url_col), F.col(payload_col))
    hashes = {"hash": record} | {name: change(record) for name, change in (changes or {}).items()}
    rows = pages.select(
        F.col(id_col).alias("page"),
        _file_of(F.col(id_col), per_file, F.col(url_col), F.col(payload_col)).alias("file"),
        F.octet_length(record).cast("long").alias("size"),
        *[F.sha2(x, 256).alias(name) for name, x in hashes.items()],
    )
    return _offsets(rows, "page", "hash")


def leaves(records: DataFrame, file_col: str = "file", offset_col: str = "offset", record_col: str = "record") -> DataFrame:
    """One leaf per record: its file, offset, size and hash. A repeated row is the same leaf; a null record is empty."""
    record = F.coalesce(F.col(record_col), F.lit("").cast("binary"))
    return records.select(
        F.coalesce(F.col(file_col), F.lit("")).alias("file"),
        F.coalesce(F.col(offset_col), F.lit(0)).cast("long").alias("offset"),
        F.octet_length(record).cast("long").alias("size"),
        F.sha2(record, 256).alias("hash"),
    ).distinct()


def tree(leaf_rows: DataFrame) -> DataFrame:
    """All nodes of all files: ``file``, ``level``, ``node``, ``hash``; level 0 are ranges of leaves, the last is the root."""
    placed = F.struct("offset", F.concat(F.col("offset").cast("string"), F.lit(":"), "hash").alias("hash"))
    level = leaf_rows.groupBy("file", F.shiftright("offset", LEAF_BITS).alias("node")).agg(F.sort_array(F.collect_list(placed)).alias("c"))
    joined = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x["hash"]), ","), 256)
    level = level.select("file", F.lit(0).alias("level"), "node", joined(F.col("c")).alias("hash"))
    nodes = level
    for number in range(1, LEVELS + 1):
        up = F.shiftright("node", FANOUT_BITS) if number < LEVELS else F.lit(0).cast("long")
        child = F.struct("node", F.concat(F.col("node").cast("string"), F.lit(":"), "hash").alias("hash"))
        level = level.groupBy("file", up.alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        level = level.select("file", F.lit(number).alias("level"), F.col("up").alias("node"), joined(F.col("c")).alias("hash"))
        nodes = nodes.unionByName(level)
    return nodes


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """The records in which two replicas differ, given as leaves.

    Columns: ``file``, ``offset``, ``kind`` (changed, missing on the right, extra on the right), sizes and hashes of
    both sides, and both roots. A file that one side lacks has all its records listed. Equal replicas and
    empty tables give an empty result.
    """
    left, right = common.written(left, "leaves"), common.written(right, "leaves")
    sides = [common.written(tree(x), "tree") for x in (left, right)]
    a, b = (x.withColumnRenamed("hash", f"{n}_hash") for x, n in zip(sides, ("left", "right")))

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        """Nodes of a level that differ, looked for below the differing nodes of the level above."""
        x, y = a.where(F.col("level") == level), b.where(F.col("level") == level)
        if within is not None:
            up = F.shiftright("node", FANOUT_BITS) if level + 1 < LEVELS else F.lit(0).cast("long")
            x, y = (s.withColumn("up", up).join(within, ["file", "up"], "left_semi").drop("up") for s in (x, y))
        both = x.join(y, ["file", "level", "node"], "full_outer")
        return both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))

    roots = common.written(differing(LEVELS, None).select("file", F.col("left_hash").alias("left_root"), F.col("right_hash").alias("right_root")), "roots")
    within = roots.select("file", F.lit(0).cast("long").alias("up"))
    for level in range(LEVELS - 1, -1, -1):
        # Both sides use the ranges; unwritten, each level would double the plan.
        within = common.written(differing(level, within).select("file", F.col("node").alias("up")), "ranges")
    rows = [
        s.withColumn("up", F.shiftright("offset", LEAF_BITS)).join(within, ["file", "up"], "left_semi").select(
            "file", "offset", F.col("size").alias(f"{n}_size"), F.col("hash").alias(f"{n}_hash")
        )
        for s, n in ((left, "left"), (right, "right"))
    ]
    found = rows[0].join(rows[1], ["file", "offset"], "full_outer")
    found = found.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    kind = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    return found.withColumn("kind", kind).join(roots, "file")
