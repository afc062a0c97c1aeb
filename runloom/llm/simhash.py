"""Near-copies by SimHash, found with covering locality-sensitive hashing.

Every bit of the fingerprint gets a vector of radius + 1 bits. A table belongs to each nonzero
vector v and keeps the bits whose vector has an odd product with v. The vectors of at most
``radius`` differing bits span less than the whole space, so some v is orthogonal to all of them:
in that table the pair agrees. No pair within the radius is missed.

``first_copies`` is the general mode: near-copies by the exact similarity of word shingles. Fingerprints connect the nearest ones;
the others differ by more bits than any covering can reach and are found by shared rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm import common, jaccard_join
from runloom.llm.components import components

#: Fingerprints of one table's bucket that one task compares; larger buckets are dealt out in pairs of blocks.
BUCKET_BLOCK = 2048

#: Like ``BUCKET_BLOCK``, for texts whose shingles are compared.
SET_BLOCK = 2048


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    of = xxhash.xxh64_intdigest
    spans = zip(starts[:count].tolist(), last.tolist())
    hashes = np.array([of(joined[a:b], seed) for a, b in spans], dtype=">u8")
    set_bits = np.zeros(64, np.int64)
    for begin in range(0, count, 1 << 16):  # bounds what a very long text takes
        bits = np.unpackbits(hashes[begin : begin + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > count).view(">u8")[0])


def fingerprints(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Each document's SimHash as a signed 64-bit number; null and empty texts have zero."""
    carried = [f for f in docs.schema if f.name != text_col]
    schema = T.StructType([*carried, T.StructField(out_col, T.LongType())])
    text = common.free_name("text_to_hash", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x) for x in common.as_bytes(batch.column(text))], np.uint64).view(np.int64)
            kept = [batch.column(f.name) for f in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values)], names=[*[f.name for f in carried], out_col])

    return docs.withColumnRenamed(text_col, text).mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask per nonzero vector of ``radius + 1`` bits; the bits' vectors are dealt in turn."""
    vectors = (1 << (radius + 1)) - 1
    of_bit = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(of_bit[i] & v).count("1") % 2) for v in range(1, vectors + 1)]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(radius: int):
    """Edges that join the near fingerprints of one bucket or pair of blocks: at most one less than there are."""

    def run(table: pa.Table) -> pa.Table:
        points = np.unique(table["fp"].to_numpy()).view(np.uint64)
        rest, edges = points, []
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                pivot = front.pop()
                near = np.bitwise_count(rest ^ pivot) <= radius
                found = rest[near]
                edges.extend((int(pivot), int(x)) for x in found)
                front.extend(found)
                rest = rest[~near]
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

    return run


def links(points: DataFrame, radius: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect every two fingerprints within ``radius`` of each other.

    First each bucket's fingerprints are compared with its smallest one; that joins a dense group of
    near-copies in time proportional to its size. Buckets whose members are then all connected need
    no more. In the others every pair is compared, block by block, and only a spanning forest
    is returned, never all pairs.
    """
    masks = covering_masks(radius)
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
    buckets = points.select("fp", tables.alias("table", "key"))
    heads = buckets.groupBy("table", "key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    full = common.written(buckets.join(common.merged(heads), ["table", "key"]), "buckets")
    near = (F.col("fp") != F.col("head")) & (_distance(F.col("fp"), F.col("head")) <= radius)
    stars = common.written(full.where(near).select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct(), "stars")
    label = components(stars, "a", "b")
    named = full.join(common.merged(label.withColumnRenamed("node", "fp")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = common.written(named.select("table", "key", "fp", "label"), "labels")
    open_buckets = (
        named.groupBy("table", "key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
        .where("low < high")
    )
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks").cast("int") - 1),
            lambda other: F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j")),
        )
    )
    dealt = (
        named.join(common.merged(open_buckets), ["table", "key"])
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .select("table", "key", "fp", pairs.alias("pair"))
    )
    rest = dealt.groupBy("table", "key", "pair").applyInArrow(_forest(radius), "a long, b long")
    return stars.unionByName(rest)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    fingerprint_col: str = "fingerprint",
    component_col: str = "component_id",
) -> DataFrame:
    """Each document's fingerprint and the smallest id it is linked to, itself included.

    Fingerprints link at ``radius`` or fewer differing bits. The result has the id and
    two new columns, one row per input row. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows share a component. A component of null ids alone has a null
    component. An empty table gives an empty one. Equal fingerprints are one point, so
    thousands of copies cost no more than one text.
    """
    hashed = fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp")
    hashed = common.written(hashed, "fingerprints")
    points = hashed.groupBy("fp").agg(F.min("id").alias("least"))
    label = components(common.written(links(points.select("fp"), radius), "links"), "a", "b").withColumnRenamed("node", "fp")
    label = points.join(common.merged(label), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = label.groupBy("label").agg(F.min("least").alias("component"))
    of_point = label.join(common.merged(least), "label").select("fp", "component")
    return hashed.join(common.merged(of_point), "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(fingerprint_col),
        F.col("component").alias(component_col),
    )


def _fingerprint_pairs(points: DataFrame, radius: int) -> DataFrame:
    """Pairs ``a``, ``b`` of points that connect all whose fingerprints lie within the radius."""
    heads = common.written(points.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = points.join(common.merged(heads), "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"]
    near = links(heads.select("fp"), radius).join(common.merged(ends[0]), "a").join(common.merged(ends[1]), "b")
    near = near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return common.written(same.unionByName(near), "near")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each group, the row with the smallest id.

    Two texts are near-copies if their distinct 5-word shingles (ASCII letters in lower case, words between ASCII blanks)
    have a Jaccard similarity of ``threshold`` or more, taken in percent; groups are what such pairs connect. Fingerprints within ``radius``
    bits are the first candidates, each verified by the whole sets. At a similarity of 0.8 about nine bits differ, which no
    covering reaches, so pairs that are not connected then are found by shared rare shingles, exactly, see ``jaccard_join``. A
    text below five words has copies of equal words only. Null and empty texts are copies of each other.

    Rows are judged one by one: by id and text, so rows of one id with different texts, and rows without an id, are
    rows like any other. A null id comes after all others; then the text's hash decides. Repeated rows stay once.
    All columns stay, whatever their names. An empty table gives an empty one. Texts of any length are compared whole.
    """
    size, percent = 5, round(100 * threshold)
    texts = jaccard_join.marked(docs, id_col, text_col)
    rows = jaccard_join.described(texts, size, percent, fingerprints=True)
    points = jaccard_join.points_of(rows, prefixes=False)
    known = jaccard_join.verified_links(_fingerprint_pairs(points.where("n > 0"), radius), points, texts, size, percent)
    found = jaccard_join.links_between(points, texts, size, percent, known, SET_BLOCK, jaccard_join.prefixes_of(rows))
    label = components(found, "a", "b").withColumnRenamed("node", "id")
    named = points.select("k1", "k2", "id").join(common.merged(label), "id", "left").select("k1", "k2", F.coalesce("label", "id").alias("label"))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark", "second")
    first = rows.select("doc", "mark", "second", "k1", "k2").join(common.merged(named), ["k1", "k2"]).groupBy("label").agg(F.min(order).alias("o"))
    # One column names a row, so the rows are dealt out once, for the join and for dropping repeated ones.
    row, wanted = (common.free_name(n, docs) for n in ("row_key", "wanted_key"))
    first = common.written(first.select(_row_key("o.doc", "o.mark", "o.second").alias(wanted)), "first")
    keyed = docs.withColumn(row, _row_key(id_col, F.xxhash64(text_col), F.xxhash64(F.lit("second"), F.col(text_col))))
    return keyed.join(common.merged(first), F.col(row) == F.col(wanted), "left_semi").dropDuplicates([row]).drop(row)


def _row_key(doc: str, mark: Column | str, second: Column | str) -> Column:
    """The id, empty for none, and the hashes of the text, as one string."""
    return F.concat_ws(" ", F.coalesce(F.col(doc).cast("string"), F.lit("")), mark, second)
