"""Conversations formatted as a forest, in which shared beginnings stand once.

A node is a turn after one particular beginning; conversations that begin alike share its nodes.
A tree's nodes are emitted depth first in one token sequence, so each shared token stands once.
A node has the place of its tokens in that sequence, the position ids of its tokens (as they run on
from its ancestors) and the intervals of the sequence that its tokens may attend to: its ancestors and itself.
Ancestors that stand next to each other in the sequence make one interval.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm import common

#: The strings that the template uses, which no text may hold unescaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    """A text in which no control string stands; ``unescape`` gives it back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def template(role: str, text: str) -> tuple[str, str, str]:
    """A turn: what stands before its text, the text, what stands after it."""
    return f"<s>[INST] {escape(role)} [/INST]\n", escape(text), "</s>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level vocabulary from a file of ranks."""
    if path not in _encodings:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


_encodings: dict[str, tiktoken.Encoding] = {}

#: Tokens that a worker holds before it hands rows on.
BATCH_TOKENS = 200_000

_TURNS = (
    "conv long, depth int, node string, parent string, root string, nodes array<string>,"
    "tokens array<int>, loss_begin int, loss_end int, position long"
)


def _turns(path: str, pattern: str, learned: str):
    names = ("conv", "depth", "node", "parent", "root", "nodes", "tokens", "loss_begin", "loss_end", "position")
    kinds = (pa.int64(), pa.int32(), *[pa.string()] * 3, pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, rows, size = encoding(path, pattern), [], 0
        for batch in batches:
            for conv, chat in zip(batch.column("conv").to_pylist(), batch.column("chat").to_pylist()):
                chain, position = [], 0
                for depth, turn in enumerate(chat):
                    role, text = turn["role"] or "", turn["text"] or ""
                    above = chain[-1] if chain else ""
                    chain.append(hashlib.sha256(f"{above}\n{len(role)}\n{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()[:32])
                    parts = [code.encode_ordinary(p) for p in template(role, text)]
                    begin = len(parts[0])
                    end = begin + len(parts[1]) if role == learned else begin
                    tokens = parts[0] + parts[1] + parts[2]
                    # The last turn has the path of the conversation, so paths are as long as the chats.
                    path_here = chain if depth + 1 == len(chat) else None
                    rows.append((conv, depth, chain[-1], above, chain[0], path_here, tokens, begin, end, position))
                    position += len(tokens)
                    size += len(tokens)
                    if size >= BATCH_TOKENS:
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)

    return run


def format_forest(
    turns: DataFrame,
    ranks: str,
    pattern: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: str = "assistant",
) -> tuple[DataFrame, DataFrame]:
    """The nodes of all trees, and which leaf each conversation ends in.

    Nodes: ``node``, ``parent`` (empty for a root), ``root``, ``depth``, ``tokens``, ``loss_begin`` and ``loss_end`` (the tokens
    of the text of a ``learned`` turn; equal for others), ``offset`` in the tree's sequence, ``position`` of the first
    token, and ``attention``: intervals of the sequence in order, those of the ancestors, joined where they adjoin, then the
    node's own. Conversations: ``conv``, ``leaf`` and ``nodes``, the path from root to leaf.

    Paths are sorted by ranges over many tasks; a node belongs to the first path that holds it, so the nodes of one path that no
    earlier path has are a segment, emitted without a gap. Only segments are given places and compared with those
    above them: a chat of n turns costs n rows, and a node has one interval for each branching above it.

    Turns are ordered by ``turn``, then role and text. A null text or role is empty, a null turn comes first, rows of a
    null id are one conversation, repeated rows are turns of their own. Equal conversations share a
    leaf. Empty tables give empty ones. A hot first turn is one node, however many
    conversations hold it.
    """
    chat = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))))
    chats = turns.groupBy(F.col(conv_col).alias("conv")).agg(chat.alias("chat"))
    rows = common.written(chats.mapInArrow(_turns(ranks, pattern, learned), _TURNS), "turns")
    leaves = rows.where("nodes IS NOT NULL").select("conv", F.col("node").alias("leaf"), "nodes")
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = leaves.select("leaf", "nodes").dropDuplicates(["leaf"]).repartitionByRange(spread, "nodes")
    # The number follows the order of the paths: the range above bit 33, the place in it below.
    paths = paths.sortWithinPartitions("nodes").select(F.monotonically_increasing_id().alias("rank"), "nodes")
    members = common.written(paths, "paths").select("rank", F.explode("nodes").alias("node"))
    first = members.groupBy("node").agg(F.min("rank").alias("rank"))
    # Rows of one node are alike but for the conversation.
    nodes = rows.drop("conv", "nodes").dropDuplicates(["node"]).withColumn("n", F.size("tokens"))
    owned = common.written(nodes.join(first, "node"), "owned")
    end = F.max(F.col("position") + F.col("n"))
    segments = owned.groupBy("root", "rank").agg(F.min("position").alias("first"), (end - F.min("position")).alias("size"))
    segments = common.written(segments.withColumn("range", F.shiftright("rank", 33)), "segments")
    sums = segments.groupBy("root", "range").agg(F.sum("size").alias("n"))  # as many rows as there are ranges, for a hot root
    before = F.coalesce(F.sum("n").over(W.partitionBy("root").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("root", "range", before.alias("before"))
    own = F.coalesce(F.sum("size").over(W.partitionBy("root", "range").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = segments.withColumn("own", own).join(sums, ["root", "range"])
    starts = starts.select("rank", "first", (F.col("before") + F.col("own")).alias("start"))
    # A segment's nodes follow each other, so their places in it are those in the conversation.
    placed = owned.join(starts, "rank").withColumn("offset", F.col("start") + F.col("position") - F.col("first"))
    placed = common.written(placed.drop("first"), "placed")
    ends = placed.select("node", F.col("rank").alias("owner"), "offset", (F.col("offset") + F.col("n")).alias("end"))
    above = members.join(ends, "node").where("owner <> rank").groupBy("rank", "owner").agg(F.min("offset").alias("begin"), F.max("end").alias("end"))
    above = above.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("above"))
    stops = (F.col("start"), F.col("offset"), F.col("offset") + F.col("n"))
    here = F.array(*[F.struct(a.alias("begin"), b.alias("end")) for a, b in zip(stops, stops[1:])])
    attention = F.concat(
        F.coalesce("above", F.array().cast("array<struct<begin:bigint,end:bigint>>")), F.filter(here, lambda s: s["begin"] < s["end"])
    )
    forest = placed.join(above, "rank", "left").withColumn("attention", attention)
    return forest.drop("rank", "start", "n", "above"), leaves


def _read(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(path, pattern)
        names = ("conv", "n_turns", "turns", "loss", "formatted_chars")
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv", "parts", "covered"))
            for conv, parts, covered in zip(*columns):
                if covered != sum(len(p["tokens"]) for p in parts):
                    raise ValueError("the attention of a leaf does not cover its conversation")
                text = code.decode_bytes([t for p in parts for t in p["tokens"]]).decode()
                said = [code.decode_bytes(p["tokens"][p["loss_begin"] : p["loss_end"]]).decode() for p in parts]
                chat = parse(text)
                turns = "".join(f"{r}\n{t}\n" for r, t in chat)
                out.append((conv, len(chat), turns, "".join(map(unescape, said)), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def read_back(forest: DataFrame, leaves: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Each conversation as the nodes of its path give it, in the order of the sequence: turns, loss text, formatted length.

    Fails if the attention intervals of a leaf do not cover just the tokens of its path.
    """
    # Equal conversations are read once.
    paths = leaves.select("leaf", "nodes").dropDuplicates(["leaf"]).select("leaf", F.explode("nodes").alias("node"))
    parts = paths.join(forest.select("node", "offset", "tokens", "loss_begin", "loss_end"), "node").groupBy("leaf")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("offset", "tokens", "loss_begin", "loss_end"))).alias("parts"))
    covered = F.aggregate("attention", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    ends = forest.select(F.col("node").alias("leaf"), covered.alias("covered"))
    texts = parts.join(ends, "leaf").select(F.monotonically_increasing_id().alias("conv"), "leaf", "parts", "covered")
    texts = common.written(texts, "parts")
    read = texts.select("conv", "parts", "covered").mapInArrow(
        _read(ranks, pattern), "conv long, n_turns long, turns string, loss string, formatted_chars long"
    )
    ends = leaves.select("conv", "leaf").join(texts.select("conv", "leaf").withColumnRenamed("conv", "key"), "leaf")
    return ends.join(read.withColumnRenamed("conv", "key"), "key").drop("key", "leaf")
