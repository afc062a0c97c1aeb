"""From raw documents to token ids: five stages, each one of the operators in ``runloom.llm``.

A stage takes what its predecessor kept and returns the columns of ``documents``; the last returns token ids.
Null and empty texts pass through as clean documents, of which the near-copy stage keeps one; rows without an id are rows like any
other, and repeated rows are near-copies of each other. Extra columns of ``documents`` stay, whatever their names. Texts of any
length go whole. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import common, contamination, pieces, simhash, substrings, toxicity
from runloom.llm.queries import piece_model

#: The stages have no SQL twin: fingerprints, automata and merges are not expressible in it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.in_fold(F.col("doc_id"), 5, 0)))
    score = common.free_name("toxicity", docs)
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-copies; repeated rows stay once."""
    return simhash.first_copies(docs, threshold=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has; texts that lose nothing stay as they are."""
    kept, words, removed = (common.free_name(n, docs) for n in ("kept_text", "words", "removed"))
    cut = substrings.remove_repeats(docs, kept_col=kept, words_col=words, removed_col=removed)
    cut = cut.withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage, whatever other rows of their id hold."""
    key = common.free_name("row_key", docs)
    # Two 64-bit hashes of id and text, so that a row goes for its own text only.
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn(key, F.concat_ws(" ", F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)))
    found = contamination.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    found_key = common.free_name("found_key", keyed)
    found = common.written(found.select(F.col(key).alias(found_key)).distinct(), "contaminated")
    return keyed.join(found, F.col(key) == F.col(found_key), "left_anti").drop(key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document in place of its text, and whether they decode to it; other columns stay."""
    ids, count, decoded = (common.free_name(n, docs) for n in ("ids", "n_tokens", "decoded"))
    encoded = pieces.encode_decode(docs, piece_model(), ids_col=ids, count_col=count, decoded_col=decoded)
    exact = F.coalesce(F.col("text"), F.lit("")) == F.col(decoded)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    return encoded.select(*rest, count, ids, exact.alias(common.free_name("round_trip", docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substrings", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
