"""Exact, repeatable sampling, shuffling and splitting.

Rows are ordered by ``md5(seed:id)``. The first four hex digits cut that order
into 65,536 even buckets. Bucket counts give the position of every bucket, so a
cut-off needs the rows of one bucket only, and no step sorts all rows in one
task. Ids must be unique; ``add_row_ids`` makes some for data without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.columns import hash_key
from runloom.operators.grouped import per_group
from runloom.session import checkpointed

SEED = 42


def add_row_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Add unique ids, checkpointed so that a lost executor cannot renumber rows."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def add_row_index(df: DataFrame, name: str = "id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in reading order, without a shuffle.

    Spark's ids hold the partition above bit 33 and the row below it, so only the
    row count of each partition is needed: one row per partition.
    """
    ids = add_row_ids(df, "_place")
    partition = F.shiftright("_place", 33)
    earlier = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ids.groupBy(partition.alias("_partition"))
        .count()
        .select("_partition", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"))
    )
    row = F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    return (
        ids.withColumn("_partition", partition)
        .join(per_group(starts, ids.rdd.getNumPartitions()), "_partition")
        .withColumn(name, F.col("_start") + row)
        .drop("_place", "_partition", "_start")
    )


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, 4)


def _bucket_ends(keyed: DataFrame) -> DataFrame:
    """Rows up to the end of each bucket. At most 65,536 rows, so one task may hold them."""
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.groupBy(_bucket(F.col("_key")).alias("_bucket")).agg(F.count("*").alias("_rows"))
    return counts.withColumn("_upto", F.sum("_rows").over(running))


def _last_key(df: DataFrame, id_col: str, wanted: Column, seed: int) -> Column:
    """Scalar: the hash key of the last wanted row, null if no row is wanted.

    ``wanted`` is an expression over ``_total``, the number of rows.
    """
    keyed = df.select(hash_key(F.col(id_col), seed).alias("_key"))
    everything = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # One bucket at most holds the cut, hence a one-row broadcast.
    cut = (
        _bucket_ends(keyed)
        .withColumn("_total", F.sum("_rows").over(everything))
        .withColumn("_wanted", F.least(wanted, F.col("_total")))
        .filter((F.col("_wanted") > F.col("_upto") - F.col("_rows")) & (F.col("_wanted") <= F.col("_upto")))
        .select("_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_rank"))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    return (
        keyed.withColumn("_bucket", _bucket(F.col("_key")))
        .join(F.broadcast(cut), "_bucket")
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_rank"))
        .select(F.max("_key").alias("_key"))
        .scalar()
    )


def sample_exact(df: DataFrame, id_col: str, max_samples: int | None, seed: int = SEED) -> DataFrame:
    """Exactly ``max_samples`` rows without replacement; all rows if there are no more."""
    if not max_samples:
        return df
    last = _last_key(df, id_col, F.lit(max_samples), seed)
    return df.filter(hash_key(F.col(id_col), seed) <= last)


def head_sample(df: DataFrame, order: str, rows: int) -> DataFrame:
    """The first ``min(rows, n)`` rows by a column, whatever their number.

    Of rows with equal values at the cut any may be chosen, never more than are asked for.
    """
    return df.orderBy(order).limit(rows)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """All rows in a repeatable random order (a range sort)."""
    return df.orderBy(hash_key(F.col(id_col), seed))


def shuffle_positions(
    df: DataFrame, id_col: str, seed: int = SEED, name: str = "position"
) -> DataFrame:
    """Add the 1-based place of each row in the seeded order, ranking bucket by bucket."""
    keyed = df.withColumn("_key", hash_key(F.col(id_col), seed))
    starts = _bucket_ends(keyed.select("_key")).select(
        "_bucket", (F.col("_upto") - F.col("_rows")).alias("_start")
    )
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    return (
        keyed.withColumn("_bucket", _bucket(F.col("_key")))
        .withColumn("_inner", inner)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.col("_inner"))
        .drop("_key", "_bucket", "_inner", "_start")
    )


def _split(df: DataFrame, id_col: str, held_out: Column, seed: int) -> DataFrame:
    last = _last_key(df, id_col, held_out, seed)
    chosen = F.coalesce(hash_key(F.col(id_col), seed) <= last, F.lit(False))
    return df.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def split_exact_floor(
    df: DataFrame, id_col: str, fraction: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Tag the first ``floor(n * fraction)`` shuffled rows as validation, the rest as train."""
    return _split(df, id_col, F.floor(F.col("_total") * F.lit(float(fraction))), seed)


def split_library(
    df: DataFrame, id_col: str, fraction: float = 0.05, seed: int = SEED
) -> DataFrame:
    """As ``split_exact_floor``, with the held-out count rounded up."""
    return _split(df, id_col, F.ceil(F.col("_total") * F.lit(float(fraction))), seed)
