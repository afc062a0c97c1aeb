"""Bounded queues of experts: which assignments stay, found by counting instead of sorting.

An expert keeps the best assignments of a batch up to its capacity. So a queue needs one number: its last assignment that stays.
Counts by level of the logit, combined before the shuffle, name the level that holds it and how many lie above; only the assignments
of that level are carried and ranked. The cuts, one small map per layer and batch, are joined to the rows. The
assignments themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.grouped import GROUP_ROWS, join_on, per_group, row_positions
from runloom.session import written

BATCH = ("layer", "batch_id")
QUEUE = (*BATCH, "expert_id")
#: Levels per unit of the logit, and where they end. Scaling by a power of two and rounding down never changes the order.
LEVELS, LAST_LEVEL = 32, 2.0**40


def _unknown(logit: Column) -> Column:
    return logit.isNull() | F.isnan(logit)


def queue_key(logit: Column, token: Column) -> Column:
    """Orders a queue: higher logits first, then lower token ids; a logit that is null or no number comes last."""
    return F.struct(_unknown(logit).alias("none"), (-logit).alias("minus"), token.alias("token_id"))


def _level(logit: Column) -> Column:
    held = F.greatest(F.lit(-LAST_LEVEL), F.least(F.lit(LAST_LEVEL), logit * LEVELS))
    return F.when(_unknown(logit), F.lit(int(-2 * LAST_LEVEL))).otherwise(F.floor(held))


def queue_cuts(
    assigned: DataFrame, capacity_factor: float, sizes: DataFrame | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``cuts`` per layer and batch: by expert, the key of the last assignment that stays; experts that drop none are absent.

    ``assigned`` has a row per assignment. ``sizes`` has the ``_tokens`` of each batch; without it first choices are
    counted. The result is written, since it is read once for its size and once for its rows.
    """
    leveled = assigned.select(*QUEUE, "token_id", "logit", "choice", "num_experts", _level(F.col("logit")).alias("_level"))
    counted = leveled.groupBy(*QUEUE, "_level").agg(
        F.count("*").alias("_n"), F.count_if(F.col("choice") == 0).alias("_first"), F.max("num_experts").alias("_experts")
    )
    if sizes is None:
        counted = counted.withColumn("_tokens", F.sum("_first").over(Window.partitionBy(*BATCH)))
    else:
        counted = join_on(counted, sizes, BATCH)
    capacity = F.ceil(F.lit(float(capacity_factor)) * F.col("_tokens") / F.col("_experts"))
    queue = Window.partitionBy(*QUEUE)
    running = F.sum("_n").over(queue.orderBy(F.desc("_level")))
    wanted = F.col("_capacity") - F.col("_upto") + F.col("_n")
    levels = (
        counted.withColumns({"_capacity": capacity, "_upto": running, "_all": F.sum("_n").over(queue)})
        .where("_all > _capacity AND _upto >= _capacity AND _upto - _n < _capacity")
        .select(*QUEUE, "_level", wanted.alias("_wanted"), "_n")
    )
    levels = written(levels, "levels")
    number, largest = levels.agg(F.count("*"), F.max("_n")).first()
    near = join_on(leveled.select(*QUEUE, "_level", "token_id", "logit"), per_group(levels.drop("_n"), number), [*QUEUE, "_level"])
    ranked = near.withColumn("_key", queue_key(F.col("logit"), F.col("token_id")))
    ranked = row_positions(ranked, QUEUE, ["_key"], "_place", group_rows, largest or 0).where("_place = _wanted")
    entries = F.map_from_entries(F.collect_list(F.struct("expert_id", "_key")))
    return written(ranked.groupBy(*BATCH).agg(entries.alias("cuts")), "cuts")


def stays(cuts: Column, expert: Column, key: Column) -> Column:
    """Whether an assignment is not behind the cut of its queue."""
    return F.coalesce(key <= F.element_at(cuts, expert), F.lit(True))


def capacity_marks(
    assigned: DataFrame, capacity_factor: float, sizes: DataFrame | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Assignments, one row each, with ``kept``."""
    cuts = queue_cuts(assigned, capacity_factor, sizes, group_rows)
    marked = join_on(assigned, per_group(cuts, cuts.count()), BATCH, "left")
    return marked.withColumn("kept", stays(F.col("cuts"), F.col("expert_id"), queue_key(F.col("logit"), F.col("token_id")))).drop("cuts")
