"""Summaries that stay up to date while runs go on.

The summary tables need the last points of each series only. A stream of new log points keeps those, a bounded number per series, in
a table that every micro-batch replaces by a new version; the summary is made from it whenever it is wanted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from runloom.operators.series import TAIL_POINTS
from runloom.operators.summary import newest_points

SCHEMA = "run STRING, tag STRING, step BIGINT, value DOUBLE"


class TailLog:
    """The last points of each series in a folder, one version per micro-batch.

    A micro-batch that is run again, after a failure, starts from the version before it and replaces its own, so no point counts twice.
    Points may come in any order of steps; a step that comes again is a point of its own. A folder belongs to one stream.
    """

    def __init__(self, spark: SparkSession, folder: str, points: int = TAIL_POINTS):
        self.spark, self.folder, self.points = spark, folder.rstrip("/"), points

    def _versions(self) -> DataFrame:
        versions = self.spark.read.schema(f"{SCHEMA}, batch BIGINT").option("basePath", self.folder)
        try:
            return versions.parquet(self.folder)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{SCHEMA}, batch BIGINT")

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest of the micro-batches before one."""
        versions = self._versions()
        if before is not None:
            versions = versions.where(F.col("batch") < before)
        # The folders' names tell the versions; only the newest is read.
        newest = versions.agg(F.max("batch")).first()[0]
        return versions.where(F.col("batch") == F.lit(newest)).drop("batch")

    def update(self, points: DataFrame, batch: int) -> None:
        """Take in the points of one micro-batch."""
        new = points.select("run", "tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
        merged = newest_points(self.read(before=batch).unionByName(new), self.points).drop("_newest")
        merged.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def follow(self, stream: DataFrame) -> DataStreamWriter:
        """A writer that keeps this log up to date with a stream of points; the caller sets trigger and checkpoint and starts it."""
        return stream.writeStream.foreachBatch(self.update)
