"""Late data: each batch of observations has the dates that it touches recomputed, replaced and logged, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import exists, replace_partitions, revisions
from tidemark.streaming.events import place


class LateStream:
    """Published figures that follow their observations, however late those come.

    Files of observations are added to a folder; run() takes what is new as one batch. A batch is stored by
    `partition` (a column of observations and figures, such as the month); the partitions that it has rows of are computed again
    from all stored observations of those partitions, which is all that is read. What
    changes by that is logged, and the partitions are replaced.

    Each step may run again: a batch's observations and log overwrite their own files, and the log
    is complete before figures change, so that a step that failed on the way finds the log and only finishes the
    replacement. Figures that were published before are logged as `late_data`.
    """

    def __init__(self, spark: SparkSession, schema: str, partition: str, keys: list[str], value: str, compute: Callable[[DataFrame], DataFrame]):
        self.spark, self.schema, self.partition, self.keys, self.value, self.compute = spark, schema, partition, keys, value, compute
        self.path = place(spark, "late")

    def add(self, observations: DataFrame) -> None:
        names = self.spark.createDataFrame([], self.schema).columns
        observations.select(*names).write.mode("append").parquet(f"{self.path}/arrived")

    def run(self) -> None:
        rows = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/arrived")
        rows.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.step).trigger(availableNow=True).start().awaitTermination()

    def _stored(self, last: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/observations").filter(F.col("batch") <= last)

    def step(self, batch: DataFrame, no: int) -> None:
        own = batch.withColumn("batch", F.lit(no).cast("long"))
        replace_partitions(own, f"{self.path}/observations", ["batch", self.partition])
        stored = self._stored(no)
        # the partitions of one batch; the join prunes the files of all others
        touched = stored.filter(F.col("batch") == no).select(self.partition).distinct()
        figures = self.compute(stored.join(F.broadcast(touched), self.partition, "left_semi").drop("batch"))
        at, log = f"{self.path}/figures", f"{self.path}/log/batch={no}"
        if not exists(self.spark, f"{log}/_SUCCESS"):
            old = self.spark.read.schema(figures.schema).parquet(at) if exists(self.spark, at) else figures.limit(0)
            changed = revisions(old.join(F.broadcast(touched), self.partition, "left_semi"), figures, self.keys, self.value)
            changed.replace("recomputation", "late_data", subset=["kind"]).write.mode("overwrite").parquet(log)
        replace_partitions(figures, at, [self.partition])

    def figures(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/figures")

    def log(self) -> DataFrame:
        """What each batch changed: keys, previous, new, kind and batch."""
        return self.spark.read.parquet(f"{self.path}/log")
