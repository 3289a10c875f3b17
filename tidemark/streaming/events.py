"""Streams of events: windowed counts, quota counters, and the fence with state by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.cleaning import Fence
from tidemark.sources.store import exists, shared, ship

#: Rows of a key after which the fence is written again, so that late rows do not send it back to the key's start.
FENCE_EVERY = 100_000


def source(spark: SparkSession, sf_dir: str, files: int = 100) -> DataFrame:
    """The events table as a stream, `files` a batch; event times as instants, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def place(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


def drain(stream: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """Runs the stream over what is there now into Parquet, and reads that.

    Without a key, rows are written once they are final. With one, each batch writes the rows
    that it changed, and the last one of each key counts: results are there before the
    watermark has passed them. Either way the watermark ends late rows and state; a batch that
    runs again replaces its own files.
    """
    spark, at = stream.sparkSession, place(stream.sparkSession, name)
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if key is None:
        query = writer.format("parquet").outputMode("append").option("path", f"{at}/rows").start()
    else:
        write = lambda df, no: df.write.mode("overwrite").parquet(f"{at}/rows/batch={no}")
        query = writer.outputMode("update").foreachBatch(write).start()
    query.awaitTermination()
    if not exists(spark, f"{at}/rows"):
        return spark.createDataFrame([], stream.schema)
    if key is None:
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    rows = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in stream.dtypes)}, batch long").parquet(f"{at}/rows")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_row")).select("_row.*")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), "user_id", "n")


def _place_of(ts: str = "ts", event_id: str = "event_id") -> Column:
    """A row's place in its key's order. The place before all rows has false and nulls."""
    return F.struct(F.lit(True).alias("has"), F.col(ts).alias("ts"), F.col(event_id).alias("event_id"))


def _current(judged: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of judged that no later batch has judged again: those up to the least place where one began."""
    later = Window.partitionBy("_key").orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(F.col("_key").alias("_own"), F.col("batch").alias("_batch"), F.min("cut").over(later).alias("_later"))
    joined = judged.join(cuts, F.col("_key").eqNullSafe(F.col("_own")) & (F.col("batch") == F.col("_batch")))
    return joined.filter(F.col("_later").isNull() | (_place_of() <= F.col("_later"))).select(*judged.columns)


def _judge(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["event_id", "_key", "ts", "_value", "outlier", "line"]
        fence, last, count, at = Fence(), None, 0, None

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*last.columns[:4], pa.array([None], pa.bool_()), pa.array([list(fence.line)], pa.list_(pa.float64()))], names=names)

        for batch in batches:
            first, lines = batch.column("_first").to_pylist(), batch.column("_line")
            times, ids, values = batch.column("ts").cast(pa.int64()).to_pylist(), batch.column("event_id").to_pylist(), batch.column("_value").to_pylist()
            out = []
            for i, (new, *place, x) in enumerate(zip(first, times, ids, values)):
                if last is not None and (new or (count >= every and place != at)):
                    yield written()
                    count = 0
                if new:
                    fence, last, count = Fence(lines[i].as_py()), None, 0
                    continue
                out.append(fence.judge(x))
                last, at, count = batch.slice(i, 1), place, count + 1
            rows = batch.filter(pa.array([not x for x in first], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(out, pa.bool_()), pa.nulls(len(out), pa.list_(pa.float64()))], names=names)
        if last is not None:
            yield written()

    return run


def fenced(events: DataFrame, key: str = "event_type", value: str = "value", every: int = FENCE_EVERY) -> DataFrame:
    """Runs the stream over what is there now: verdicts on each value against the clean ones before it, as recursive_fence has them. Rows without a value are no outliers.

    Rows of a key are judged by time and id over all batches. A batch is written to a log; each
    of its keys starts at the last written fence before its earliest new row, and the logged
    rows from there on are judged (again, if the batch has rows from before earlier ones).
    Spark sorts them, and a task streams through them and holds one fence. Fences are written
    after every `every` rows and at the end of a key. Batches in the order of time judge each
    row once; one with a late row judges again what follows it. A batch that runs again after a
    restart overwrites its own files only.
    """
    spark, at = events.sparkSession, place(events.sparkSession, "fence")
    kinds = dict(events.dtypes)
    slim = f"event_id {kinds['event_id']}, _key {kinds[key]}, ts {kinds['ts']}, _value double"
    start = f"struct<has: boolean, ts: {kinds['ts']}, event_id: {kinds['event_id']}>"
    schemas = {"log": slim, "judged": f"{slim}, outlier boolean, line array<double>", "cuts": f"_key {kinds[key]}, cut {start}, line array<double>"}

    def table(name: str, last: int | None = None) -> DataFrame:
        found = spark.read.schema(f"{schemas[name]}, batch long").parquet(f"{at}/{name}")
        return found if last is None else found.filter(F.col("batch") <= last)

    def step(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/log/batch={no}")
        log = table("log", no)
        new = log.filter(F.col("batch") == no).groupBy("_key").agg(F.min(_place_of()).alias("_least"))
        none = F.struct(F.lit(False).alias("has"), F.lit(None).alias("ts"), F.lit(None).alias("event_id")).cast(start)
        if no:
            fences = _current(table("judged", no - 1).filter("line is not null"), table("cuts", no - 1))
            fences = fences.select(F.col("_key").alias("_own"), _place_of().alias("_at"), "line")
            found = new.join(fences, F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_at") < F.col("_least")), "left")
            cuts = found.groupBy("_key").agg(F.coalesce(F.max("_at"), none).alias("cut"), F.max_by("line", "_at").alias("line"))
        else:
            cuts = new.select("_key", none.alias("cut"), F.lit(None).cast("array<double>").alias("line"))
        cuts.write.mode("overwrite").parquet(f"{at}/cuts/batch={no}")
        cuts = table("cuts", no).filter(F.col("batch") == no)
        begin = cuts.select(F.col("cut.event_id").alias("event_id"), "_key", F.col("cut.ts").alias("ts"), F.lit(None).cast("double").alias("_value"), F.lit(True).alias("_first"), F.col("line").alias("_line"))
        after = cuts.select(F.col("_key").alias("_own"), "cut")
        again = log.join(after, F.col("_key").eqNullSafe(F.col("_own")) & (_place_of() > F.col("cut")))
        again = again.select("event_id", "_key", "ts", "_value", F.lit(False).alias("_first"), F.lit(None).cast("array<double>").alias("_line"))
        dealt = begin.unionByName(again).repartition("_key").sortWithinPartitions("_key", F.desc("_first"), "ts", "event_id", "_value")
        dealt.mapInArrow(_judge(every), schemas["judged"]).write.mode("overwrite").parquet(f"{at}/judged/batch={no}")

    ship(spark)
    rows = events.select("event_id", F.col(key).alias("_key"), "ts", F.col(value).cast("double").alias("_value"))
    rows.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    names = [F.col("event_id"), F.col("_key").alias(key), F.col("_value").alias(value), F.col("outlier")]
    if not exists(spark, f"{at}/judged"):  # no file, no batch
        return spark.createDataFrame([], schemas["judged"]).select(*names)
    return _current(table("judged").filter("line is null"), table("cuts")).select(*names)


def limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Batch admission by a trailing window where rejected events take no slot: each verdict depends on those before it.

    `retry_after`: whole seconds, one at least, until the oldest slot is free again; 0 for the admitted. A limit or window
    that is not positive admits nothing and says to come back in a minute. Rows are sorted by Spark; a task holds
    the admitted times of its current user, `limit` at most.
    """
    dealt = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        current, taken = None, deque()
        for frame in frames:
            out, waits = [], []
            for user, at in zip(frame["user_id"], frame["at"]):
                if user != current:
                    current, taken = user, deque()
                while taken and taken[0] <= at - seconds * 1_000_000:
                    taken.popleft()
                out.append(len(taken) < limit and seconds > 0)
                if out[-1]:
                    taken.append(at)
                waits.append(0 if out[-1] else 60 if limit <= 0 or seconds <= 0 else max(1, -((at - taken[0] - seconds * 1_000_000) // 1_000_000)))
            yield frame.assign(admitted=out, retry_after=waits)[["event_id", "user_id", "admitted", "retry_after"]]

    return dealt.mapInPandas(run, "event_id long, user_id long, admitted boolean, retry_after long")
