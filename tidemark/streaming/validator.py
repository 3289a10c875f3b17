"""The validator as a stream: verdicts on each quote from keyed state, its export, and its restart from what was exported."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.cleaning import DAYS_KEPT, FENCE_LEAST, MAX_CHANGE_PCT, STATE_VERSION, Fence, exclusion
from tidemark.sources.store import exists, ship
from tidemark.streaming.events import place

ORDER = ["day", "order_id", "line_no", "fare"]
INPUT = "route_id int, horizon int, day date, order_id long, line_no int, fare double"
OUTPUT = "route_id int, horizon int, order_id long, line_no int, action string, reason string"
KEY = ["route_id", "horizon"]


class _Validator(StatefulProcessor):
    """State of a route and horizon: the clean line of its fence, the medians of its newest days, those days' fares, outliers withheld."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clean = handle.getListState("clean", "fare double")
        self.medians = handle.getMapState("medians", "day date", "median double")
        self.fares = handle.getMapState("fares", "day date", "fares array<double>")
        self.withheld = handle.getValueState("withheld", "n long")

    def handleInitialState(self, key, frame: pd.DataFrame, timers) -> None:
        for row in frame.itertuples(index=False):
            self.clean.put([(float(x),) for x in row.clean])
            for day in row.days:
                self.medians.updateValue((day["day"],), (float(day["median"]),))
                self.fares.updateValue((day["day"],), ([float(x) for x in day["fares"]],))
            self.withheld.update((int(row.withheld),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(ORDER, ignore_index=True)
        fence = Fence([x[0] for x in self.clean.get()] if self.clean.exists() else [])
        days = {k[0]: v[0] for k, v in self.medians.iterator()}
        fares, gone, withheld, told = {}, set(), 0, []
        for day, horizon, fare, excluded in zip(frame["day"], frame["horizon"], frame["fare"], frame["excluded"]):
            if not pd.isna(excluded):
                told.append(("excluded", excluded))
                continue
            flags, out = [], fence.judge(fare)
            if out:
                flags.append("iqr_high_outlier" if fare > fence._at(0.5) else "iqr_low_outlier")
                withheld += 1
            dated = not pd.isna(day)
            prior = days.get(max((d for d in days if d < day), default=None)) if dated else None
            if prior and 100 * abs(fare - prior) / prior > MAX_CHANGE_PCT:
                flags.append("daily_change_spike" if fare > prior else "daily_change_collapse")
            if horizon >= 30 and fare > 25000:
                flags.append("suspiciously_high_advance_fare")
            if horizon == 0 and fare < 1500:
                flags.append("suspiciously_low_same_day_fare")
            told.append(("flagged" if flags else "accepted", ",".join(flags)))
            if dated:
                self._record(day, fare, days, fares, gone)
        self.clean.put([(x,) for x in fence.line]) if fence.line else self.clean.clear()
        for day, line in fares.items():
            self.medians.updateValue((day,), (days[day],))
            self.fares.updateValue((day,), (line,))
        for day in gone:
            self.medians.removeKey((day,))
            self.fares.removeKey((day,))
        self.withheld.update(((self.withheld.get()[0] if self.withheld.exists() else 0) + withheld,))
        actions, reasons = zip(*told)
        yield frame[["route_id", "horizon", "order_id", "line_no"]].assign(action=actions, reason=reasons)

    def _record(self, day, fare: float, days: dict, fares: dict, gone: set) -> None:
        """Puts a fare, outliers too, among its day's; days beyond the newest DAYS_KEPT leave."""
        line = fares.get(day)
        if line is None:
            known = day in days
            line = fares[day] = sorted(self.fares.getValue((day,))[0]) if known else []
        bisect.insort(line, fare)
        n = len(line)
        days[day] = (line[(n - 1) // 2] + line[n // 2]) / 2
        gone.discard(day)
        if len(days) > DAYS_KEPT:
            oldest = min(days)
            del days[oldest]
            fares.pop(oldest, None)
            gone.add(oldest)

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession):
    """Queries that start inside keep their state in a store with column families, which this processor needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class ValidatorStream:
    """A stream of quote files in `path`, judged against keyed state; its checkpoint and verdicts lie beside them.

    A batch is what is new in the folder when run() is called; each quote is judged by the quotes of its
    route and horizon in earlier batches and before it in its own batch, by day and id. Late files are judged as they come.
    A task gets a key's rows of one batch and its state: FENCE_WINDOW clean fares, and the newest DAYS_KEPT days, of which
    only those that the batch touches are read with their fares. Earlier quotes are never read again. Quotes
    without a fare are excluded; those without a day are compared with no day and count for none; without a route or horizon they are a key of their own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, state: DataFrame | None = None):
        self.spark, self.state = spark, state
        self.path = path or place(spark, "validator")

    def add(self, quotes: DataFrame) -> None:
        quotes.select(*[F.col(c).cast(t) for c, t in (x.split() for x in INPUT.split(", "))]).write.mode("append").parquet(f"{self.path}/quotes")

    def run(self) -> int:
        """Judges what is new in the folder; returns the number of rows read."""
        rows = self.spark.readStream.schema(INPUT).parquet(f"{self.path}/quotes")
        told = rows.withColumn("excluded", F.when(F.isnan("fare"), "non_positive_fare").otherwise(exclusion(F.col("fare"))))
        initial = None if self.state is None else self.state.filter(F.col("version") == STATE_VERSION).drop("version").groupBy(*KEY)
        ship(self.spark)
        with _keyed_state(self.spark):
            found = told.groupBy(*KEY).transformWithStateInPandas(_Validator(), OUTPUT, "Append", "None", initial)
            writer = found.writeStream.option("checkpointLocation", f"{self.path}/state").outputMode("append").trigger(availableNow=True)
            query = writer.format("parquet").option("path", f"{self.path}/verdicts").start()
            query.awaitTermination()
        return sum(x["numInputRows"] for x in query.recentProgress)

    def verdicts(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/verdicts"):
            return self.spark.createDataFrame([], OUTPUT)
        return self.spark.read.schema(OUTPUT).parquet(f"{self.path}/verdicts")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "false").load(f"{self.path}/state").select(*[F.col("key")[k].alias(k) for k in KEY], "*")

    def export(self) -> DataFrame:
        """The state, a row a key, as ValidatorStream(state=...) takes it: version, `clean` (oldest first), `days` and `withheld`."""
        with _keyed_state(self.spark):
            clean = self._read("clean").select(*KEY, F.transform("list_value", lambda x: x["fare"]).alias("clean"))
            entries = lambda name, field: self._read(name).select(*KEY, F.explode("map_value").alias("_day", "_of")).select(*KEY, F.col("_day.day").alias("day"), F.col("_of")[field].alias(field))
            days = entries("medians", "median").join(entries("fares", "fares"), [*KEY, "day"]).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("day", "median", "fares"))).alias("days"))
            withheld = self._read("withheld").select(*KEY, F.col("value.n").alias("withheld"))
            # a row holds a key's state, which is bounded
            found = withheld.join(clean, KEY, "left").join(days, KEY, "left")
            none = F.array().cast("array<struct<day: date, median: double, fares: array<double>>>")
            return found.select(*KEY, F.lit(STATE_VERSION).alias("version"), F.coalesce("clean", F.array().cast("array<double>")).alias("clean"), F.coalesce("days", none).alias("days"), "withheld")


def in_waves(stream: ValidatorStream, waves: list[DataFrame]) -> ValidatorStream:
    """Adds one wave of files after the other and runs the stream over each, from its checkpoint."""
    for wave in waves:
        stream.add(wave)
        stream.run()
    return stream


def diagnostics(state: DataFrame) -> DataFrame:
    """One row on exported state: keys, those with enough values to judge by, days kept at most, outliers withheld."""
    return state.agg(
        F.count("*").alias("n_keys"), F.count_if(F.size("clean") >= FENCE_LEAST).alias("n_ready"), F.coalesce(F.max(F.size("days")), F.lit(0)).alias("most_days"), F.coalesce(F.sum("withheld"), F.lit(0)).alias("n_withheld")
    )
