"""Normalising, deduplicating and validating quotes."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import medians
from tidemark.sources.store import settle, ship

FARE_MIN, FARE_MAX, MAX_CHANGE_PCT = 500.0, 80000.0, 300.0
FENCE_K, FENCE_LEAST, FENCE_WINDOW = 3.0, 10, 500
STATE_VERSION, DAYS_KEPT = 2, 90
#: Rows of a block of a fence that keeps outliers.
BLOCK_ROWS = 1_000_000


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: cross-source dedupe. order must end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def source_rank(source: Column, priority: list[str]) -> Column:
    """Place in the priority list; sources that are not listed come last."""
    place = F.lit(len(priority))
    for i, name in enumerate(priority):
        place = F.when(source == name, i).otherwise(place)
    return place


def rule_flags(fare: Column, base: Column, taxes: Column, horizon: Column, estimated: Column) -> Column:
    """Flags that let a quote pass but mark it: component sums, tax shares, odd levels for the horizon."""
    share = taxes / F.nullif(fare, F.lit(0.0))
    told = base.isNotNull() & taxes.isNotNull() & ~estimated
    return F.array_compact(
        F.array(
            F.when(told & (F.abs(base + taxes - fare) > 1.0), "component_mismatch"),
            F.when(told & (share > 0.50), "high_tax_ratio"),
            F.when(told & (share < 0.05), "low_tax_ratio"),
            F.when((horizon >= 30) & (fare > 25000), "suspiciously_high_advance_fare"),
            F.when((horizon == 0) & (fare < 1500), "suspiciously_low_same_day_fare"),
        )
    )


def exclusion(fare: Column) -> Column:
    return F.when(fare.isNull() | (fare <= 0), "non_positive_fare").when(fare < FARE_MIN, "below_minimum_fare").when(fare > FARE_MAX, "above_maximum_fare")


def prior_day_medians(df: DataFrame, key: list[str], day: str, value: str) -> DataFrame:
    """Per key and day: the median, and that of the latest earlier day."""
    middle = medians(df, [*key, day], value)
    return middle.withColumn("prior_median", F.lag("median").over(Window.partitionBy(*key).orderBy(day)))


def change_flag(value: Column, prior: Column, limit: float = MAX_CHANGE_PCT) -> Column:
    """Where a value is more than `limit` per cent off the prior day's median: which way."""
    pct = 100 * F.abs(value - prior) / prior
    return F.when((prior > 0) & (pct > limit), F.concat(F.lit("daily_change_"), F.when(value > prior, "spike").otherwise("collapse")))


class Fence:
    """The last FENCE_WINDOW values, clean ones only unless told otherwise, sorted beside their order, and the verdict on the next one."""

    def __init__(self, clean: list[float] | None = None, keep_outliers: bool = False):
        self.keep_outliers = keep_outliers
        self.line = deque(clean or [], FENCE_WINDOW)
        self.sorted = sorted(self.line)

    def _at(self, p: float) -> float:
        at = p * (len(self.sorted) - 1)
        lo = int(at)
        hi = min(lo + 1, len(self.sorted) - 1)
        return self.sorted[lo] + (at - lo) * (self.sorted[hi] - self.sorted[lo])

    def judge(self, value: float | None) -> bool:
        """True for an outlier, which is withheld; other values join the line. No value is no outlier."""
        if value is None or value != value:
            return False
        out = False
        if len(self.sorted) >= FENCE_LEAST:
            q1, q3 = self._at(0.25), self._at(0.75)
            out = value < q1 - FENCE_K * (q3 - q1) or value > q3 + FENCE_K * (q3 - q1)
            if out and not self.keep_outliers:
                return True
        self.hold(value)
        return out

    def hold(self, value: float) -> None:
        if len(self.line) == FENCE_WINDOW:
            del self.sorted[bisect.bisect_left(self.sorted, self.line[0])]
        self.line.append(value)
        bisect.insort(self.sorted, value)


def _judged(seeds: DataFrame, columns: list[tuple[str, str]], key: list[str], order: list[str], value: str, keep_outliers: bool) -> DataFrame:
    """Rows without `_seed` judged in order after the key's seeds, which only fill its line."""
    dealt = seeds.repartition(*key).sortWithinPartitions(*key, F.col("_seed").asc_nulls_last(), *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fence = None, Fence(keep_outliers=keep_outliers)
        for frame in frames:
            past, out, fresh = [], [], frame.pop("_seed").isna().to_numpy()
            for own, x, new in zip(frame[key].itertuples(index=False, name=None), frame[value], fresh):
                if own != current:
                    current, fence = own, Fence(keep_outliers=keep_outliers)
                if not new:
                    fence.hold(x)
                    continue
                past.append(len(fence.line))
                out.append(fence.judge(x))
            yield frame[fresh].assign(n_past=past, outlier=out)

    ship(seeds.sparkSession)
    return dealt.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in columns) + ", n_past long, outlier boolean")


def windowed_fence(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """recursive_fence with keep_outliers, where a verdict needs no earlier one: a key's line is cut into blocks that are judged apart.

    Rows are dealt by range of key and order, BLOCK_ROWS a range about, and each block of a key in a range is
    given the FENCE_WINDOW values before it, from the blocks that hold them. A key of any size spreads over
    tasks. order must end in columns that tell rows apart; rows that it does not are in one range.
    """
    df = settle(df, "fence-rows")  # counted, sampled and dealt
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BLOCK_ROWS))
    dealt = df.repartitionByRange(ranges, *key, *order).sortWithinPartitions(*key, *order)
    rows = settle(dealt.withColumn("_range", F.spark_partition_id()), "fence-blocks")
    block = [*key, "_range"]
    known = F.col(value).isNotNull() & ~F.isnan(value)
    upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_range"))
    counts = settle(rows.groupBy(*block).agg(F.count(F.when(known, 1)).alias("_n")).withColumn("_upto", upto), "fence-counts")  # a row a block
    newest = F.row_number().over(Window.partitionBy(*block).orderBy(*[F.desc(c) for c in order]))
    ends = rows.filter(known).withColumn("_back", newest).filter(F.col("_back") <= FENCE_WINDOW).drop("_back")
    here = counts.select(*[F.col(c).alias(f"_own_{c}") for c in key], F.col("_range").alias("_to"), (F.col("_upto") - F.col("_n")).alias("_before"))
    same = [F.col(f"_own_{c}").eqNullSafe(F.col(c)) for c in key]
    # blocks whose values are not all pushed out by later ones before the block begins
    given = counts.join(here, [*same, F.col("_range") < F.col("_to"), F.col("_before") - F.col("_upto") < FENCE_WINDOW]).select(*block, "_to")
    pairs = given.select(*[F.col(c).alias(f"_own_{c}") for c in block], "_to")
    held = ends.join(pairs, [F.col(f"_own_{c}").eqNullSafe(F.col(c)) for c in block]).drop(*[f"_own_{c}" for c in block])
    seeds = held.drop("_range").withColumnRenamed("_to", "_range").withColumn("_seed", F.lit(0)).select(*rows.columns, "_seed")
    found = _judged(rows.withColumn("_seed", F.lit(None).cast("int")).unionByName(seeds), rows.dtypes, block, order, value, True)
    return found.drop("_range")


def recursive_fence(df: DataFrame, key: list[str], order: list[str], value: str, keep_outliers: bool = False, state: DataFrame | None = None) -> DataFrame:
    """df with `n_past` and `outlier`: each value against the last clean values of its key before it.

    Each verdict depends on those before it. With keep_outliers, outliers stay in later fences.
    Rows of a key are sorted by Spark and streamed through one pass; a task holds the fence of
    its current key, FENCE_WINDOW values, not the key's rows. Rows without a value are no
    outliers. A key is judged by one task. Fences start from `state` (see export_fences) where it
    has the key; state of another version is left out, and those fences start empty.
    """
    seeds = df.withColumn("_seed", F.lit(None).cast("int"))
    if state is not None:
        held = state.filter(F.col("version") == STATE_VERSION).select(*key, F.posexplode("held").alias("_seed", value))
        seeds = seeds.unionByName(held, allowMissingColumns=True)
    return _judged(seeds, df.dtypes, key, order, value, keep_outliers)


def export_fences(judged: DataFrame, key: list[str], order: list[str], value: str, state: DataFrame | None = None) -> DataFrame:
    """What the fences hold after `judged`, by key: version, `held` (the last clean values, oldest first) and `withheld` (outliers).

    state: the one that judged started from; keys without new rows keep theirs. A row of the
    result has FENCE_WINDOW values at most.
    """
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    told = judged.filter(f"not outlier and `{value}` is not null").withColumn("_back", newest).filter(F.col("_back") <= FENCE_WINDOW)
    line = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col(value).cast("double").alias("x")))), lambda r: r.x)
    found = judged.groupBy(*key).agg(F.count_if("outlier").alias("withheld")).join(told.groupBy(*key).agg(line.alias("held")), key, "left")
    empty = F.array().cast("array<double>")
    if state is not None:
        was = state.filter(F.col("version") == STATE_VERSION).select(*key, F.col("held").alias("_held"), F.col("withheld").alias("_withheld"))
        found = found.join(was, key, "full")
        line = F.concat(F.coalesce("_held", empty), F.coalesce("held", empty))
        kept = F.slice(line, F.greatest(F.size(line) - FENCE_WINDOW + 1, F.lit(1)), FENCE_WINDOW)
        found = found.select(*key, kept.alias("held"), (F.coalesce("_withheld", F.lit(0)) + F.coalesce("withheld", F.lit(0))).alias("withheld"))
    return found.select(*key, F.lit(STATE_VERSION).alias("version"), F.coalesce("held", empty).alias("held"), "withheld")


def diagnostics(state: DataFrame) -> DataFrame:
    """One row on exported fences: keys, those with enough values to judge by, and outliers withheld."""
    return state.agg(F.count("*").alias("n_keys"), F.count_if(F.size("held") >= FENCE_LEAST).alias("n_ready"), F.coalesce(F.sum("withheld"), F.lit(0)).alias("n_withheld"))


def newest_days(levels: DataFrame, key: list[str], day: str, most: int = DAYS_KEPT) -> DataFrame:
    """Daily reference levels of each key's newest `most` days."""
    age = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(day)))
    return levels.withColumn("_age", age).filter(F.col("_age") <= most).drop("_age")
