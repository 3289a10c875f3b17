"""Sinks: partition replacement, publication with a revision log, and reviews applied on reading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fares import redact_url


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes df so that each partition that it has rows for is replaced whole, and others stay: idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written in the folder that the cluster shares (spark.checkpoint.dir) and read again: what several steps need is computed once."""
    spark = df.sparkSession
    path = f"{shared(spark)}/settled/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what settle has written for this application. Results that read it must have been written or collected."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared(spark)}/settled/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns last, each computed once a row: what comes later, filters too, is not rewritten with their expressions in place of their names."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def shared(spark: SparkSession) -> str:
    """The shared folder; a local one if none is set, which is an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file://" + os.path.join(tempfile.gettempdir(), "tidemark")).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver knows its folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def revisions(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What differs between old and new, null-safe on keys: keys, previous value, new value, kind (withdrawal: new lacks the row)."""
    was = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_was"), F.lit(True).alias("_known"))
    now = new.select(*keys, F.col(value).alias("_now"), F.lit(True).alias("_told"))
    both = now.join(was, [now[k].eqNullSafe(was[f"_{k}"]) for k in keys], "full")
    kind = F.when(F.col("_known").isNull(), "initial_publication").when(F.col("_told").isNull(), "withdrawal").otherwise("recomputation")
    changed = both.filter(F.col("_known").isNull() | F.col("_told").isNull() | ~F.col("_was").eqNullSafe(F.col("_now")))
    own = [F.when(F.col("_told").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return changed.select(*own, F.col("_was").alias("previous"), F.col("_now").alias("new"), kind.alias("kind"))


def publish(new: DataFrame, path: str, log: str, keys: list[str], value: str, partition: str, why: str | None = None) -> None:
    """Stores new rows by partition and logs what changed, appeared or vanished in the partitions that new has.

    why: the kind that changed values are logged with in place of "recomputation", such as "late_data".

    The log's batch is a hash of the changes and a partition of it: the same publication again,
    or one that runs again after it failed between the two writes, replaces its own batch. The
    same rows over a finished publication log nothing.
    """
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    old = old.join(new.select(partition).distinct(), partition, "left_semi")
    changed = revisions(old, new, keys, value)
    if why is not None:
        changed = changed.replace("recomputation", why, subset=["kind"])
    mark = changed.agg(F.sum(F.xxhash64(*changed.columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    if mark.n:
        batch = f"{int(mark.h) & (1 << 64) - 1:016x}"
        logged = changed.withColumn("at", F.current_timestamp()).withColumn("batch", F.lit(batch))
        logged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)
    replace_partitions(new, path, [partition])


def snapshot_once(df: DataFrame, path: str, version_col: str) -> None:
    """Appends the rows of versions that the store does not have yet."""
    spark = df.sparkSession
    fresh = df.join(spark.read.parquet(path).select(version_col).distinct(), version_col, "left_anti") if exists(spark, path) else df
    fresh.write.mode("append").parquet(path)


def with_reviews(observations: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Observations with the latest review of each: one found wrong is not valid."""
    last = reviews.groupBy(key).agg(F.max_by("verdict", "reviewed_at").alias("verdict"))
    return observations.join(last, key, "left").withColumn("is_valid", F.col("is_valid") & ~F.coalesce(F.col("verdict") == "error", F.lit(False)))


def review_revisions(observations: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """A revision for each observation that was valid until its latest review found it wrong: what indices that used it are to be made again."""
    wrong = reviews.groupBy(key).agg(F.max_by("verdict", "reviewed_at").alias("verdict")).filter("verdict = 'error'")
    return observations.filter("is_valid").join(wrong, key, "left_semi").withColumn("revision", F.lit("anomaly_review"))


def recomputed(rows: DataFrame, late: DataFrame, by: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute over all rows of those values of `by` that late rows have: the partitions to publish again."""
    return compute(rows.unionByName(late).join(late.select(by).distinct(), by, "left_semi"))


def register(known: DataFrame | None, told: DataFrame, key: str, at: str) -> DataFrame:
    """The sources known after another registration: the latest fields of each, `first_seen` and `last_updated`.

    known: what an earlier call gave, or None. Sources that are told no more stay, disabled ones too.
    """
    fields = [c for c in told.columns if c not in (key, at)]
    every = told.select(key, *fields, F.col(at).alias("first_seen"), F.col(at).alias("last_updated"))
    every = every if known is None else known.unionByName(every)
    latest = F.max_by(F.struct(*fields), F.struct("last_updated", *fields)).alias("_row")
    return every.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_updated").alias("last_updated"), latest).select(key, "_row.*", "first_seen", "last_updated")


def publish_quotes(quotes: DataFrame, name: str, partition: str, keys: list[str], buckets: int) -> DataFrame:
    """Stores quotes as table `name` in the shared folder, partitioned by a column and bucketed and sorted by keys, and reads it.

    Scans skip the partitions that a filter, or a join with a small table of them, leaves out; joins and
    groups on the keys need no shuffle. Each bucket is written by one task: a file a partition and bucket.
    """
    spark = quotes.sparkSession
    dealt = quotes.repartition(buckets, *keys).sortWithinPartitions(partition, *keys)
    dealt.write.mode("overwrite").option("path", f"{shared(spark)}/tables/{name}").partitionBy(partition).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def upsert(df: DataFrame, path: str, key: str, at: str) -> DataFrame:
    """The latest row of each key over the store and df. save_latest replaces the store by it."""
    spark = df.sparkSession
    every = spark.read.parquet(path).unionByName(df) if exists(spark, path) else df
    return every.groupBy(key).agg(F.max_by(F.struct(*df.columns), at).alias("_row")).select("_row.*")


def save_latest(df: DataFrame, path: str, key: str, at: str) -> None:
    """The store brought up to date: what upsert gives is written apart first, as it reads the store that it replaces."""
    settle(upsert(df, path, key, at), "latest").write.mode("overwrite").parquet(path)


def persist_run(judged: DataFrame, path: str, run_id: str) -> None:
    """A run's tables: all observations, their verdicts, those that an index may use, and the flagged ones as anomalies.

    judged: observations with `excluded` (a reason, or null) and `flags`. It is written once and
    read for the other tables; each table's rows of this run are replaced, so that a run may be
    written again.
    """
    spark = judged.sparkSession
    replace_partitions(judged.withColumn("run_id", F.lit(run_id)), f"{path}/observations", ["run_id"])
    of_run = spark.read.parquet(f"{path}/observations").filter(F.col("run_id") == run_id)
    action = F.when(F.col("excluded").isNotNull(), "excluded").when(F.size("flags") > 0, "flagged").otherwise("accepted")
    key = [c for c in judged.columns if c not in ("excluded", "flags")]
    replace_partitions(of_run.withColumn("action", action).drop(*[c for c in key if c not in ("order_id", "line_no")]), f"{path}/validation", ["run_id"])
    replace_partitions(of_run.filter("excluded is null").drop("excluded", "flags"), f"{path}/normalized", ["run_id"])
    flagged = of_run.filter("excluded is null and size(flags) > 0").withColumn("kind", F.explode("flags"))
    replace_partitions(flagged.withColumn("status", F.lit("open")).drop("excluded", "flags"), f"{path}/anomalies", ["run_id"])


def captures(pages: DataFrame, url: Column, html_col: str) -> DataFrame:
    """Pages with redacted `url` and the hash of their content: the name under which a capture is stored once."""
    return pages.withColumn("url", redact_url(url)).withColumn("sha256", F.sha2(F.col(html_col).cast("binary"), 256)).withColumn("bucket", F.substring("sha256", 1, 2))


def store_captures(pages: DataFrame, path: str, url: Column, html_col: str) -> None:
    """Appends captures that the store does not have, compressed, by the first digits of their hash."""
    spark, found = pages.sparkSession, captures(pages, url, html_col).dropDuplicates(["sha256"])
    if exists(spark, path):
        found = found.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    found.write.mode("append").option("compression", "gzip").partitionBy("bucket").parquet(path)
