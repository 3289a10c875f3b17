"""Streams against the batch operators, over several files."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cleaning import recursive_fence
from tidemark.streaming import events as ev


@pytest.mark.parametrize("files, every", [(1, 7), (3, 1000), (100, 50)])
def test_fence_is_that_of_the_batch(spark, tmp_path, files, every):
    r = random.Random(11)
    rows = []
    for i in range(900):
        kind = r.choice(["hot"] * 6 + ["b", "c", None])
        rows.append((i, kind, i // 2 + r.choice([0, 0, 0, 40]), None if r.random() < 0.03 else r.gauss(100, 5) * r.choice([1] * 12 + [3])))
    table = spark.createDataFrame(rows, "event_id long, event_type string, at long, value double").withColumn("ts", F.timestamp_micros(F.col("at") * 1_000_000).cast("timestamp_ntz")).drop("at")
    parts = [rows[i : i + 150] for i in range(0, 900, 150)]
    for k in (3, 0, 1, 5, 2, 4):  # files neither come nor lie in the order of time
        ids = [x[0] for x in parts[k]]
        table.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = ev.fenced(ev.source(spark, str(tmp_path), files), every=every)
    columns = ["event_id", "event_type", "value", "outlier"]
    expected = recursive_fence(table, ["event_type"], ["ts", "event_id"], "value").select(*columns).collect()
    assert found.columns == columns and sum(x.outlier for x in expected) > 20
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected), key=repr)
