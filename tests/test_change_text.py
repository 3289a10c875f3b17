"""Changes in words: two places of the double itself, halves as Python's format and DuckDB's tell them."""

from pyspark.sql import functions as F

from tidemark.functions import fares as fn


def test_halves(spark):
    values = [k / 10000 for k in range(-20050, 20051, 100)] + [0.0, -0.004, 0.125, 1234567.125, -1234.565]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "pct double")
    status = F.when(F.col("pct").isNull(), "insufficient_history").otherwise("available")
    got = [r.told for r in df.select(fn.change_text(F.col("pct"), status, "monthly").alias("told")).collect()]
    assert got[:-1] == [f"{x:+.2f}%" for x in values]
    assert got[-1].startswith("Not available")
