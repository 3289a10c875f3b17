"""The published store: pruning while the query runs, joins without a shuffle; quantiles by counts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as cl
from tidemark.operators import elementary as el
from tidemark.operators import series as sr
from tidemark.plans import stores
from tidemark.sources import store


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    rows = [(r.randint(1, 3), r.choice([1, 7]), r.randint(1, 40), 1995 + m // 12, 1000.0 + r.random() * 500, f"{1995 + m // 12}-{m % 12 + 1:02d}-01", i, 1) for i, m in enumerate(r.choices(range(30), k=3000))]
    df = spark.createDataFrame(rows, "route_id int, horizon int, product long, period int, fare double, month string, order_id long, line_no int").withColumn("month", F.to_date("month")).withColumn("day", F.col("month"))
    return df, store.publish_quotes(df, "quotes_of_test", "month", stores.KEY, 4)


def test_store_is_pruned_and_joins_without_a_shuffle(spark, table):
    df, kept = table
    assert sorted(map(tuple, kept.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    scanned = kept.join(stores.base_months(kept), "month")
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert sorted(x.order_id for x in scanned.collect()) == sorted(x.order_id for x in df.filter("day between '1995-07-01' and '1995-12-31'").collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stores.matched_from_store(kept)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "dynamicpruning" in plan.lower() and " Exchange " not in plan.replace("BroadcastExchange", "")
        rows = {tuple(x[:4]): x for x in found.select(*stores.KEY, "period", "price", "base_price", "n_quotes", "n_base").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    old = {(*x[:3],): x for x in df.filter("day between '1995-07-01' and '1995-12-31'").groupBy(*stores.KEY).agg(el.geomean(F.col("fare")), F.count("*")).collect()}
    now = [x for x in df.filter("period > 1995").groupBy(*stores.KEY, "period").agg(el.geomean(F.col("fare")), F.count("*")).collect() if (*x[:3],) in old]
    assert len(rows) == len(now) > 50
    for x in now:
        got = rows[tuple(x[:4])]
        assert got.price == pytest.approx(x[4]) and got.n_quotes == x[5] and got.base_price == pytest.approx(old[tuple(x[:3])][3]) and got.n_base == old[tuple(x[:3])][4]


@pytest.mark.parametrize("grain", [1.0, 0.001, 50.0])
def test_quantiles_by_counts(spark, grain):
    r = random.Random(1)
    rows = [(g, round(r.uniform(-3, 3), r.choice([0, 2, 9]))) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 500)) for _ in range(n)] + [("e", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"low": 0.01, "mid": 0.5, "high": 0.99}
    got = {x.g: x for x in sr.quantiles(df, ["g"], "v", points, grain).collect()}
    want = {x.g: x for x in df.filter("v is not null").groupBy("g").agg(F.count("*").alias("n"), *[F.percentile("v", F.lit(p)).alias(k) for k, p in points.items()]).collect()}
    assert got.keys() == want.keys() == set("abcd")
    for g, x in want.items():
        assert got[g].n == x.n and all(got[g][k] == pytest.approx(x[k], abs=1e-12) for k in points)


@pytest.mark.parametrize("rows_a_block", [7, 40, 10**6])
def test_fence_in_blocks_is_that_of_one_pass(spark, monkeypatch, rows_a_block):
    """One key has more rows than a line holds; days are ties that the id breaks; blocks are smaller and larger than a line."""
    monkeypatch.setattr(cl, "BLOCK_ROWS", rows_a_block)
    r = random.Random(8)
    made = [(r.choice(["hot"] * 8 + ["b", None]), i // 3, i, r.choice([None, float("nan")]) if r.random() < 0.05 else round(r.gauss(100, 3) * r.choice([1] * 15 + [2]), 1)) for i in range(900)]
    df = spark.createDataFrame(made, "k string, day int, id int, v double").repartition(5)
    told = lambda found: {x.id: (x.n_past, x.outlier) for x in found.collect()}
    expected = told(cl.recursive_fence(df, ["k"], ["day", "id"], "v", keep_outliers=True))
    assert told(cl.windowed_fence(df, ["k"], ["day", "id"], "v")) == expected
    assert sum(o for _, o in expected.values()) > 10 and max(n for n, _ in expected.values()) == cl.FENCE_WINDOW
    assert cl.windowed_fence(df.limit(0), ["k"], ["day", "id"], "v").count() == 0


def test_columns_computed_once(spark):
    df = spark.range(5).withColumn("a", F.col("id") * 2)
    made = store.computed_once(df.withColumn("b", F.col("a") + 1), ["a", "b"]).filter("b > 3 and a < 8")
    assert [(x.id, x.a, x.b) for x in made.orderBy("id").collect()] == [(2, 4, 5), (3, 6, 7)]


def test_latest_rows_are_saved_over_the_store_that_they_come_from(spark, tmp_path):
    at = f"file://{tmp_path}/latest"
    df = lambda *rows: spark.createDataFrame(rows, "name string, n int, seen int")
    store.save_latest(df(("a", 1, 1), ("b", 2, 1)), at, "name", "seen")
    store.save_latest(df(("a", 5, 3), ("c", 9, 2)), at, "name", "seen")
    store.save_latest(df(("a", 4, 2)), at, "name", "seen")  # an older row changes nothing
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [("a", 5, 3), ("b", 2, 1), ("c", 9, 2)]
    store.clear(spark)
    assert spark.read.parquet(at).count() == 3
