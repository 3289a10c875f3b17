"""Sinks read back, and scans of the published store; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import elementary as el
from tidemark.plans import cleaning, index
from tidemark.sources import store as st
from tidemark.sources.tables import QUOTES_SQL, basket, index_quotes, valid_quotes

KEY = ["route_id", "horizon", "product"]


def _place(spark, name):
    return f"{st.shared(spark)}/stores/{name}-{uuid.uuid4().hex[:12]}"


def persisted_runs(spark, d):
    """Two runs' tables, the first written twice: rows by table, run and kind."""
    at = _place(spark, "runs")
    v = cleaning.validated(spark, d).select("order_id", "line_no", "route_id", "fare", "excluded", "flags")
    odd = v.filter("order_id % 2 = 1")
    for run, rows in (("odd", v), ("even", v.filter("order_id % 2 = 0")), ("odd", odd)):  # the first run again, with other rows
        st.persist_run(rows, at, run)
    found = None
    for name, kind in (("observations", F.lit("row")), ("validation", F.col("action")), ("normalized", F.lit("row")), ("anomalies", F.concat_ws("/", "kind", "status"))):
        own = spark.read.parquet(f"{at}/{name}").groupBy("run_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("order_id").alias("orders")).withColumn("name", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return found


def replaced_partitions(spark, d):
    """Products by year and route; then one year again over fewer quotes: that year is replaced whole, the others stay."""
    at = _place(spark, "levels")
    q = valid_quotes(spark, d)
    levels = lambda rows: rows.groupBy("period", "route_id").agg(F.countDistinct("product").alias("n_products"), F.round(F.max("fare"), 4).alias("most"))
    st.replace_partitions(levels(q), at, ["period"])
    for _ in range(2):
        st.replace_partitions(levels(q.filter("period = 1996 and route_id < 12")), at, ["period"])
    return spark.read.parquet(at).select("period", "route_id", "n_products", "most")


def weight_snapshots(spark, d):
    """Weights are kept once a basket version: a version that is known keeps its first weights."""
    at = _place(spark, "weights")
    w = agg.weights(basket(spark, d)).select("route_id", F.round("weight", 6).alias("weight"))
    for version, factor in (("1", 1.0), ("1", 2.0), ("2", 3.0), ("2", 1.0)):
        st.snapshot_once(w.select("route_id", F.round(F.col("weight") * factor, 6).alias("weight"), F.lit(version).alias("version")), at, "version")
    return spark.read.parquet(at)


def published(spark, d):
    """The index's quotes by month, bucketed by what prices are matched on."""
    q = index_quotes(spark, d, **index.NAMED).withColumn("month", F.trunc("day", "month")).select(*KEY, "period", "fare", "day", "order_id", "line_no", "month")
    return st.publish_quotes(q, f"quotes_{uuid.uuid4().hex[:12]}", "month", KEY, 4)


def base_months(table):
    """Half a year of the base, chosen from a calendar of months: joined, it prunes the others while the query runs."""
    calendar = table.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("m"))
    return F.broadcast(calendar.filter("m >= 7").select(F.make_date(F.lit(index.BASE), "m", F.lit(1)).alias("month")))


def published_scan(spark, d):
    table = published(spark, d)
    found = table.join(base_months(table), "month").filter(F.col("route_id").isin(1, 2, 3, 7, 8) & F.col("horizon").isin(7, 30))
    return found.select("route_id", "horizon", "day", F.round("fare", 6).alias("fare"), "order_id", "line_no")


def matched_from_store(table):
    """Prices of later years beside those of the base's months, by product."""
    price = lambda rows, by: rows.groupBy(*by).agg(el.geomean(F.col("fare")).alias("price"), F.count("*").alias("n_quotes"))
    old = price(table.join(base_months(table), "month"), KEY).withColumnsRenamed({"price": "base_price", "n_quotes": "n_base"})
    return price(table.filter(F.col("period") > index.BASE), [*KEY, "period"]).join(old, KEY)


def published_matches(spark, d):
    return index.rounded(matched_from_store(published(spark, d)), "price", "base_price")


QUERIES = {f.__name__: f for f in (persisted_runs, replaced_partitions, weight_snapshots, published_scan, published_matches)}
_BASE = f"day BETWEEN DATE '{index.BASE}-07-01' AND DATE '{index.BASE}-12-31'"
ORACLE = {
    "persisted_runs": cleaning.VALIDATED
    + """, r AS (SELECT *, CASE WHEN order_id % 2 = 1 THEN 'odd' ELSE 'even' END AS run_id, CASE WHEN excluded IS NOT NULL THEN 'excluded' WHEN len(flags) > 0 THEN 'flagged' ELSE 'accepted' END AS action FROM judged), t AS (
  SELECT 'observations' AS name, run_id, 'row' AS kind, order_id FROM r UNION ALL SELECT 'validation', run_id, action, order_id FROM r UNION ALL SELECT 'normalized', run_id, 'row', order_id FROM r WHERE excluded IS NULL
  UNION ALL SELECT 'anomalies', run_id, unnest(flags) || '/open', order_id FROM r WHERE excluded IS NULL AND len(flags) > 0)
  SELECT name, run_id, kind, count(*) AS n, sum(order_id)::BIGINT AS orders FROM t GROUP BY ALL""",
    "replaced_partitions": f"WITH {QUOTES_SQL} SELECT period, route_id, count(DISTINCT product) AS n_products, round(max(fare), 4) AS most FROM valid WHERE period <> 1996 OR route_id < 12 GROUP BY ALL",
    "weight_snapshots": f"""WITH {QUOTES_SQL}, w AS (SELECT route_id, round(passengers / sum(passengers) OVER (), 6) AS weight FROM basket)
  SELECT route_id, weight, '1' AS version FROM w UNION ALL SELECT route_id, round(weight * 3.0::DOUBLE, 6), '2' FROM w""",
    "published_scan": f"WITH {QUOTES_SQL} SELECT route_id, horizon, day, round(fare, 6) AS fare, order_id, line_no FROM direct WHERE {_BASE} AND route_id IN (1, 2, 3, 7, 8) AND horizon IN (7, 30)",
    "published_matches": f"""WITH {QUOTES_SQL}, n AS (SELECT route_id, horizon, product, period, exp(avg(ln(fare))) AS price, count(*) AS n_quotes FROM direct WHERE period > {index.BASE} GROUP BY ALL),
  b AS (SELECT route_id, horizon, product, exp(avg(ln(fare))) AS base_price, count(*) AS n_base FROM direct WHERE {_BASE} GROUP BY ALL)
  SELECT route_id, horizon, product, period, round(price, 6) AS price, n_quotes, round(base_price, 6) AS base_price, n_base FROM n JOIN b USING (route_id, horizon, product)""",
}
