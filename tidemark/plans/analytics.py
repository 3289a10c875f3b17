"""Analytical and monitoring queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series as sr
from tidemark.operators.aggregates import ALPHA, HORIZONS
from tidemark.sources.store import settle
from tidemark.sources.tables import QUOTES_SQL, observations, quotes, read, valid_quotes


def daily(spark, d):
    return read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))


def order_days(spark, d):
    return read(spark, d, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("day")).agg(F.avg("o_totalprice").alias("value"))


def gappy_days(spark, d):
    """Mean order value by day, without the days whose number is a multiple of 3 or 5 and without every March: a series with gaps."""
    day = F.to_date("o_orderdate")
    kept = (F.dayofyear(day) % 3 != 0) & (F.dayofyear(day) % 5 != 0) & (F.month(day) != 3)
    return read(spark, d, "orders").filter(kept).groupBy(day.alias("day")).agg(F.avg("o_totalprice").alias("value"))


def mom_yoy_nearest(spark, d):
    out = None
    for kind, months in (("mom", 1), ("yoy", 12)):
        found = sr.nearest(gappy_days(spark, d).withColumn("series", F.lit("orders")), ["series"], months)
        pct, status = sr.period_change(F.col("value"), F.col("previous"))
        found = found.select(F.lit(kind).alias("kind"), "day", F.round("value", 6).alias("value"), "matched_day", F.round(pct, 6).alias("change_pct"), status.alias("status"))
        out = found if out is None else out.unionByName(found)
    return out


def rebase_series(spark, d):
    found = sr.rebase(order_days(spark, d), "1996-01-01", "1996-12-31")
    return found.select("day", *[F.round(c, 6).alias(c) for c in ("value", "divisor", "rebased")], "applied")


def reference_windows(spark, d):
    return sr.reference_windows(order_days(spark, d))


def seasonal_readiness(spark, d):
    months = F.countDistinct(F.trunc("day", "month"))
    return order_days(spark, d).agg(months.alias("n_months"), (months >= 36).alias("ready"))


def fare_stats(spark, d):
    """Of all quotes, joined and written once; the median is exact, by counts of fares."""
    q = settle(quotes(spark, d).select("fare", "route_id", "carrier"), "fares")
    ok = F.col("fare").between(500, 80000)
    got = q.agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), F.round(F.avg("fare"), 6).alias("mean"), F.round(F.min("fare"), 6).alias("least"), F.round(F.max("fare"), 6).alias("most"),
        F.countDistinct("route_id").alias("n_routes"), F.countDistinct("carrier").alias("n_carriers"),
    )
    return got.join(F.broadcast(sr.medians(q, [], "fare").select(F.round("median", 6).alias("median"))), F.lit(True), "left")


def counts_by_source(spark, d):
    return quotes(spark, d).groupBy("source_type").agg(F.count("*").alias("n"))


def quality_cells(spark, d):
    q = quotes(spark, d).withColumn("ok", F.col("fare").between(500, 80000))
    return q.groupBy("period").agg(F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_quarantined"), F.countDistinct("route_id", "horizon").alias("n_cells"))


def route_reporting(spark, d):
    """Scheduled cells (route, horizon, period) against observed ones, by route."""
    q = valid_quotes(spark, d)
    seen = q.groupBy("route_id").agg(F.countDistinct("horizon", "period").alias("observed"))
    routes = read(spark, d, "nation").select(F.col("n_nationkey").alias("route_id"))
    horizons = q.select("horizon").distinct().agg(F.count("*").alias("_h"))
    periods = q.select("period").distinct().agg(F.count("*").alias("_p"))
    scheduled = routes.join(F.broadcast(horizons), F.lit(True)).join(F.broadcast(periods), F.lit(True)).withColumn("scheduled", F.col("_h") * F.col("_p"))
    rate = 100 * F.coalesce("observed", F.lit(0)) / F.col("scheduled")
    return scheduled.join(seen, "route_id", "left").select("route_id", "scheduled", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), F.round(rate, 6).alias("rate_pct"), (rate >= 50).alias("reporting"))


def horizon_levels(spark, d):
    """Fares by horizon of the policy, with its weight."""
    q = valid_quotes(spark, d).select("horizon", "fare")
    levels = q.groupBy("horizon").agg(F.count("*").alias("n"), *[F.round(c, 6).alias(n) for n, c in (("mean", F.avg("fare")), ("least", F.min("fare")), ("most", F.max("fare")))])
    middle = sr.medians(q, ["horizon"], "fare").select("horizon", F.round("median", 6).alias("median"))
    policy = spark.createDataFrame([(h, ALPHA) for h in HORIZONS], "horizon int, weight double")
    return F.broadcast(policy).join(levels, "horizon").join(middle, "horizon")


def fits(spark, d, by):
    return sr.quadratic_fit(valid_quotes(spark, d).select("carrier", "horizon", "fare"), "horizon", "fare", by, 10)


def elasticity(spark, d, by):
    slopes = [F.round(sr.slope_pct(F.lit(h)), 4).alias(f"eta_{h}") for h in HORIZONS]
    return fits(spark, d, by).select(*by, "n", *[F.round(c, 5).alias(c) for c in ("b0", "b1", "b2", "r2")], F.round("best_x", 1).alias("best_horizon"), *slopes)


def elasticity_curve(spark, d):
    """The overall fit's fares and slopes at eight horizons."""
    return sr.curve(fits(spark, d, []), [1, 3, 7, 14, 21, 30, 45, 60]).select("x", F.round("predicted", 3).alias("predicted"), F.round("slope_pct", 4).alias("slope_pct"))


def elasticity_ols(spark, d):
    return elasticity(spark, d, [])


def elasticity_by_carrier(spark, d):
    return elasticity(spark, d, ["carrier"])


def monthly_pair(spark, d):
    model = read(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.avg("l_extendedprice").alias("model"))
    official = read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("official"))
    return official.join(model, "month", "left")


def backtest_metrics(spark, d):
    """Only months that both series have; none is imputed."""
    p = monthly_pair(spark, d).filter("model is not null and official is not null")
    err = (F.col("model") - F.col("official")) / F.col("official")
    got = p.agg(
        F.count("*").alias("n"), F.coalesce(F.corr("model", "official"), F.lit(1.0)).alias("r"), (100 * F.avg(F.abs(err))).alias("mape"),
        F.sqrt(F.avg(F.pow(F.col("model") - F.col("official"), F.lit(2.0)))).alias("rmse"),
    )
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("r", "mape", "rmse")], ((F.col("r") >= 0.85) & (F.col("mape") <= 5)).alias("passed"))


def monthly_comovement(spark, d):
    """Model and official series by month; a month without a model value stands on the official one and says so."""
    p = monthly_pair(spark, d).withColumn("is_missing", F.col("model").isNull()).withColumn("model", F.coalesce("model", "official"))
    return p.select("month", F.round("official", 6).alias("official"), F.round("model", 6).alias("model"), "is_missing", F.round(F.abs(F.col("model") - F.col("official")), 6).alias("gap"))


def comovement_summary(spark, d):
    p = monthly_pair(spark, d).filter("model is not null")
    return p.agg(F.count("*").alias("months"), F.round(F.corr("model", "official"), 6).alias("r"), F.round(F.avg(F.abs(F.col("model") - F.col("official"))), 6).alias("tracking_error"))


def movers(spark, d, newest=None):
    """Each flight's latest fare against its route's upper median; of the newest quotes only, if a number is given."""
    q = settle(observations(quotes(spark, d), valid=True, newest=newest).select("route_id", "carrier", "product", "fare", "day", "order_id", "line_no"), "fares")
    median = sr.order_statistics(q, ["route_id"], "fare", {"median": lambda n: F.floor(n / 2)}).select("route_id", "median")
    latest = q.groupBy("route_id", "carrier", "product").agg(F.max_by("fare", F.struct("day", "order_id", "line_no", "fare")).alias("current"))
    return latest.join(F.broadcast(median), "route_id").withColumn("pct", 100 * (F.col("current") - F.col("median")) / F.col("median"))


def _top(df, up: bool):
    pct = F.round("pct", 6)
    df = df.withColumn("pct", pct).filter(F.col("pct") > 0 if up else F.col("pct") < 0)
    order = F.desc("pct") if up else F.asc("pct")
    tag = F.when(F.col("pct") >= 40, "extreme").when(F.col("pct") >= 20, "high").otherwise("moderate") if up else F.when(F.col("pct") <= -20, "deep").otherwise("value")
    return df.orderBy(order, "route_id", "carrier", "product").limit(10).select("route_id", "carrier", "product", F.round("current", 6).alias("current"), F.round("median", 6).alias("median"), "pct", tag.alias("tag"))


def movers_up(spark, d):
    return _top(movers(spark, d), True)


def movers_down(spark, d):
    return _top(movers(spark, d), False)


def brand_benchmark(spark, d):
    m = movers(spark, d)
    g = m.groupBy("route_id", "carrier").agg(
        F.count("*").alias("n"), F.avg("current").alias("mean"), F.min_by("product", F.struct("current", "product")).alias("cheapest"),
        F.max_by("product", F.struct("current", "product")).alias("dearest"), F.first("median").alias("median"),
    )
    place = lambda *o: F.row_number().over(Window.partitionBy("route_id").orderBy(*o))
    label = F.when(place("mean", "carrier") == 1, "lowest").when(place(F.desc("mean"), F.desc("carrier")) == 1, "highest").otherwise("between")
    return g.select("route_id", "carrier", "n", F.round("mean", 6).alias("mean"), "cheapest", "dearest", F.round(100 * (F.col("mean") - F.col("median")) / F.col("median"), 6).alias("vs_median_pct"), label.alias("position"))




def usage(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("month", F.to_date(F.trunc("ts", "month")))
    day = e.groupBy(F.col("event_type").alias("source"), "day", "month").agg(F.count("*").alias("used_day"), F.count_if(F.col("value") > 50).alias("large_day"))
    return day.withColumn("used_month", F.sum("used_day").over(Window.partitionBy("source", "month").orderBy("day")))


def usage_counters(spark, d):
    return usage(spark, d)


def budget_status(spark, d):
    pct = F.greatest(100 * (F.col("used_day") + 1) / F.lit(60.0), 100 * (F.col("used_month") + 1) / F.lit(1500.0))
    status = F.when(pct >= 100, "QUOTA_EXHAUSTED").when(pct >= 95, "REDUCED_BASKET").when(pct >= 80, "WARNING").otherwise("NORMAL")
    return usage(spark, d).select("source", "day", F.round(pct, 6).alias("projected_pct"), status.alias("status"))


def run_status(spark, d):
    """Runs are days; an attempt is a user's day: it succeeds if it has a purchase."""
    a = read(spark, d, "events").groupBy(F.to_date("ts").alias("run"), "user_id").agg((F.count_if(F.col("event_type") == "purchase") > 0).alias("ok"))
    g = a.groupBy("run").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("succeeded"))
    return g.withColumn("status", F.when(F.col("succeeded") == F.col("attempts"), "SUCCESS").when(F.col("succeeded") > 0, "PARTIAL").otherwise("FAILED"))


def rate_limit_window(spark, d):
    e = read(spark, d, "events")
    past = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-86400 + 1, 0)
    n = F.count("*").over(past)
    return e.select("event_id", "user_id", n.alias("in_window"), (n <= 3).alias("admitted"))


# The topics of the local answers in order of precedence, with their keywords.
TOPICS = {
    "jevons": ["jevons", "geometric mean", "elementary", "formula"],
    "horizons": ["horizon", "advance", "t+0", "t+30", "booking window", "stratif"],
    "seasonality": ["seasonal", "diwali", "festival", "holiday", "adjust"],
    "weights": ["weight", "dgca", "passenger", "expenditure", "basket"],
    "yoy": ["yoy", "year on year", "year-on-year", "12 month"],
    "collection": ["scrap", "start scrap", "trigger", "fetch fresh", "ingest", "collect data", "run scraper"],
    "provenance": ["provenance", "live", "simulated", "real data", "source"],
    "uncertainty": ["uncertainty", "confidence", "standard error", "interval"],
    "validation": ["validation", "iqr", "outlier", "anomaly", "quality"],
    "base": ["base period", "rebase", "base year", "reference"],
}


def topic_router(spark, d):
    """The first topic with a keyword in the question, else the figures. Every 13th turn asks by a keyword of its own."""
    words = [w for ws in TOPICS.values() for w in ws]
    pick = F.element_at(F.array(*[F.lit(w.upper()) for w in words]), (F.col("conv_id") % len(words) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.concat(F.lit(" "), pick)).otherwise(""))
    low, topic = F.lower(text), F.lit("figures")
    for name, keys in reversed(TOPICS.items()):
        hit = F.lit(False)
        for w in keys:
            hit = hit | F.contains(low, F.lit(w))
        topic = F.when(hit, name).otherwise(topic)
    return read(spark, d, "conversations").select("conv_id", "turn", topic.alias("topic"))


def latest_per_key(spark, d):
    e = read(spark, d, "events")
    return e.withColumn("_last", F.max("ts").over(Window.partitionBy("user_id"))).filter("ts = _last").select("user_id", "event_id", "event_type", "ts")


def history_tail(spark, d):
    s = daily(spark, d)
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))
    return s.withColumn("_n", rn).filter("_n <= 7").select("event_type", "day", F.round("value", 6).alias("value"))


def topk_orders(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_totalprice")


def text_search(spark, d):
    n = F.lower("c_name")
    return read(spark, d, "customer").filter((F.col("c_mktsegment") == "BUILDING") & (F.contains(n, F.lit("7")) | F.contains(F.lower("c_mktsegment"), F.lit("auto")))).select("c_custkey", "c_name")


def revision_diff(spark, d):
    """Two passes over the years' mean order value; the second leaves out urgent orders of one year."""
    o = read(spark, d, "orders")
    one = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("was"))
    late = ~((F.year("o_orderdate") == 1996) & F.startswith("o_orderpriority", F.lit("1")))
    two = o.filter(late).groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("now"))
    both = one.join(two, one.year.eqNullSafe(two.year), "full").select(F.coalesce(one.year, two.year).alias("year"), "was", "now")
    kind = F.when(F.col("was").isNull(), "initial_publication").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("recomputation")
    return both.withColumn("revision", kind)


def series_range(spark, d):
    s = daily(spark, d)
    return s.withColumn("_max", F.max("day").over(Window.partitionBy("event_type"))).filter("day >= date_sub(_max, 7)").select("event_type", "day", F.round("value", 6).alias("value"))


MONTHLY_ORDERS = "m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1)"
DAILY = "s AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL)"
FIT = """, v AS (SELECT carrier, horizon::DOUBLE AS x, ln(fare) AS y FROM valid), f AS (
  SELECT {by} count(*) AS n, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) y0, sum(x*y) y1, sum(x*x*y) y2, sum(y*y) yy FROM v {group} HAVING count(*) >= 10
), e AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d FROM f), b AS (
  SELECT *, (y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2))/d AS b0, (n*(y1*s4-s3*y2) - y0*(s1*s4-s3*s2) + s2*(s1*y2-y1*s2))/d AS b1,
    (n*(s2*y2-y1*s3) - s1*(s1*y2-y1*s2) + y0*(s1*s3-s2*s2))/d AS b2 FROM e)
SELECT {by} n, round(b0, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(least(greatest(1 - (yy - b0*y0 - b1*y1 - b2*y2)/(yy - y0*y0/n), 0), 1), 5) AS r2, 
  CASE WHEN b2 > 1e-8 THEN round(least(greatest(-b1 / (2 * b2), 1.0), 90.0), 1) END AS best_horizon,
  round(100 * (b1 + 2*b2), 4) AS eta_1, round(100 * (b1 + 14*b2), 4) AS eta_7, round(100 * (b1 + 30*b2), 4) AS eta_15, round(100 * (b1 + 60*b2), 4) AS eta_30, round(100 * (b1 + 90*b2), 4) AS eta_45 FROM b"""
TOPIC_SQL = " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in TOPICS.items())
MOVERS = f"""WITH {QUOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY fare, order_id, line_no) AS place, count(*) OVER (PARTITION BY route_id) AS n FROM valid),
med AS (SELECT route_id, fare AS median FROM r WHERE place = n // 2 + 1), latest AS (
  SELECT route_id, carrier, product, fare AS current FROM valid QUALIFY row_number() OVER (PARTITION BY route_id, carrier, product ORDER BY day DESC, order_id DESC, line_no DESC, fare DESC) = 1
), movers AS (SELECT latest.*, median, round(100 * (current - median) / median, 6) AS pct FROM latest JOIN med USING (route_id))"""
PAIR = """WITH model AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, avg(l_extendedprice) AS model FROM lineitem GROUP BY 1),
official AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS official FROM orders GROUP BY 1), p AS (SELECT * FROM official LEFT JOIN model USING (month))"""
USAGE = """WITH day AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS used_day, count(*) FILTER (WHERE value > 50) AS large_day FROM events GROUP BY ALL),
u AS (SELECT *, CAST(sum(used_day) OVER (PARTITION BY source, month ORDER BY day) AS BIGINT) AS used_month FROM day)"""

QUERIES = {
    f.__name__: f
    for f in (
        mom_yoy_nearest, rebase_series, reference_windows, seasonal_readiness, fare_stats, counts_by_source, quality_cells, route_reporting, horizon_levels,
        elasticity_ols, elasticity_by_carrier, elasticity_curve, backtest_metrics, monthly_comovement, comovement_summary, movers_up, movers_down, brand_benchmark, usage_counters, budget_status,
        run_status, rate_limit_window, topic_router, latest_per_key, history_tail, topk_orders, text_search, revision_diff, series_range,
    )
}


def _nearest_sql(kind: str, months: int) -> str:
    return f"""SELECT '{kind}' AS kind, g.day, round(any_value(g.value), 6) AS value, arg_min(p.day, {{a: abs(p.day - anchor), b: p.day - anchor}}) AS matched_day,
  round(100 * (any_value(g.value) / arg_min(p.value, {{a: abs(p.day - anchor), b: p.day - anchor}}) - 1), 6) AS change_pct,
  CASE WHEN count(p.day) = 0 THEN 'insufficient_history' ELSE 'available' END AS status
  FROM (SELECT *, CAST(day - INTERVAL {months} MONTH AS DATE) AS anchor FROM g) g
  LEFT JOIN g p ON p.day BETWEEN anchor - 7 AND anchor + 7 AND date_trunc('month', p.day) = date_trunc('month', anchor) GROUP BY g.day"""


GAPPY = """g AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders
  WHERE dayofyear(o_orderdate) % 3 <> 0 AND dayofyear(o_orderdate) % 5 <> 0 AND month(o_orderdate) <> 3 GROUP BY 1)"""
ORACLE = {
    "mom_yoy_nearest": f"WITH {GAPPY} " + _nearest_sql("mom", 1) + " UNION ALL " + _nearest_sql("yoy", 12),
    "rebase_series": f"""WITH {MONTHLY_ORDERS}, x AS (SELECT exp(avg(ln(value))) AS divisor FROM m WHERE day BETWEEN '1996-01-01' AND '1996-12-31' AND value > 0)
  SELECT day, round(value, 6) AS value, round(divisor, 6) AS divisor, round(CASE WHEN divisor IS NULL THEN value ELSE 100 * value / divisor END, 6) AS rebased, divisor IS NOT NULL AS applied FROM m, x""",
    "reference_windows": f"WITH {MONTHLY_ORDERS} SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS n_points, min(day) AS first_day, max(day) AS last_day, count(DISTINCT month(day)) = 12 AS complete FROM m GROUP BY 1",
    "seasonal_readiness": f"WITH {MONTHLY_ORDERS} SELECT count(DISTINCT day) AS n_months, count(DISTINCT day) >= 36 AS ready FROM m",
    "fare_stats": f"""WITH {QUOTES_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE fare BETWEEN 500 AND 80000) AS n_valid, round(avg(fare), 6) AS mean, round(min(fare), 6) AS least, round(max(fare), 6) AS most,
  round(quantile_cont(fare, 0.5), 6) AS median, count(DISTINCT route_id) AS n_routes, count(DISTINCT carrier) AS n_carriers FROM quotes""",
    "counts_by_source": f"WITH {QUOTES_SQL} SELECT source_type, count(*) AS n FROM quotes GROUP BY 1",
    "quality_cells": f"""WITH {QUOTES_SQL} SELECT period, count(*) FILTER (WHERE fare BETWEEN 500 AND 80000) AS n_valid, count(*) FILTER (WHERE NOT fare BETWEEN 500 AND 80000) AS n_quarantined,
  count(DISTINCT route_id * 1000 + horizon) AS n_cells FROM quotes GROUP BY 1""",
    "route_reporting": f"""WITH {QUOTES_SQL}, seen AS (SELECT route_id, count(DISTINCT period * 1000 + horizon) AS observed FROM valid GROUP BY 1),
  s AS (SELECT n_nationkey AS route_id, (SELECT count(DISTINCT horizon) FROM valid) * (SELECT count(DISTINCT period) FROM valid) AS scheduled FROM nation)
  SELECT route_id, scheduled, coalesce(observed, 0) AS observed, round(100 * coalesce(observed, 0) / scheduled, 6) AS rate_pct, 100 * coalesce(observed, 0) / scheduled >= 50 AS reporting FROM s LEFT JOIN seen USING (route_id)""",
    "horizon_levels": f"WITH {QUOTES_SQL} SELECT horizon, 0.2::DOUBLE AS weight, count(*) AS n, round(avg(fare), 6) AS mean, round(quantile_cont(fare, 0.5), 6) AS median, round(min(fare), 6) AS least, round(max(fare), 6) AS most FROM valid GROUP BY 1",
    "elasticity_ols": f"WITH {QUOTES_SQL}" + FIT.format(by="", group=""),
    "elasticity_by_carrier": f"WITH {QUOTES_SQL}" + FIT.format(by="carrier,", group="GROUP BY carrier"),
    "backtest_metrics": PAIR
    + """ SELECT count(*) AS n, round(corr(model, official), 6) AS r, round(100 * avg(abs((model - official) / official)), 6) AS mape, round(sqrt(avg((model - official) * (model - official))), 6) AS rmse,
  corr(model, official) >= 0.85 AND 100 * avg(abs((model - official) / official)) <= 5 AS passed FROM p WHERE model IS NOT NULL""",
    "monthly_comovement": PAIR + " SELECT month, round(official, 6) AS official, round(coalesce(model, official), 6) AS model, model IS NULL AS is_missing, round(abs(coalesce(model, official) - official), 6) AS gap FROM p",
    "comovement_summary": PAIR + " SELECT count(*) AS months, round(corr(model, official), 6) AS r, round(avg(abs(model - official)), 6) AS tracking_error FROM p WHERE model IS NOT NULL",
    "elasticity_curve": f"WITH {QUOTES_SQL}" + FIT.format(by="", group="").split("SELECT  n, round(b0")[0] + """, x AS (SELECT unnest([1, 3, 7, 14, 21, 30, 45, 60])::INTEGER AS x)
  SELECT x, round(exp(b0 + b1 * x + b2 * x * x), 3) AS predicted, round(100 * (b1 + 2 * b2 * x), 4) AS slope_pct FROM b, x""",
    "movers_up": MOVERS
    + " SELECT route_id, carrier, product, round(current, 6) AS current, round(median, 6) AS median, pct, CASE WHEN pct >= 40 THEN 'extreme' WHEN pct >= 20 THEN 'high' ELSE 'moderate' END AS tag FROM movers WHERE pct > 0 ORDER BY pct DESC, route_id, carrier, product LIMIT 10",
    "movers_down": MOVERS
    + " SELECT route_id, carrier, product, round(current, 6) AS current, round(median, 6) AS median, pct, CASE WHEN pct <= -20 THEN 'deep' ELSE 'value' END AS tag FROM movers WHERE pct < 0 ORDER BY pct, route_id, carrier, product LIMIT 10",
    "brand_benchmark": MOVERS
    + """, g AS (SELECT route_id, carrier, count(*) AS n, avg(current) AS mean, any_value(median) AS median FROM movers GROUP BY ALL),
  lo AS (SELECT route_id, carrier, product AS cheapest FROM movers QUALIFY row_number() OVER (PARTITION BY route_id, carrier ORDER BY current, product) = 1),
  hi AS (SELECT route_id, carrier, product AS dearest FROM movers QUALIFY row_number() OVER (PARTITION BY route_id, carrier ORDER BY current DESC, product DESC) = 1)
  SELECT route_id, carrier, n, round(mean, 6) AS mean, cheapest, dearest, round(100 * (mean - median) / median, 6) AS vs_median_pct,
    CASE WHEN row_number() OVER (PARTITION BY route_id ORDER BY mean, carrier) = 1 THEN 'lowest' WHEN row_number() OVER (PARTITION BY route_id ORDER BY mean DESC, carrier DESC) = 1 THEN 'highest' ELSE 'between' END AS position
  FROM g JOIN lo USING (route_id, carrier) JOIN hi USING (route_id, carrier)""",
    "usage_counters": USAGE + " SELECT * FROM u",
    "budget_status": USAGE
    + """, b AS (SELECT source, day, greatest(100 * (used_day + 1) / 60.0, 100 * (used_month + 1) / 1500.0)::DOUBLE AS pct FROM u)
  SELECT source, day, round(pct, 6) AS projected_pct, CASE WHEN pct >= 100 THEN 'QUOTA_EXHAUSTED' WHEN pct >= 95 THEN 'REDUCED_BASKET' WHEN pct >= 80 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM b""",
    "run_status": """WITH a AS (SELECT CAST(ts AS DATE) AS run, user_id, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS ok FROM events GROUP BY ALL)
  SELECT run, count(*) AS attempts, count(*) FILTER (WHERE ok) AS succeeded, CASE WHEN bool_and(ok) THEN 'SUCCESS' WHEN bool_or(ok) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM a GROUP BY run""",
    "rate_limit_window": """WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window FROM events)
  SELECT event_id, user_id, in_window, in_window <= 3 AS admitted FROM w""",
    "topic_router": f"""WITH t AS (SELECT *, {[w for ws in TOPICS.values() for w in ws]} AS words FROM conversations),
  l AS (SELECT conv_id, turn, lower(coalesce(text, '') || CASE WHEN (conv_id + turn) % 13 = 0 THEN ' ' || words[conv_id % len(words) + 1] ELSE '' END) AS low FROM t)
  SELECT conv_id, turn, CASE {TOPIC_SQL} ELSE 'figures' END AS topic FROM l""",
    "latest_per_key": "SELECT user_id, event_id, event_type, ts FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m",
    "history_tail": f"WITH {DAILY} SELECT event_type, day, round(value, 6) AS value FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 7",
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "text_search": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'auto'))",
    "revision_diff": """WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS was FROM orders GROUP BY 1),
  b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS now FROM orders WHERE NOT (year(o_orderdate) = 1996 AND o_orderpriority LIKE '1%') GROUP BY 1)
  SELECT year, was, now, CASE WHEN was IS NULL THEN 'initial_publication' WHEN was IS NOT DISTINCT FROM now THEN 'unchanged' ELSE 'recomputation' END AS revision FROM a FULL JOIN b USING (year)""",
    "series_range": f"WITH {DAILY} SELECT event_type, day, round(value, 6) AS value FROM (SELECT *, max(day) OVER (PARTITION BY event_type) AS m FROM s) WHERE day >= m - 7",
}
