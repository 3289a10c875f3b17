"""Listings, look-ups and reports over quotes and indices, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.operators import aggregates as agg
from tidemark.operators import cleaning as cl
from tidemark.operators import elementary as el
from tidemark.operators import governance as gov
from tidemark.operators import series as sr
from tidemark.plans import analytics, cleaning, index
from tidemark.sources.store import captures, settle
from tidemark.sources.tables import QUOTES_SQL, basket, observations, quotes, read, valid_quotes

SEEN = ["route_id", "horizon", "day", "fare", "order_id", "line_no"]


def provenance_guard(spark, d):
    """Which routes, horizons and products mix source types or methods. What an index is refused by is index_guard, over all its quotes."""
    return gov.provenance_guard(quotes(spark, d), ["route_id", "horizon", "product"], "source_type", "method")


def observation_scan(spark, d):
    found = observations(quotes(spark, d), "1996-02-01", "1997-06-30", [1, 2, 3, 8], [7, 30], True, "N")
    return found.select(*SEEN).withColumn("fare", F.round("fare", 6))


def observation_latest(spark, d):
    return observations(quotes(spark, d), valid=True, newest=50).select(*SEEN).withColumn("fare", F.round("fare", 6))


def headline_rows(spark, d):
    """The national index of each period and, beside it, those of its horizons; the headline has none."""
    c, w = settle(index.cells(spark, d), "cells"), agg.weights(basket(spark, d))
    whole = agg.national(agg.route_indices(c).filter("publishable"), w, ["period"]).withColumn("horizon", F.lit(None).cast("int"))
    every = whole.unionByName(agg.national(c.drop("n_matched"), w, ["period", "horizon"]))
    return index.rounded(every.select("period", "horizon", "index", "coverage", "publishable"), "index", "coverage")


def national_latest(spark, d):
    return index.national_index(spark, d).orderBy(F.desc("period")).limit(1)


def national_changes(spark, d):
    """The national index by period with its change on the period before, in figures and words, and re-referenced to 1997."""
    s = index.national_index(spark, d).select("period", "index", F.make_date("period", F.lit(1), F.lit(1)).alias("day"))
    s = settle(s, "national")
    before = s.select((F.col("period") + 1).alias("period"), F.col("index").alias("previous"))
    pct, status = sr.period_change(F.col("index"), F.col("previous"))
    changed = s.join(before, "period", "left").select("period", "index", F.round(pct, 6).alias("change_pct"), status.alias("status"), fn.change_text(F.round(pct, 6), status, "yearly").alias("told"))
    rebased = sr.rebase(s.select("day", F.col("index").alias("value")), "1997-01-01", "1997-12-31").select(F.year("day").alias("period"), F.round("rebased", 6).alias("rebased"))
    return changed.join(rebased, "period")


def uncertainty_bands(spark, d):
    """1.96 standard errors around each elementary index."""
    u = el.with_uncertainty(index.cells(spark, d)).filter("se is not null")
    return u.select(*el.CELL, F.round("index", 6).alias("index"), F.round(F.col("index") - 1.96 * F.col("se"), 6).alias("low"), F.round(F.col("index") + 1.96 * F.col("se"), 6).alias("high"))


def match_quality(spark, d):
    return index.rounded(el.match_quality(settle(index.prices(spark, d), "prices"), index.BASE), "level", "base_level", "match_rate")


def route_extremes(spark, d):
    """The five highest and lowest routes of every period."""
    r = agg.route_indices(index.cells(spark, d)).filter("publishable")
    place = lambda o: F.row_number().over(Window.partitionBy("period").orderBy(o, "route_id"))
    ranked = r.select("period", "route_id", F.round("index", 6).alias("index")).withColumn("from_top", place(F.desc("index"))).withColumn("from_bottom", place(F.asc("index")))
    return ranked.filter("from_top <= 5 or from_bottom <= 5").withColumns({c: F.col(c).cast("long") for c in ("from_top", "from_bottom")})


def routes_by_weight(spark, d):
    """Routes with their names and regions, heaviest first; names that neither table has are '???'."""
    n, r = read(spark, d, "nation").filter("n_nationkey % 6 <> 0"), read(spark, d, "region").filter("r_regionkey <> 3")
    w = agg.weights(basket(spark, d)).join(F.broadcast(n), F.col("route_id") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "route_id")).cast("long")  # one row a route
    return w.select("route_id", F.coalesce("n_name", "r_name", F.lit("???")).alias("name"), F.coalesce("r_name", F.lit("???")).alias("region"), F.round("weight", 6).alias("weight"), rank.alias("rank"))


def route_search(spark, d):
    """Nations by any of their fields, within a region's facet."""
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    hit = F.contains(F.lower("n_name"), F.lit("an")) | F.contains(F.lower("r_name"), F.lit("an")) | F.contains(F.col("n_nationkey").cast("string"), F.lit("7"))
    return n.filter(hit & F.col("r_name").isin("ASIA", "EUROPE", "AMERICA")).select("n_nationkey", "n_name", "r_name")


def series_span(spark, d):
    s = analytics.daily(spark, d)
    return s.groupBy("event_type").agg(F.count("*").alias("n_points"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.datediff(F.max("day"), F.min("day")).alias("span_days"))


def value_before(spark, d):
    """Each user's days with the mean value of the latest earlier day that the user has."""
    s = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    found = sr.latest_before(s, s.select("user_id", "day"), ["user_id"])
    return found.select("user_id", "day", "found_day", F.round("found", 6).alias("found"))


def runs_newest(spark, d):
    return analytics.run_status(spark, d).orderBy(F.desc("run")).limit(10)


def runs_tail(spark, d):
    """The newest ten runs, oldest of them first."""
    return runs_newest(spark, d).withColumn("place", F.row_number().over(Window.orderBy("run")).cast("long")).select("run", "status", "place")  # ten rows


def run_counters(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("run")).agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("event_type").alias("n_kinds"), F.count_if(F.col("value") < 5).alias("n_failures"), F.count("*").alias("n_attempts"))


def usable_by_route(spark, d):
    """Accepted and flagged quotes are usable, excluded ones are not."""
    v = cleaning.validated(spark, d)
    return v.groupBy("route_id").agg(F.count_if(F.col("excluded").isNull()).alias("n_usable"), F.count_if(F.col("excluded").isNull() & (F.size("flags") > 0)).alias("n_flagged"), F.count("*").alias("n"))


def anomaly_counts(spark, d):
    """Anomalies by flag and the status that their review left them in."""
    v = cleaning.validated(spark, d).filter("excluded is null").select("order_id", F.explode("flags").alias("flag"))
    status = F.when(F.col("order_id") % 5 == 0, "confirmed").when(F.col("order_id") % 5 == 1, "error").otherwise("open")
    return v.withColumn("status", status).groupBy("flag").pivot("status", ["open", "confirmed", "error"]).agg(F.count(F.lit(1))).na.fill(0)


def corridor_benchmark(spark, d):
    """Routes' mean fares against what their customers' orders pay for a hundredth."""
    seen = valid_quotes(spark, d).groupBy("route_id").agg(F.avg("fare").alias("observed"))
    paid = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("route_id")).agg((F.avg("o_totalprice") / 100).alias("benchmark"))
    return paid.join(seen, "route_id", "left").select("route_id", F.round("benchmark", 6).alias("benchmark"), F.round("observed", 6).alias("observed"), F.round(100 * (F.col("observed") / F.col("benchmark") - 1), 6).alias("gap_pct"))


def seasonal_passthrough(spark, d):
    """No adjustment is made: the series stands as it is and says so."""
    return analytics.order_days(spark, d).select("day", F.round("value", 6).alias("value"), F.lit(None).cast("double").alias("adjusted"), F.lit("NOT IMPLEMENTED").alias("status"))


def bulletin(spark, d):
    q = quotes(spark, d)
    ok = F.col("fare").between(cl.FARE_MIN, cl.FARE_MAX)
    return q.agg(F.count("*").alias("n"), F.round(100 * F.avg(ok.cast("double")), 6).alias("valid_pct"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("route_id").alias("n_routes"), F.countDistinct("horizon").alias("n_horizons"))


def raw_fares(spark, d):
    """Orders as captured rows: currencies with and without a rate, carriers and dates that may be missing or wrong."""
    o = read(spark, d, "orders")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    date = F.when(F.col("o_orderkey") % 11 == 0, "soon").when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return o.select("o_orderkey", pick(["inr", " USD", "EUR", "GBP", None, "XXX"]).alias("currency"), pick([" 6e", "ai", "", "SG", None, "QP", "ix"]).alias("carrier"), date.alias("departs"), F.col("o_totalprice").alias("amount"))


def normalized_fares(spark, d):
    """Each captured row with its fare in rupees, or the first reason to drop it."""
    fare = fn.to_inr(F.col("amount"), F.col("currency"), fn.fx_rates("USD=83.2, EUR=90.1,GBP=none"))
    code, day = fn.airline_code(F.col("carrier")), fn.iso_date(F.col("departs"))
    reject = F.when(code.isNull(), "airline code is missing").when(day.isNull(), "unparseable departure date").when(fare.isNull(), "currency not supported")
    return raw_fares(spark, d).select("o_orderkey", code.alias("carrier"), day.alias("day"), F.round(fare, 4).alias("fare"), reject.alias("reject"))


def reject_summary(spark, d):
    return normalized_fares(spark, d).groupBy(F.coalesce("reject", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def text_helpers(spark, d):
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    asked = F.array((key % 3).cast("int"), F.lit(7), (key % 50).cast("int"), F.lit(7))
    once, unknown = fn.valid_horizons(asked, agg.HORIZONS)
    mark = fn.dedupe_fingerprint(F.lit("DEL"), F.lit("BOM"), F.to_date("o_orderdate"), F.lit("6E"), F.when(key % 2 == 0, F.concat(F.lit("6E-"), key)), F.lit("ECONOMY"), F.nullif(F.col("o_orderstatus"), F.lit("O")), key % 3, F.lit(7), F.to_date("o_orderdate"))
    url = F.concat(F.lit("https://a.in/x/"), (key % 100).cast("string"), F.when(key % 2 == 0, "?token=q&b=1").otherwise(""))
    return o.select(
        "o_orderkey", fn.payload_hash(F.when(key % 4 == 0, "").otherwise(F.col("o_orderpriority"))).alias("payload"), mark.alias("fingerprint"), fn.retry_delay((key % 9 + 2)).alias("delay"),
        fn.titleized(F.concat(F.col("o_orderpriority"), F.lit("  CLASS"))).alias("title"), fn.without_query(url).alias("path"), F.array_join(once, ",").alias("horizons"), F.array_join(unknown, ",").alias("unknown"),
    )


def host_spacing(spark, d):
    """When each user's requests may start, two hours apart at least: the greatest of the start asked for and the one before plus the gap."""
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    of = Window.partitionBy("user_id").orderBy("at", "event_id")
    n, gap = F.row_number().over(of), F.lit(7_200_000_000)
    start = F.max(F.col("at") - F.col("_n") * gap).over(of.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * gap
    return e.withColumn("_n", n).withColumn("start", start).select("event_id", "user_id", (F.col("start") - F.col("at")).alias("waits"))


def validator_state(spark, d):
    """What the fences of all routes and horizons hold at the end: how many values and their sum, by key."""
    judged = cl.recursive_fence(cleaning.fence_quotes(spark, d), ["route_id", "horizon"], ["day", "order_id", "line_no", "fare"], "fare").filter("not outlier")
    last = F.row_number().over(Window.partitionBy("route_id", "horizon").orderBy(F.desc("day"), F.desc("order_id"), F.desc("line_no"), F.desc("fare")))
    held = judged.withColumn("_last", last).filter(F.col("_last") <= cl.FENCE_WINDOW)
    return held.groupBy("route_id", "horizon").agg(F.count("*").alias("n"), F.round(F.sum("fare"), 4).alias("total"))


def captured_pages(spark, d):
    found = captures(read(spark, d, "pages"), F.concat("url", F.lit("?token=abc")), "html")
    return found.select("page_id", "url", "sha256", "bucket")


def envelopes(spark, d):
    """Route indices as JSON envelopes, read again by a client: every field must have come through, those that are null too."""
    r = index.route_index(spark, d, **index.NAMED)
    data = F.struct(F.round("index", 4).alias("index"), "publishable", F.split("horizons_included", ",").alias("horizons"), F.when(~F.col("publishable"), "insufficient_horizons").alias("suppressed"))
    text = F.to_json(F.struct(F.lit("ok").alias("status"), data.alias("data"), F.struct(F.col("n_horizons").alias("count"), "period").alias("meta")))
    got = F.from_json(text, "status string, data struct<index: double, publishable: boolean, horizons: array<string>, suppressed: string>, meta struct<count: long, period: int>")
    return r.select("route_id", got.alias("e")).select("route_id", "e.status", "e.data.index", "e.data.publishable", F.array_join("e.data.horizons", "+").alias("horizons"), "e.data.suppressed", "e.meta.count", "e.meta.period")


QUERIES = {
    f.__name__: f
    for f in (
        provenance_guard, observation_scan, observation_latest, headline_rows, national_latest, national_changes, uncertainty_bands, match_quality, route_extremes,
        routes_by_weight, route_search, series_span, value_before, runs_newest, runs_tail, run_counters, usable_by_route, anomaly_counts, corridor_benchmark, seasonal_passthrough, bulletin,
        normalized_fares, reject_summary, text_helpers, host_spacing, validator_state, captured_pages, envelopes,
    )
}

_RUN = analytics.ORACLE["run_status"]
RAW = """WITH raw AS (SELECT o_orderkey, ['inr', ' USD', 'EUR', 'GBP', NULL, 'XXX'][o_orderkey % 6 + 1] AS currency, [' 6e', 'ai', '', 'SG', NULL, 'QP', 'ix'][o_orderkey % 7 + 1] AS carrier,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, o_totalprice AS amount FROM orders), n AS (
  SELECT o_orderkey, nullif(upper(trim(carrier)), '') AS carrier, day, round(CASE upper(trim(coalesce(currency, 'INR'))) WHEN 'INR' THEN amount WHEN 'USD' THEN amount * 83.2::DOUBLE WHEN 'EUR' THEN amount * 90.1::DOUBLE END, 4) AS fare FROM raw
), r AS (SELECT *, CASE WHEN carrier IS NULL THEN 'airline code is missing' WHEN day IS NULL THEN 'unparseable departure date' WHEN fare IS NULL THEN 'currency not supported' END AS reject FROM n)"""

ORACLE = {
    "provenance_guard": f"""WITH {QUOTES_SQL}, g AS (SELECT route_id, horizon, product, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_type,
  string_agg(DISTINCT method, ',' ORDER BY method) AS method FROM quotes GROUP BY ALL)
  SELECT *, CASE WHEN source_type LIKE '%,%' THEN 'mixed_provenance' WHEN method LIKE '%,%' THEN 'MIXED_ACQUISITION_METHODS' END AS refusal FROM g""",
    "observation_scan": f"""WITH {QUOTES_SQL} SELECT route_id, horizon, day, round(fare, 6) AS fare, order_id, line_no FROM valid
  WHERE day BETWEEN '1996-02-01' AND '1997-06-30' AND route_id IN (1, 2, 3, 8) AND horizon IN (7, 30) AND source_type = 'N'""",
    "observation_latest": f"WITH {QUOTES_SQL} SELECT route_id, horizon, day, round(fare, 6) AS fare, order_id, line_no FROM valid ORDER BY day DESC, order_id DESC, line_no DESC, valid.fare DESC LIMIT 50",
    "headline_rows": index.ROUTES
    + """ SELECT period, NULL::INTEGER AS horizon, round(100 * sum(weight * index) / sum(weight), 6) AS index, round(sum(weight), 6) AS coverage, sum(weight) >= 0.7 AS publishable FROM parts GROUP BY period
  UNION ALL SELECT period, horizon, round(100 * sum(weight * index) / sum(weight), 6), round(sum(weight), 6), sum(weight) >= 0.7 FROM cells JOIN weights USING (route_id) GROUP BY period, horizon""",
    "national_latest": "SELECT * FROM (" + index.ORACLE["national_index"] + ") ORDER BY period DESC LIMIT 1",
    "national_changes": "WITH i AS (" + index.ORACLE["national_index"] + """), c AS (
  SELECT i.period, i.index, round(100 * (i.index / p.index - 1), 6) AS change_pct, r.index AS reference, p.index AS was FROM i LEFT JOIN i p ON p.period = i.period - 1 LEFT JOIN i r ON r.period = 1997)
  SELECT period, index, change_pct, CASE WHEN was IS NULL THEN 'insufficient_history' ELSE 'available' END AS status, CASE WHEN was IS NULL THEN 'Not available — the collected series is too short for a yearly comparison'
    ELSE format('{:+.2f}%', change_pct) END AS told, round(CASE WHEN reference IS NULL THEN index ELSE 100 * index / reference END, 6) AS rebased FROM c""",
    "uncertainty_bands": index.UNCERTAIN
    + " SELECT route_id, horizon, period, round(index, 6) AS index, round(index - 1.96::DOUBLE * se, 6) AS low, round(index + 1.96::DOUBLE * se, 6) AS high FROM uncertain WHERE se IS NOT NULL",
    "match_quality": index.PRICES
    + f""", b AS (SELECT route_id, horizon, count(*) AS n_base FROM prices WHERE period = {index.BASE} GROUP BY ALL)
  SELECT route_id, horizon, period, n_matched, n_base, round(level, 6) AS level, round(base_level, 6) AS base_level, round(n_matched / n_base, 6) AS match_rate FROM (
    SELECT route_id, horizon, period, count(*) AS n_matched, exp(avg(ln(price))) AS level, exp(avg(ln(base_price))) AS base_level FROM exact_pairs GROUP BY ALL) JOIN b USING (route_id, horizon)""",
    "route_extremes": index.ROUTES
    + """ SELECT * FROM (SELECT period, route_id, round(index, 6) AS index, row_number() OVER (PARTITION BY period ORDER BY round(routes.index, 6) DESC, route_id) AS from_top,
    row_number() OVER (PARTITION BY period ORDER BY round(routes.index, 6), route_id) AS from_bottom FROM routes WHERE publishable) WHERE from_top <= 5 OR from_bottom <= 5""",
    "routes_by_weight": f"""WITH {QUOTES_SQL}, w AS (SELECT route_id, passengers / sum(passengers) OVER () AS weight FROM basket)
  SELECT route_id, coalesce(n_name, r_name, '???') AS name, coalesce(r_name, '???') AS region, round(weight, 6) AS weight, row_number() OVER (ORDER BY w.weight DESC, route_id) AS rank
  FROM w LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) ON route_id = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON n_regionkey = r_regionkey""",
    "route_search": """SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE (n_name ILIKE '%an%' OR r_name ILIKE '%an%' OR CAST(n_nationkey AS VARCHAR) LIKE '%7%') AND r_name IN ('ASIA', 'EUROPE', 'AMERICA')""",
    "series_span": f"WITH {analytics.DAILY} SELECT event_type, count(*) AS n_points, min(day) AS first_day, max(day) AS last_day, CAST(max(day) - min(day) AS INTEGER) AS span_days FROM s GROUP BY 1",
    "value_before": """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL)
  SELECT user_id, day, lag(day) OVER w AS found_day, round(lag(value) OVER w, 6) AS found FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
    "runs_newest": f"SELECT * FROM ({_RUN}) ORDER BY run DESC LIMIT 10",
    "runs_tail": f"SELECT run, status, row_number() OVER (ORDER BY run) AS place FROM (SELECT * FROM ({_RUN}) ORDER BY run DESC LIMIT 10)",
    "run_counters": "SELECT CAST(ts AS DATE) AS run, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_kinds, count(*) FILTER (WHERE value < 5) AS n_failures, count(*) AS n_attempts FROM events GROUP BY 1",
    "usable_by_route": cleaning.VALIDATED
    + " SELECT route_id, count(*) FILTER (WHERE excluded IS NULL) AS n_usable, count(*) FILTER (WHERE excluded IS NULL AND len(flags) > 0) AS n_flagged, count(*) AS n FROM judged GROUP BY route_id",
    "anomaly_counts": cleaning.VALIDATED
    + """ SELECT flag, count(*) FILTER (WHERE order_id % 5 > 1) AS open, count(*) FILTER (WHERE order_id % 5 = 0) AS confirmed, count(*) FILTER (WHERE order_id % 5 = 1) AS error
  FROM (SELECT order_id, unnest(flags) AS flag FROM judged WHERE excluded IS NULL) GROUP BY flag""",
    "corridor_benchmark": f"""WITH {QUOTES_SQL}, seen AS (SELECT route_id, avg(fare) AS observed FROM valid GROUP BY 1),
  paid AS (SELECT c_nationkey AS route_id, avg(o_totalprice) / 100 AS benchmark FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  SELECT route_id, round(benchmark, 6) AS benchmark, round(observed, 6) AS observed, round(100 * (seen.observed / paid.benchmark - 1), 6) AS gap_pct FROM paid LEFT JOIN seen USING (route_id)""",
    "seasonal_passthrough": f"WITH {analytics.MONTHLY_ORDERS} SELECT day, round(value, 6) AS value, NULL::DOUBLE AS adjusted, 'NOT IMPLEMENTED' AS status FROM m",
    "bulletin": f"""WITH {QUOTES_SQL} SELECT count(*) AS n, round(100 * avg(CASE WHEN fare BETWEEN 500 AND 80000 THEN 1.0 ELSE 0.0 END), 6) AS valid_pct, min(day) AS first_day, max(day) AS last_day,
  count(DISTINCT route_id) AS n_routes, count(DISTINCT horizon) AS n_horizons FROM quotes""",
    "normalized_fares": RAW + " SELECT * FROM r",
    "reject_summary": RAW + " SELECT coalesce(reject, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1",
    "text_helpers": """WITH o AS (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, list_distinct([k % 3, 7, k % 50]) AS any_order FROM orders),
  h AS (SELECT *, list_filter([k % 3, 7, k % 50], lambda x, i: list_position([k % 3, 7, k % 50], x) = i) AS once FROM o)
  SELECT o_orderkey, CASE WHEN k % 4 <> 0 THEN sha256(o_orderpriority) END AS payload,
    substr(sha256(concat_ws('|', 'DEL', 'BOM', CAST(day AS VARCHAR), '6E', CASE WHEN k % 2 = 0 THEN '6E-' || k ELSE 'NOFLIGHT' END, 'ECONOMY', coalesce(nullif(o_orderstatus, 'O'), 'UNSPECIFIED'), CAST(k % 3 AS VARCHAR), 'H7', CAST(day AS VARCHAR))), 1, 32) AS fingerprint,
    least(pow(2.0, k % 9), 30.0)::DOUBLE AS delay, array_to_string(list_transform(string_split(o_orderpriority || ' CLASS', ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title,
    'https://a.in/x/' || (k % 100) AS path, array_to_string(once, ',') AS horizons, array_to_string(list_filter(once, lambda x: NOT list_contains([1, 7, 15, 30, 45], x)), ',') AS unknown FROM h""",
    "host_spacing": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  walk AS (SELECT event_id, user_id, k, t AS start, t FROM e WHERE k = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.k, greatest(e.t, walk.start + 7200000000), e.t FROM walk JOIN e ON e.user_id = walk.user_id AND e.k = walk.k + 1)
  SELECT event_id, user_id, start - t AS waits FROM walk""",
    "validator_state": cleaning.FENCE.replace("SELECT order_id, line_no, route_id, horizon, n_past, coalesce(outlier, false) AS outlier FROM walk WHERE k > 0", "SELECT route_id, horizon, len(held) AS n, round(list_sum(held), 4) AS total FROM walk QUALIFY row_number() OVER (PARTITION BY route_id, horizon ORDER BY k DESC) = 1"),
    "captured_pages": "SELECT page_id, url || '?token=[REDACTED]' AS url, sha256(html) AS sha256, substr(sha256(html), 1, 2) AS bucket FROM pages",
    "envelopes": "SELECT route_id, 'ok' AS status, round(index, 4) AS index, publishable, replace(horizons_included, ',', '+') AS horizons, CASE WHEN NOT publishable THEN 'insufficient_horizons' END AS suppressed, n_horizons AS count, period FROM ("
    + index.named(index.ORACLE["route_index"]) + ")",
}
