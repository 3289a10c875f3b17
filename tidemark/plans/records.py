"""What is kept beside the figures: registries, reviews, states, runs and revisions; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.operators import aggregates as agg
from tidemark.operators import cleaning as cl
from tidemark.operators import elementary as el
from tidemark.operators import governance as gov
from tidemark.plans import analytics, cleaning, index
from tidemark.sources import registries as reg
from tidemark.sources.store import recomputed, register, review_revisions, revisions, settle, with_reviews
from tidemark.sources.tables import QUOTES_SQL, index_quotes, quotes, read, valid_quotes

FENCE_KEY, FENCE_ORDER, SPLIT = ["route_id", "horizon"], ["day", "order_id", "line_no", "fare"], "1997-07-01"


def basket_documents(spark, d):
    """A basket in JSON for each region; one has a route twice, one has none, one is no JSON."""
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("pax"))), F.col("n_nationkey") == F.col("c_nationkey"))
    route = F.struct(
        F.when(F.col("n_regionkey") == 2, F.lit(7)).otherwise(F.col("n_nationkey")).alias("route_id"), F.lower(F.substring("n_name", 1, 3)).alias("origin_code"), F.lit("bom").alias("destination_code"), F.col("pax").alias("monthly_pax"),
    )
    routes = n.groupBy(F.col("n_regionkey").alias("basket")).agg(F.collect_list(route).alias("routes"))  # 25 rows
    kept = F.when(F.col("basket") != 3, F.col("routes")).otherwise(F.slice("routes", 1, 0))
    text = F.to_json(F.struct(F.lit("1.0").alias("basket_version"), kept.alias("routes")))
    return routes.select("basket", F.when(F.col("basket") == 4, "{routes").otherwise(text).alias("text"))


def basket_load(spark, d):
    found = reg.baskets(basket_documents(spark, d), "text")
    return found.select("basket", "basket_version", "route_id", "origin_code", "destination_code", "monthly_pax", "is_active", F.round("weight", 6).alias("weight"), "fault")


# Weights that policies declare, by region: none, five, one too few, a wrong sum.
DECLARED = {0: None, 1: '{"1": 0.4, "7": 0.3, "15": 0.1, "30": 0.1, "45": 0.1}', 2: '{"1": 0.5, "7": 0.3, "15": 0.1, "30": 0.1}', 3: '{"1": 0.5, "7": 0.3, "15": 0.1, "30": 0.1, "45": 0.1}'}


def policy_documents(spark, d):
    key = F.col("r_regionkey")
    days = '"horizons": [' + ", ".join(f'{{"days": {h}}}' for h in agg.HORIZONS) + "]"
    text = F.lit('{"policy_version": "1", "horizons": []}')
    for k, w in DECLARED.items():
        text = F.when(key == k, '{"policy_version": "1", ' + days + (f', "weighting": {{"method": "own", "weights": {w}}}' if w else "") + "}").otherwise(text)
    return read(spark, d, "region").select(key.alias("policy"), text.alias("text"))


def policy_load(spark, d):
    return reg.policies(policy_documents(spark, d), "text").select("policy", "policy_version", "horizon", "label", F.round("alpha", 6).alias("alpha"), "fault")


def weighted_horizon_index(spark, d):
    """Route indices with unequal horizon weights, which a policy declares."""
    policy = reg.policies(policy_documents(spark, d).filter("policy = 1"), "text").select("horizon", "alpha")
    found = agg.route_indices_by(index.cells(spark, d), policy)
    return index.rounded(found, "index", "weight_present")


def base_window_index(spark, d):
    """Elementary indices by month against all of a base of nine months."""
    q = index_quotes(spark, d).withColumn("period", F.year("day") * 100 + F.month("day"))
    pairs = el.matched(el.product_prices(el.base_window(q, "1995-02-15", "1995-11-14")), "product", 0)
    return index.rounded(el.jevons(pairs, 1).drop("log_sd"), "index")


def source_capabilities(spark, d):
    """The capability table in its order, with how many suppliers name each source and how many quotes they gave."""
    table = reg.ranked_sources(reg.capabilities(spark))
    names = F.array(*[F.lit(c[0]) for c in reg.CAPABILITIES])
    named = read(spark, d, "supplier").select("s_suppkey", F.element_at(names, (F.col("s_suppkey") % len(reg.CAPABILITIES) + 1).cast("int")).alias("name"))
    sold = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    seen = named.join(sold, "s_suppkey", "left").groupBy("name").agg(F.count("*").alias("n_suppliers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_quotes"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return seen.join(F.broadcast(table), "name", "right").select("name", "source_type", "enabled", "requires_credentials", "place", none("n_suppliers"), none("n_quotes"))


def official_documents(spark, d):
    """An official series in JSON for each year of orders; a year has a month twice, one a value that is missing, one is cut."""
    month = F.trunc("o_orderdate", "month")
    m = read(spark, d, "orders").groupBy(month.alias("m")).agg(F.round(F.avg("o_totalprice") / 1000, 8).alias("v"), F.count("*").alias("n"))
    year = F.year("m")
    label = F.when((year == 1993) & (F.month("m") == 2), "1993-01").otherwise(F.date_format("m", "yyyy-MM"))
    point = F.struct(
        label.alias("month"), F.when((year != 1994) | (F.month("m") > 1), F.col("v")).alias("airfare_item_index"), (F.col("v") + 1).alias("transport_index"), (F.col("n") / 1.0).alias("cpi_combined"),
        F.when(F.month("m") % 2 == 0, F.date_format(F.last_day("m"), "yyyy-MM-dd")).alias("mospi_release_date"), F.when(F.month("m") == 12, "PROVISIONAL").alias("status"),
    )
    made = m.groupBy(year.alias("year")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(point)).alias("monthly_benchmarks"))).alias("text"))  # twelve points
    return made.select("year", F.when(F.col("year") == 1996, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"))


def official_load(spark, d):
    return reg.official(official_documents(spark, d), "text")


def benchmark_load(spark, d):
    """A benchmark in JSON for each month of orders, with and without a yield; those of every February have a day that is none."""
    o = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") / 1000, 8).alias("v"))
    label = F.when((F.month("day") == 2) & (F.dayofmonth("day") == 1), "soon").otherwise(F.date_format("day", "yyyy-MM-dd"))
    point = F.struct(label.alias("date"), F.col("v").alias("dgca_benchmark_index"), F.when(F.dayofmonth("day") % 2 == 0, F.col("v") / 100).alias("observed_yield_rpkm"))
    made = o.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(point)).alias("daily_benchmarks"))).alias("text"))
    return reg.benchmark(made, "text").withColumn("yield_rpkm", F.round("yield_rpkm", 6))


def error_details(spark, d):
    """What is shown of replies' errors: bodies with and without a title, a detail or a list, and no JSON."""
    k = F.col("o_orderkey")
    error = F.struct(F.when(k % 3 != 0, F.concat(F.lit("E"), k.cast("string"))).alias("title"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("detail"), F.lit("hidden").alias("source"))
    body = F.when(k % 7 == 0, "<html>").when(k % 7 == 1, '{"errors": []}').when(k % 7 == 2, '{"error": "x"}').otherwise(F.to_json(F.struct(F.array(error, error).alias("errors"))))
    return read(spark, d, "orders").select("o_orderkey", fn.error_detail(body).alias("told"))


def festive_windows(spark, d):
    """Orders of thirty years before within each festival's days, against all orders: the calendar is twelve rows."""
    o = read(spark, d, "orders").select(F.add_months(F.to_date("o_orderdate"), 360).alias("day"), "o_totalprice")
    inside = o.join(F.broadcast(reg.calendar(spark)), F.col("day").between(F.col("first_day"), F.col("last_day")))
    seen = inside.groupBy("festival", "first_day", "last_day", "surge_pct", "severity").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    whole = o.agg(F.avg("o_totalprice").alias("_all"))
    return seen.join(F.broadcast(whole), F.lit(True)).withColumn("observed_pct", F.round(100 * (F.col("mean") / F.col("_all") - 1), 6)).withColumn("mean", F.round("mean", 6)).drop("_all")


def spider_items(spark, d):
    """Scraped totals within their bounds, unbundled with the spiders' convenience fee."""
    o = read(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 3, 0).alias("total")).filter("total between 500 and 95000")
    return o.select("o_orderkey", "total", *[F.round(c, 2).alias(n) for n, c in fn.unbundle(F.col("total"), F.lit("DEL"), 350.0).items()])


def redact_capture(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    headers = F.create_map(F.lit("Cookie"), F.col("url"), F.lit("Accept"), F.col("url"), F.lit("X-API-Key"), F.lit("k"), F.lit("own-client-secret"), F.lit("s"))
    text = F.concat(F.lit('{"access_token" : "'), F.col("page_id").cast("string"), F.lit('", "h": "bearer ab.c-'), F.col("page_id").cast("string"), F.lit('==", "u": "'), F.col("url"), F.lit('"}'))
    told = F.transform(F.array_sort(F.map_entries(fn.redact_headers(headers))), lambda e: F.concat(e.key, F.lit("="), e.value))
    return p.select("page_id", F.array_join(told, ";").alias("headers"), fn.redact_text(text).alias("text"))


def counts_by_method(spark, d):
    method = F.when(F.col("source_type") == "R", "api").when(F.col("source_type") == "A", "web_scrape")
    return quotes(spark, d).groupBy(F.coalesce(method, F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))


def scheduled_cells(spark, d):
    """Every scheduled route, horizon and time band with what was observed of it. The schedule is a few hundred rows."""
    band = F.element_at(F.array(*[F.lit(b) for b in fn.BANDS]), ((F.col("order_id") + F.col("line_no")) % 4 + 1).cast("int"))
    seen = valid_quotes(spark, d).groupBy("route_id", "horizon", band.alias("band")).agg(F.count("*").alias("n"))
    routes = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("route_id"))
    plan = routes.select("route_id", F.explode(F.array(*[F.lit(h) for h in agg.HORIZONS])).alias("horizon")).select("*", F.explode(F.array(*[F.lit(b) for b in fn.BANDS])).alias("band"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return plan.join(seen, ["route_id", "horizon", "band"], "left").select("route_id", "horizon", "band", n.alias("n"), (n > 0).alias("observed"))


def budget_evaluation(spark, d):
    """Usage of each source and day against the source's own limits, a row a source."""
    limits = read(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.ceil(F.count("*") / 20).alias("per_day"), F.ceil(F.count("*") / 2).alias("per_month"))
    u = analytics.usage(spark, d).join(limits, "source")
    share = lambda used, most: F.when(F.col(most) > 0, 100 * (F.col(used) + 1) / F.col(most)).otherwise(0.0)
    pct = F.greatest(share("used_day", "per_day"), share("used_month", "per_month"))
    status = F.when(pct >= 100, "QUOTA_EXHAUSTED").when(pct >= 95, "REDUCED_BASKET").when(pct >= 80, "WARNING").otherwise("NORMAL")
    return u.select("source", "day", "per_day", "per_month", F.round(pct, 6).alias("projected_pct"), status.alias("status"))


def attempts(spark, d):
    """Events as attempts: runs are a user's days, an attempt's rows and failure follow its value."""
    day = F.to_date("ts")
    mode = F.element_at(F.array(F.lit("live"), F.lit("simulated"), F.lit("offline"), F.lit("live")), (F.dayofyear(day) % 4 + 1).cast("int"))
    status = F.when(F.col("value") < 15, "UNAVAILABLE").when(F.col("value") < 25, "FAILED").otherwise("SUCCESS")
    error = F.when(F.col("event_id") % 3 > 0, F.element_at(F.array(F.lit("timeout"), F.lit("blocked")), (F.col("event_id") % 3).cast("int")))
    return read(spark, d, "events").select("user_id", day.alias("day"), mode.alias("mode"), status.alias("status"), F.when(status == "SUCCESS", F.col("event_id") % 4).otherwise(0).alias("n_rows"), error.alias("error"))


def run_outcomes(spark, d):
    return gov.run_status(attempts(spark, d), ["user_id", "day"])


def source_register(spark, d):
    """Suppliers registered twice: the second time some are gone, some new, and others disabled."""
    s, key = read(spark, d, "supplier"), F.col("s_suppkey")
    told = lambda kept, enabled, at: s.filter(kept).select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("kind"), enabled.alias("enabled"), F.to_date(F.lit(at)).alias("at"))
    known = register(None, told(key % 4 != 0, key % 2 == 0, "2024-01-01"), "name", "at")
    return register(known, told(key % 3 != 0, key % 5 == 0, "2024-02-01"), "name", "at")


def judged(spark, d):
    v = cleaning.validated(spark, d).select("order_id", "line_no", "route_id", "horizon", "day", F.col("excluded").isNull().alias("is_valid"), (F.size("flags") > 0).alias("flagged"))
    return v.withColumn("observation", F.concat_ws("-", "order_id", "line_no"))


def reviews(spark, d):
    """Of flagged observations: some reviewed once, some again with another verdict."""
    o = settle(judged(spark, d), "judged")
    one = o.filter("flagged and order_id % 5 < 3").select("observation", F.when(F.col("order_id") % 5 == 1, "error").otherwise("genuine").alias("verdict"), F.lit(1).alias("reviewed_at"))
    two = o.filter("flagged and order_id % 10 in (1, 2)").select("observation", F.when(F.col("order_id") % 10 == 2, "error").otherwise("genuine").alias("verdict"), F.lit(2).alias("reviewed_at"))
    return o, one.unionByName(two).distinct()


def reviewed_observations(spark, d):
    o, r = reviews(spark, d)
    return with_reviews(o, r, "observation").groupBy("route_id").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"), F.count_if(F.col("verdict") == "error").alias("n_error"), F.count_if(F.col("verdict") == "genuine").alias("n_genuine"))


def reviewed_revisions(spark, d):
    o, r = reviews(spark, d)
    return review_revisions(o, r, "observation").groupBy("route_id", "horizon", "day", "revision").agg(F.count("*").alias("n"))


def fence_restored(spark, d):
    """Verdicts of the quotes from a day on, by fences restored from what those before it left."""
    q = settle(cleaning.fence_quotes(spark, d), "fence")
    before = cl.recursive_fence(q.filter(F.col("day") < F.lit(SPLIT).cast("date")), FENCE_KEY, FENCE_ORDER, "fare")
    state = settle(cl.export_fences(before, FENCE_KEY, FENCE_ORDER, "fare"), "state")
    after = cl.recursive_fence(q.filter(F.col("day") >= F.lit(SPLIT).cast("date")), FENCE_KEY, FENCE_ORDER, "fare", state=state)
    return after.select("order_id", "line_no", "route_id", "horizon", "n_past", "outlier")


def fence_state(spark, d):
    found = cl.recursive_fence(cleaning.fence_quotes(spark, d), FENCE_KEY, FENCE_ORDER, "fare")
    return settle(cl.export_fences(settle(found, "fenced"), FENCE_KEY, FENCE_ORDER, "fare"), "state")


def fence_export(spark, d):
    held = F.aggregate("held", F.lit(0.0), lambda a, x: a + x)
    return fence_state(spark, d).select(*FENCE_KEY, F.size("held").alias("n_held"), F.round(held, 4).alias("total"), F.round(F.try_element_at("held", F.lit(1)), 6).alias("oldest"), F.round(F.try_element_at("held", F.lit(-1)), 6).alias("newest"), "withheld")


def fence_diagnostics(spark, d):
    return cl.diagnostics(fence_state(spark, d))


def reference_days(spark, d):
    """Daily reference levels of each route and horizon, of its newest ninety days."""
    m = cl.prior_day_medians(cleaning.fence_quotes(spark, d), FENCE_KEY, "day", "fare").drop("prior_median")
    return cl.newest_days(m, FENCE_KEY, "day").withColumn("median", F.round("median", 6))


def late_recompute(spark, d):
    """Months published without their late lines, seventh ones of large quantity, and what is published again once those come."""
    line = read(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", ((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)).alias("late"))
    level = lambda df: df.groupBy("month").agg(F.round(F.avg("l_extendedprice"), 6).alias("level"))
    on_time, late = line.filter("not late or late is null").drop("late"), line.filter("late").drop("late")
    published, again = level(on_time), settle(recomputed(on_time, late, "month", level), "again")
    changed = revisions(published.join(again.select("month"), "month", "left_semi"), again, ["month"], "level")
    return changed.replace("recomputation", "late_data", subset=["kind"])


def latest_computed(spark, d):
    """The newest month's row among two computations of a series, by month, then by when it was computed."""
    s = analytics.order_days(spark, d)
    two = s.select("day", F.round("value", 6).alias("value"), F.lit(1).alias("computed_at")).unionByName(s.select("day", F.round(F.col("value") * 2, 6).alias("value"), F.lit(2).alias("computed_at")))
    return two.agg(F.max_by(F.struct("day", "value", "computed_at"), F.struct("day", "computed_at")).alias("_row")).select("_row.*")


def history_window(spark, d):
    """The series of each event type within seven days up to a given one, in place of its last rows."""
    end = F.lit("2024-01-20").cast("date")
    return analytics.daily(spark, d).filter(F.col("day").between(F.date_sub(end, 7), end)).withColumn("value", F.round("value", 6))


def newest_movers(spark, d):
    """The greatest rises among the newest 1,500 quotes."""
    return analytics._top(analytics.movers(spark, d, newest=1500), True)


def revisions_newest(spark, d):
    place = F.row_number().over(Window.orderBy(F.desc("year"))).cast("long")  # a row a year
    return analytics.revision_diff(spark, d).filter("revision <> 'unchanged'").select("year", "revision", place.alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        basket_load, policy_load, weighted_horizon_index, base_window_index, source_capabilities, official_load, benchmark_load, error_details, festive_windows, spider_items, redact_capture, counts_by_method, scheduled_cells,
        budget_evaluation, run_outcomes, source_register, reviewed_observations, reviewed_revisions, fence_restored, fence_export, fence_diagnostics, reference_days, late_recompute,
        latest_computed, history_window, newest_movers, revisions_newest,
    )
}

_WALK = cleaning.FENCE.replace("SELECT order_id, line_no, route_id, horizon, n_past, coalesce(outlier, false) AS outlier FROM walk WHERE k > 0", "").rstrip()
_STATE = """, last AS (SELECT *, row_number() OVER (PARTITION BY route_id, horizon ORDER BY k DESC) AS back, count(*) FILTER (WHERE outlier) OVER (PARTITION BY route_id, horizon) AS withheld FROM walk WHERE k > 0)
SELECT {} FROM last WHERE back = 1"""
REVIEWED = cleaning.VALIDATED + """, o AS (SELECT order_id, line_no, order_id || '-' || line_no AS observation, route_id, horizon, day, excluded IS NULL AS is_valid, len(flags) > 0 AS flagged FROM judged),
r AS (SELECT DISTINCT observation, CASE WHEN order_id % 10 = 2 THEN 'error' WHEN order_id % 10 = 1 THEN 'genuine' WHEN order_id % 5 = 1 THEN 'error' ELSE 'genuine' END AS verdict FROM o WHERE flagged AND order_id % 5 < 3),
v AS (SELECT o.*, verdict FROM o LEFT JOIN r USING (observation))"""
MONTHS = index.PRICES.replace("FROM direct GROUP BY ALL", "FROM windowed GROUP BY ALL").replace(
    ", prices AS (",
    """, windowed AS (
  SELECT * REPLACE (CASE WHEN day <= '1995-11-14' THEN 0 ELSE CAST(year(day) * 100 + month(day) AS INTEGER) END AS period) FROM direct WHERE day >= '1995-02-15'
), prices AS (""",
).replace(f"b.period = {index.BASE} AND c.period > {index.BASE}", "b.period = 0 AND c.period > 0")
_ALPHA = "CASE horizon WHEN 1 THEN 0.4 WHEN 7 THEN 0.3 ELSE 0.1 END::DOUBLE"
_CALENDAR = ", ".join(f"('{f}', DATE '{a}', DATE '{b}', {s}::DOUBLE, '{v}')" for f, *days, s, _, v in reg.CALENDAR for a, b in (days[:2], days[2:]))

ORACLE = {
    "basket_load": """WITH n AS (SELECT n_regionkey AS basket, n_nationkey AS route_id, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS pax FROM nation)
  SELECT basket, '1.0' AS basket_version, CAST(route_id AS INTEGER) AS route_id, upper(substr(n_name, 1, 3)) AS origin_code, 'BOM' AS destination_code, pax AS monthly_pax, true AS is_active,
    round(pax / sum(pax) OVER (PARTITION BY basket), 6) AS weight, NULL AS fault FROM n WHERE basket < 2 AND pax > 0
  UNION ALL SELECT basket, CASE WHEN basket <> 4 THEN '1.0' END, NULL, NULL, NULL, NULL, false, NULL, ['duplicate route_id', 'no routes', 'not a JSON basket'][basket - 1] FROM (SELECT DISTINCT basket FROM n WHERE basket >= 2 AND pax > 0)""",
    "policy_load": """SELECT r_regionkey AS policy, '1' AS policy_version, h AS horizon, 'T+' || h AS label, CASE WHEN r_regionkey = 0 THEN 0.2 WHEN h = 1 THEN 0.4 WHEN h = 7 THEN 0.3 ELSE 0.1 END::DOUBLE AS alpha, NULL AS fault
    FROM region, (SELECT unnest([1, 7, 15, 30, 45]) AS h) WHERE r_regionkey < 2
  UNION ALL SELECT r_regionkey, '1', NULL, NULL, NULL, ['horizon without a weight', 'weights do not sum to 1', 'no horizons'][r_regionkey - 1] FROM region WHERE r_regionkey >= 2""",
    "weighted_horizon_index": index.CELLS
    + f""" SELECT route_id, period, round(sum({_ALPHA} * index) / sum({_ALPHA}), 6) AS index, count(*) AS n_horizons, round(sum({_ALPHA}), 6) AS weight_present, CAST(sum(n_matched) AS BIGINT) AS n_matched, count(*) >= 2 AS publishable
  FROM cells WHERE n_matched >= 3 GROUP BY route_id, period""",
    "base_window_index": MONTHS + index._jevons_sql("exact", "exact_pairs", 1) + " SELECT route_id, horizon, period, n_matched, n_clipped, round(index, 6) AS index FROM exact",
    "source_capabilities": "WITH c AS (SELECT *, row_number() OVER (ORDER BY source_type, name) AS place FROM (VALUES "
    + ", ".join(f"({i}, '{n}', '{t}', {e}, {c})" for i, (n, t, e, c) in enumerate(reg.CAPABILITIES))
    + f""") s(i, name, source_type, enabled, requires_credentials)), q AS (SELECT s_suppkey, s_suppkey % {len(reg.CAPABILITIES)} AS i, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier)
  SELECT name, source_type, enabled, requires_credentials, place, count(s_suppkey) AS n_suppliers, coalesce(sum(n), 0)::BIGINT AS n_quotes FROM c LEFT JOIN q USING (i) GROUP BY ALL""",
    "official_load": """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, round(avg(o_totalprice) / 1000, 8) AS v, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT *, CAST(year(m) AS INTEGER) AS year FROM m)
  SELECT year, strftime(m, '%Y-%m') AS month, v AS airfare_item_index, v + 1 AS transport_index, n::DOUBLE AS cpi_combined, CASE WHEN month(m) % 2 = 0 THEN last_day(m) END AS release_date, CASE WHEN month(m) = 12 THEN 'PROVISIONAL' ELSE 'FINAL' END AS status, NULL AS fault
    FROM y WHERE year NOT IN (1993, 1994, 1996)
  UNION ALL SELECT DISTINCT year, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DATE, NULL, CASE year WHEN 1993 THEN 'duplicate month' WHEN 1994 THEN 'airfare_item_index missing or not positive' ELSE 'not a JSON series' END FROM y WHERE year IN (1993, 1994, 1996)""",
    "benchmark_load": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 1000, 8) AS v FROM orders GROUP BY 1), m AS (SELECT *, strftime(day, '%Y-%m') AS month FROM o), f AS (SELECT month, bool_or(month(day) = 2 AND day(day) = 1) AS wrong FROM m GROUP BY 1)
  SELECT month, day, v AS index, round(CASE WHEN day(day) % 2 = 0 THEN v / 100 ELSE 4.5 END, 6) AS yield_rpkm, NULL AS fault FROM m JOIN f USING (month) WHERE NOT wrong
  UNION ALL SELECT month, NULL, NULL, NULL, 'date missing or malformed' FROM f WHERE wrong""",
    "error_details": """WITH e AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'E' || o_orderkey ELSE '' END || ': ' || CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END AS t FROM orders)
  SELECT o_orderkey, CASE WHEN k % 7 = 0 THEN '(no parseable error body)' WHEN k % 7 < 3 OR trim(t, ': ') = '' THEN '(unspecified error)' ELSE trim(t, ': ') END AS told FROM e""",
    "festive_windows": f"""WITH c(festival, first_day, last_day, surge_pct, severity) AS (VALUES {_CALENDAR}), o AS (SELECT CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) AS day, o_totalprice AS p FROM orders)
  SELECT festival, first_day, last_day, surge_pct, severity, count(*) AS n, round(avg(p), 6) AS mean, round(100 * (avg(p) / (SELECT avg(p) FROM o) - 1), 6) AS observed_pct FROM o JOIN c ON day BETWEEN first_day AND last_day GROUP BY ALL""",
    "spider_items": """WITH t AS (SELECT o_orderkey, round(o_totalprice / 3, 0) AS total FROM orders), b AS (
  SELECT *, total > 236 + 320 + 350 + 500 AS whole, CASE WHEN total > 236 + 320 + 350 + 500 THEN round((total - 236 - 320 - 350) / 1.05, 2) ELSE round(total * 0.75, 2) END AS base_fare FROM t WHERE total BETWEEN 500 AND 95000
), x AS (SELECT *, CASE WHEN whole THEN round(round(base_fare * 0.05, 2) + 236, 2) ELSE round(total * 0.15, 2) END AS taxes, CASE WHEN whole THEN 320.0 ELSE round(total * 0.05, 2) END AS airport_fee FROM b)
  SELECT o_orderkey, total, base_fare, taxes, airport_fee, round(total - base_fare - taxes - airport_fee, 2) AS convenience FROM x""",
    "redact_capture": """SELECT page_id, 'Accept=' || url || ';Cookie=[REDACTED];X-API-Key=[REDACTED];own-client-secret=[REDACTED]' AS headers,
  '{"access_token" : "[REDACTED]", "h": "Bearer [REDACTED]", "u": "' || url || '"}' AS text FROM pages""",
    "counts_by_method": f"WITH {QUOTES_SQL} SELECT CASE source_type WHEN 'R' THEN 'api' WHEN 'A' THEN 'web_scrape' ELSE 'unknown' END AS method, count(*) AS n FROM quotes GROUP BY 1",
    "scheduled_cells": f"""WITH {QUOTES_SQL}, seen AS (SELECT route_id, horizon, (order_id + line_no) % 4 AS place, count(*) AS n FROM valid GROUP BY ALL)
  SELECT CAST(n_nationkey AS INTEGER) AS route_id, h AS horizon, ['00:00-05:59', '06:00-11:59', '12:00-17:59', '18:00-23:59'][b + 1] AS band, coalesce(n, 0) AS n, n IS NOT NULL AS observed
  FROM nation CROSS JOIN (SELECT unnest([1, 7, 15, 30, 45]) AS h) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS b) LEFT JOIN seen ON seen.route_id = n_nationkey AND seen.horizon = h AND place = b""",
    "budget_evaluation": analytics.USAGE
    + """, l AS (SELECT event_type AS source, CAST(ceil(count(*) / 20) AS BIGINT) AS per_day, CAST(ceil(count(*) / 2) AS BIGINT) AS per_month FROM events GROUP BY 1),
  p AS (SELECT source, day, per_day, per_month, greatest(100 * (used_day + 1) / per_day, 100 * (used_month + 1) / per_month) AS pct FROM u JOIN l USING (source))
  SELECT source, day, per_day, per_month, round(pct, 6) AS projected_pct, CASE WHEN pct >= 100 THEN 'QUOTA_EXHAUSTED' WHEN pct >= 95 THEN 'REDUCED_BASKET' WHEN pct >= 80 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM p""",
    "run_outcomes": """WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, ['live', 'simulated', 'offline', 'live'][dayofyear(ts) % 4 + 1] AS mode, CASE WHEN value < 15 THEN 'UNAVAILABLE' WHEN value < 25 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    CASE WHEN value < 25 THEN 0 ELSE event_id % 4 END AS rows_, ['unknown', 'timeout', 'blocked'][event_id % 3 + 1] AS error FROM events),
  g AS (SELECT user_id, day, mode, count(*) AS n_attempts, count(*) FILTER (WHERE status <> 'SUCCESS') AS n_failures, count(*) FILTER (WHERE status = 'UNAVAILABLE') AS absent, CAST(sum(rows_) AS BIGINT) AS n_rows,
    coalesce(string_agg(DISTINCT error, ',' ORDER BY error) FILTER (WHERE status <> 'SUCCESS'), '') AS told FROM a GROUP BY ALL)
  SELECT user_id, day, mode, n_attempts, n_failures, n_rows, CASE WHEN n_rows = 0 THEN CASE WHEN mode = 'live' AND n_failures > 0 AND absent = n_failures THEN 'UNAVAILABLE' ELSE 'FAILED' END
    WHEN mode <> 'live' THEN upper(mode) WHEN n_failures > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN n_rows = 0 THEN told END AS reasons FROM g""",
    "source_register": """SELECT s_name AS name, s_nationkey AS kind, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 = 0 ELSE s_suppkey % 2 = 0 END AS enabled,
    CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS first_seen, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS last_updated
  FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 <> 0""",
    "reviewed_observations": REVIEWED
    + """ SELECT route_id, count(*) AS n, count(*) FILTER (WHERE is_valid AND verdict IS DISTINCT FROM 'error') AS n_valid, count(*) FILTER (WHERE verdict = 'error') AS n_error, count(*) FILTER (WHERE verdict = 'genuine') AS n_genuine FROM v GROUP BY 1""",
    "reviewed_revisions": REVIEWED + " SELECT route_id, horizon, day, 'anomaly_review' AS revision, count(*) AS n FROM v WHERE is_valid AND verdict = 'error' GROUP BY ALL",
    "fence_restored": _WALK.replace("SELECT order_id, line_no, route_id, horizon, fare *", "SELECT day, order_id, line_no, route_id, horizon, fare *")
    + f" SELECT walk.order_id, walk.line_no, route_id, horizon, n_past, coalesce(outlier, false) AS outlier FROM walk JOIN line USING (route_id, horizon, k) WHERE day >= '{SPLIT}'",
    "fence_export": _WALK + _STATE.format("route_id, horizon, CAST(len(held) AS INTEGER) AS n_held, round(list_sum(held), 4) AS total, round(held[1], 6) AS oldest, round(held[-1], 6) AS newest, withheld"),
    "fence_diagnostics": _WALK + _STATE.format("count(*) AS n_keys, count(*) FILTER (WHERE len(held) >= 10) AS n_ready, CAST(sum(withheld) AS BIGINT) AS n_withheld"),
    "reference_days": f"""WITH {QUOTES_SQL}, m AS (SELECT route_id, horizon, day, count(*) AS n, quantile_cont(fare * CASE WHEN order_id % 23 = 0 THEN 10.0 ELSE 1.0 END, 0.5) AS median FROM quotes GROUP BY ALL)
  SELECT route_id, horizon, day, n, round(median, 6) AS median FROM m QUALIFY row_number() OVER (PARTITION BY route_id, horizon ORDER BY day DESC) <= 90""",
    "late_recompute": """WITH l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_extendedprice AS p, coalesce(l_linenumber = 7 AND l_quantity > 45, false) AS late FROM lineitem),
  g AS (SELECT month, round(avg(p) FILTER (WHERE NOT late), 6) AS previous, round(avg(p), 6) AS now, count(*) FILTER (WHERE NOT late) AS n FROM l GROUP BY 1 HAVING count(*) FILTER (WHERE late) > 0)
  SELECT month, previous, now AS new, CASE WHEN n = 0 THEN 'initial_publication' ELSE 'late_data' END AS kind FROM g WHERE previous IS DISTINCT FROM g.now""",
    "latest_computed": f"WITH {analytics.MONTHLY_ORDERS} SELECT day, round(value * 2, 6) AS value, 2 AS computed_at FROM m ORDER BY day DESC LIMIT 1",
    "history_window": f"WITH {analytics.DAILY} SELECT event_type, day, round(value, 6) AS value FROM s WHERE day BETWEEN '2024-01-13' AND '2024-01-20'",
    "newest_movers": analytics.MOVERS.replace(", r AS (", ", newest AS (SELECT * FROM valid ORDER BY day DESC, order_id DESC, line_no DESC, fare DESC LIMIT 1500), r AS (", 1)
    .replace("AS n FROM valid)", "AS n FROM newest)").replace("AS current FROM valid", "AS current FROM newest")
    + analytics.ORACLE["movers_up"][len(analytics.MOVERS) :],
    "revisions_newest": "SELECT year, revision, row_number() OVER (ORDER BY year DESC) AS place FROM (" + analytics.ORACLE["revision_diff"] + ") WHERE revision <> 'unchanged'",
}
