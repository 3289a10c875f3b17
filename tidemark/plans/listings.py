"""SQL functions, searches with facets, registry rules, listings and the bulletin, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.functions import sql as sq
from tidemark.operators import aggregates as agg
from tidemark.operators import elementary as el
from tidemark.operators import governance as gov
from tidemark.operators import search as se
from tidemark.operators import series as sr
from tidemark.plans import cleaning, index
from tidemark.sources.store import settle
from tidemark.sources.tables import FARE_MAX, FARE_MIN, QUOTES_SQL, basket, index_quotes, quotes, read, scoped, valid_quotes


def sql_functions(spark, d):
    """Bands, tiers, fees and tariff parts, written in SQL over the registered functions."""
    sq.register(spark)
    return spark.sql(
        """SELECT p_partkey, time_band(clock) AS band, canonical_tier(family) AS tier, airport_fee(airport) AS fee,
             tariff_base(total, airport) AS base_fare, tariff_taxes(total, airport) AS taxes, tariff_fee(total, airport) AS airport_part, tariff_convenience(total, airport) AS convenience,
             tariff_base(total, airport, 350D) AS base_of_site
           FROM (SELECT *, CAST(p_partkey % 97 * 53 AS DOUBLE) AS total FROM {fields})""",
        fields=cleaning.fields(spark, d),
    )


def airports(spark, d):
    n = read(spark, d, "nation").filter("n_nationkey % 7 <> 3")  # some codes are known to no airport
    r = read(spark, d, "region")
    code = F.upper(F.substring("n_name", 1, 3))
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(code, F.col("n_nationkey").cast("string")).alias("code"), F.initcap("n_name").alias("city"), F.col("r_name").alias("state"), F.concat(F.initcap("n_name"), F.lit(" International")).alias("name")
    )


def routes(spark, d):
    """Pairs of the nations that sell and buy, with what was sold between them."""
    line, order = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    sold = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    s, c = read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    pairs = sold.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n_sold"))
    code = lambda key, name: F.concat(F.upper(F.substring(name, 1, 3)), F.col(key).cast("string"))
    n = read(spark, d, "nation")
    ends = [F.broadcast(n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"_{k}"))) for k in ("s_nationkey", "c_nationkey")]
    named = pairs.join(ends[0], "s_nationkey").join(ends[1], "c_nationkey")
    return named.select((F.col("s_nationkey") * 25 + F.col("c_nationkey") + 1).cast("int").alias("route_id"), code("s_nationkey", "_s_nationkey").alias("origin_code"), code("c_nationkey", "_c_nationkey").alias("dest_code"), "n_sold")


def route_finder(spark, d):
    """Routes from Asia whose code, cities, states or names hold the text, or both ends' pair."""
    found = se.route_hits(se.with_airports(routes(spark, d), airports(spark, d)), " a -> ", origin_state="ASIA")
    two = se.route_hits(se.with_airports(routes(spark, d), airports(spark, d)), " Inter", dest_state="EUROPE", category="CUSTOM")
    return found.unionByName(two).select("route_id", "origin_code", "dest_code", "category", "origin_state", "dest_state", "n_sold")


def route_facets(spark, d):
    """How many routes with an "a" in a field each category and state has, and how many there are."""
    return se.facet_counts(se.route_hits(se.with_airports(routes(spark, d), airports(spark, d)), "ia"))


def registry_documents(spark, d):
    """A registry in JSON for each ten suppliers, with faults of every kind; some are no dictionaries or have no sources."""
    k = F.col("s_suppkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    source = F.struct(
        F.when(k % 9 != 0, F.concat(F.lit("s"), k.cast("string"))).alias("source_id"), F.when(k % 7 != 0, F.col("s_name")).otherwise("").alias("display_name"), F.when(k % 5 != 0, "op").alias("operator"),
        pick(["API", "WEB_SCRAPE", "api", None, "SIMULATED", "OFFLINE_FIXTURE"]).alias("acquisition_method"), pick(["APPROVED", "PENDING", "EXPIRED", "odd", None, "AVAILABLE_AFTER_FREE_REGISTRATION", "APPROVED"]).alias("permission_status"),
        F.when(k % 4 != 0, (k % 6 - 1).cast("int")).alias("maximum_requests_per_day"), F.when(k % 3 != 0, "mail").alias("contact"),
    )
    doc = F.floor(k / 10)
    made = read(spark, d, "supplier").groupBy(doc.alias("registry")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), source.alias("s")))).alias("rows"))  # ten rows a document
    sources = F.transform("rows", lambda r: r.s)
    n = F.col("registry")
    text = F.when(n % 11 == 7, F.to_json(sources)).when(n % 11 == 8, '{"registry_version": "1", "sources": []}').when(n % 11 == 9, '{"sources": 5}').when(n % 11 == 10, "{cut").otherwise(
        F.to_json(F.struct(F.when(n % 3 != 0, "1.0").alias("registry_version"), sources.alias("sources")))
    )
    return made.select("registry", text.alias("text"))


def registry_faults(spark, d):
    return gov.registry_errors(registry_documents(spark, d), "text")


def registry_validation(spark, d):
    """How many sources have each kind of fault."""
    kind = F.regexp_replace(F.regexp_replace("error", r"^sources\[\d+\]( \([^)]*\))?: ", ""), r" '[^']*', must be.*", "")
    return registry_faults(spark, d).groupBy(kind.alias("fault")).agg(F.count("*").alias("n"))


def horizon_listing(spark, d):
    """Index cells, newest period first, then by route and horizon: five hundred rows at most."""
    rows = index.cells(spark, d, **index.NAMED).select(*el.CELL, F.round(100 * F.col("index"), 4).alias("index_100"), "n_matched", "method")
    return se.listing(rows, [F.desc("period"), F.col("route_id"), F.col("horizon")], 500)


def horizon_analysis(spark, d):
    """Fares of each horizon, and of its index cells in the newest period the mean and the products matched."""
    q = valid_quotes(spark, d).select("horizon", "fare")
    levels = q.groupBy("horizon").agg(F.count("*").alias("n"), *[F.round(f("fare"), 6).alias(name) for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])
    middle = sr.medians(q, ["horizon"], "fare").select("horizon", F.round("median", 6).alias("median"))
    c = settle(index.cells(spark, d, **index.NAMED), "cells")
    newest = c.join(F.broadcast(c.agg(F.max("period").alias("period"))), "period")
    indexed = newest.groupBy("horizon").agg(F.count("*").alias("n_routes"), F.round(100 * F.avg("index"), 4).alias("mean_index"), F.sum("n_matched").alias("n_matched"))
    return levels.join(middle, "horizon").join(indexed, "horizon", "left")


def anomalies(spark, d):
    """A row for each flag of a quote that may be used, with the state of its review."""
    status = F.when(F.col("order_id") % 5 == 0, "confirmed_genuine").when(F.col("order_id") % 5 == 1, "confirmed_error").otherwise("open")
    v = cleaning.validated(spark, d).filter("excluded is null and size(flags) > 0")
    return v.select("order_id", "line_no", "route_id", "day", F.array_join("flags", ",").alias("flags"), status.alias("status"))


def anomaly_list(spark, d):
    """The newest fifty open ones of all, and of one route."""
    order = [F.desc("day"), F.desc("order_id"), F.desc("line_no")]
    a = settle(anomalies(spark, d), "anomalies")
    return se.listing(a, order, 50, status="open").withColumn("asked", F.lit("open")).unionByName(se.listing(a, order, 50, route_id=7).withColumn("asked", F.lit("route")))


def observation_search(spark, d):
    """Quotes of one origin and one status that have the text in flight, route, airline or source."""
    q = quotes(spark, d).select(
        "order_id", "line_no", F.concat(F.substring("carrier", 7, 2), F.lit("-"), (F.col("product") % 900 + 100).cast("string")).alias("flight"), F.concat(F.lit("R"), F.col("route_id").cast("string"), F.lit("-H"), F.col("horizon").cast("string")).alias("route"),
        F.col("carrier").alias("airline"), F.when(F.col("line_no") != 3, F.concat(F.lit("src_"), F.lower("source_type"))).alias("source"), (F.col("fare").between(FARE_MIN, FARE_MAX)).cast("string").alias("is_valid"), F.col("route_id").cast("string").alias("origin"),
    )
    return se.text_hits(q, " 7-H3 ", ["flight", "route", "airline", "source"], is_valid="true").select("order_id", "line_no").unionByName(
        se.text_hits(q, "SRC_a", ["flight", "route", "airline", "source"], origin="7").select("order_id", "line_no")
    )


def monthly_national(spark, d):
    """The national index by month over carriers' mean prices, against all of the base year: each month stands at its last day with quotes."""
    q = index_quotes(spark, d, **index.NAMED).withColumns({"product": F.col("carrier"), "spec": F.col("carrier"), "horizon": F.lit(0)})
    month = F.year("day") * 100 + F.month("day")
    based = q.withColumn("period", F.when(F.year("day") == index.BASE, 0).otherwise(month)).filter(F.year("day") >= index.BASE)
    pairs = el.matched(settle(el.product_prices(based), "monthly-prices"), "product", 0)
    cells = el.jevons(pairs, 3).select("route_id", "period", "index")
    found = agg.national(cells, agg.weights(basket(spark, d)), ["period"]).filter("publishable").select("period", F.col("index").alias("value"))
    last = based.filter("period > 0").groupBy("period").agg(F.max("day").alias("day"))
    return found.join(last, "period").select("day", "value")


def index_changes(spark, d):
    """The monthly index with its change on the nearest day a month and a year before."""
    s, out = settle(monthly_national(spark, d).withColumn("series", F.lit("national")), "monthly"), None
    for kind, months in (("mom", 1), ("yoy", 12)):
        found = sr.nearest(s, ["series"], months)
        pct, status = sr.period_change(F.col("value"), F.col("previous"))
        told = fn.change_text(F.round(pct, 4), status, "monthly" if kind == "mom" else "yearly")
        found = found.select(F.lit(kind).alias("kind"), "day", F.round("value", 6).alias("value"), "matched_day", F.round(pct, 4).alias("change_pct"), status.alias("status"), told.alias("told"))
        out = found if out is None else out.unionByName(found)
    return out


def bulletin_report(spark, d):
    """The newest period's figures in one row: index, coverage, quality, the five highest and lowest routes, horizons, what is missing and open."""
    c = settle(index.cells(spark, d, **index.NAMED), "cells")
    w = agg.weights(basket(spark, d))
    r = settle(agg.route_indices(c).filter("publishable"), "routes")
    newest = r.agg(F.max("period").alias("period"))
    head = agg.national(r, w, ["period"]).join(F.broadcast(newest), "period").select("period", F.round("index", 4).alias("index"), F.round("coverage", 6).alias("coverage"), "n_routes", "publishable")
    own = r.join(F.broadcast(newest), "period")
    place = lambda o: F.row_number().over(Window.partitionBy("period").orderBy(o, "route_id"))  # noqa: E731  one row a route
    ranked = own.select("period", "route_id", F.round("index", 6).alias("index")).withColumns({"top": place(F.desc("index")), "low": place(F.asc("index"))})
    line = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(at) <= 5, F.struct(at, "route_id", "index")))), lambda x: F.format_string("%d=%.4f", x.route_id, x["index"])), " ")
    extremes = ranked.groupBy("period").agg(line("top").alias("top_routes"), line("low").alias("bottom_routes"))
    by = c.join(F.broadcast(newest), "period").groupBy("period", "horizon").agg(F.count("*").alias("n"), F.avg("index").alias("mean"), F.sum("n_matched").alias("matched"))
    horizons = by.groupBy("period").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("horizon", "n", "mean", "matched"))), lambda x: F.format_string("T+%d:%d:%.4f:%d", x.horizon, x.n, 100 * x["mean"], x.matched)), " ").alias("horizons"))
    missing = agg.missing_routes(r, c, w).join(F.broadcast(newest), "period").agg(F.count("*").alias("n_missing"))
    every = scoped(quotes(spark, d), **index.NAMED)
    quality = every.agg(F.count("*").alias("n_observations"), F.round(100 * F.avg(F.col("fare").between(FARE_MIN, FARE_MAX).cast("double")), 2).alias("quality_pct"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    opened = anomalies(spark, d).filter("status = 'open'").agg(F.count("*").alias("anomalies_open"))
    whole = head.join(extremes, "period").join(horizons, "period")
    for one in (missing, quality, opened):  # one row each
        whole = whole.join(F.broadcast(one), F.lit(True))
    return whole


QUERIES = {
    f.__name__: f
    for f in (sql_functions, route_finder, route_facets, registry_faults, registry_validation, horizon_listing, horizon_analysis, anomaly_list, observation_search, index_changes, bulletin_report)
}

_FEES = "CASE airport WHEN 'DEL' THEN 320 WHEN 'BOM' THEN 340 WHEN 'GOX' THEN 350 ELSE 220 END::DOUBLE"


def _tariff(c: str) -> str:
    return f"CASE WHEN total > fee + 236 + {c} + 500 THEN round((total - 236 - fee - {c}) / 1.05, 2) ELSE round(total * 0.75, 2) END"


_ROUTES = """WITH n AS (SELECT n_nationkey AS k, upper(n_name[:3]) || n_nationkey AS code, upper(n_name[1]) || lower(n_name[2:]) AS one, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
air AS (SELECT code, array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS city, r_name AS state, array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' International' AS name
  FROM n WHERE k % 7 <> 3),
p AS (SELECT s_nationkey AS s, c_nationkey AS c, count(*) AS n_sold FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT (s * 25 + c + 1)::INTEGER AS route_id, a.code AS origin_code, b.code AS dest_code, n_sold, CASE WHEN s * 25 + c + 1 <= 25 THEN 'BASKET' ELSE 'CUSTOM' END AS category, x.state AS origin_state, y.state AS dest_state,
  [lower(a.code || '-' || b.code), lower(x.city), lower(y.city), lower(x.state), lower(y.state), lower(x.name), lower(y.name), lower(coalesce(x.city, '') || '-' || coalesce(y.city, '')), lower(coalesce(x.state, '') || '-' || coalesce(y.state, ''))] AS fields
  FROM p JOIN n a ON a.k = s JOIN n b ON b.k = c LEFT JOIN air x ON x.code = a.code LEFT JOIN air y ON y.code = b.code)"""
_HAS = "len(list_filter(fields, lambda f: contains(f, '{}'))) > 0"
_METHODS, _STATUSES = (str(x).replace("'", "''") for x in (gov.METHODS, gov.STATUSES))
_REGISTRY = f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey // 10 AS registry, (row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) - 1)::INTEGER AS "at", CASE WHEN s_suppkey % 9 <> 0 THEN 's' || s_suppkey END AS id,
    ['API', 'WEB_SCRAPE', 'api', NULL, 'SIMULATED', 'OFFLINE_FIXTURE'][s_suppkey % 6 + 1] AS method, ['APPROVED', 'PENDING', 'EXPIRED', 'odd', NULL, 'AVAILABLE_AFTER_FREE_REGISTRATION', 'APPROVED'][s_suppkey % 7 + 1] AS status,
    coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 6 - 1 END, 0) AS budget FROM supplier),
  d AS (SELECT DISTINCT registry FROM s), ok AS (SELECT *, 'sources[' || s."at" || ']' AS p, 'sources[' || s."at" || '] (' || coalesce(id, 'None') || '): ' AS q, coalesce(status, '') IN ('APPROVED', 'AVAILABLE_AFTER_FREE_REGISTRATION') AS live FROM s WHERE registry % 11 < 7),
  e AS (SELECT registry, NULL::INTEGER AS "at", 'Registry root must be a YAML dictionary' AS error FROM d WHERE registry % 11 IN (7, 10)
    UNION ALL SELECT registry, NULL, 'Missing required ''registry_version''' FROM d WHERE (registry % 11 < 7 AND registry % 3 = 0) OR registry % 11 = 9
    UNION ALL SELECT registry, NULL, 'Registry must contain a non-empty ''sources'' list' FROM d WHERE registry % 11 IN (8, 9)
    UNION ALL SELECT registry, "at", p || ': missing ''source_id''' FROM ok WHERE id IS NULL UNION ALL SELECT registry, "at", p || ': missing ''display_name''' FROM ok WHERE k % 7 = 0 UNION ALL SELECT registry, "at", p || ': missing ''operator''' FROM ok WHERE k % 5 = 0
    UNION ALL SELECT registry, "at", q || 'invalid acquisition_method ''' || coalesce(method, 'None') || ''', must be one of {_METHODS}' FROM ok WHERE coalesce(method, 'api') = 'api'
    UNION ALL SELECT registry, "at", q || 'invalid permission_status ''' || coalesce(status, 'None') || ''', must be one of {_STATUSES}' FROM ok WHERE coalesce(status, 'odd') = 'odd'
    UNION ALL SELECT registry, "at", q || 'maximum_requests_per_day cannot be negative' FROM ok WHERE budget < 0 UNION ALL SELECT registry, "at", q || 'maximum_requests_per_day must be > 0' FROM ok WHERE live AND budget = 0
    UNION ALL SELECT registry, "at", q || 'contact information is required' FROM ok WHERE live AND budget >= 0 AND k % 3 = 0)"""
_ANOMALIES = cleaning.VALIDATED + """, a AS (SELECT order_id, line_no, route_id, day, array_to_string(flags, ',') AS flags, CASE order_id % 5 WHEN 0 THEN 'confirmed_genuine' WHEN 1 THEN 'confirmed_error' ELSE 'open' END AS status FROM judged WHERE excluded IS NULL AND len(flags) > 0)"""
_MONTHS = f"""WITH {QUOTES_SQL}, q AS (SELECT route_id, carrier, fare, day, CASE WHEN year(day) = {index.BASE} THEN 0 ELSE year(day) * 100 + month(day) END AS period FROM direct WHERE year(day) >= {index.BASE}),
  pr AS (SELECT route_id, period, carrier, exp(avg(ln(fare))) AS price FROM q GROUP BY ALL), rl AS (SELECT n.route_id, n.period, least(greatest(n.price / b.price, 0.1), 10.0) AS rel FROM pr n JOIN pr b USING (route_id, carrier) WHERE b.period = 0 AND n.period > 0),
  bd AS (SELECT route_id, period, count(*) AS n, quantile_cont(rel, 0.01) AS lo, quantile_cont(rel, 0.99) AS hi FROM rl GROUP BY ALL),
  ce AS (SELECT route_id, period, exp(avg(ln(CASE WHEN n >= 10 THEN least(greatest(rel, lo), hi) ELSE rel END))) AS index FROM rl JOIN bd USING (route_id, period) GROUP BY ALL HAVING count(*) >= 3),
  w AS (SELECT route_id, passengers / sum(passengers) OVER () AS weight FROM basket),
  na AS (SELECT period, 100 * sum(weight * index) / sum(weight) AS value FROM ce JOIN w USING (route_id) GROUP BY period HAVING sum(weight) >= 0.7),
  s AS (SELECT d.day, value FROM na JOIN (SELECT period, max(day) AS day FROM q GROUP BY 1) d USING (period))"""

ORACLE = {
    "sql_functions": cleaning.FIELDS
    + f""", t AS (SELECT *, (p_partkey % 97 * 53)::DOUBLE AS total FROM h), b AS (SELECT *, {_tariff("300")} AS base_fare, {_tariff("350")} AS base_of_site, total > fee + 236 + 300 + 500 AS whole FROM t),
  x AS (SELECT *, CASE WHEN whole THEN round(round(base_fare * 0.05, 2) + 236, 2) ELSE round(total * 0.15, 2) END AS taxes, CASE WHEN whole THEN fee ELSE round(total * 0.05, 2) END AS airport_part FROM b)
  SELECT p_partkey, CASE WHEN half IN ('AM', 'PM') OR hh < 24 THEN band ELSE 'UNSPECIFIED' END AS band, tier, fee, base_fare, taxes, airport_part, round(total - base_fare - taxes - airport_part, 2) AS convenience, base_of_site FROM x""",
    "route_finder": _ROUTES
    + f""" SELECT route_id, origin_code, dest_code, category, origin_state, dest_state, n_sold FROM r WHERE origin_state = 'ASIA' AND {_HAS.format("a-")}
  UNION ALL SELECT route_id, origin_code, dest_code, category, origin_state, dest_state, n_sold FROM r WHERE category = 'CUSTOM' AND dest_state = 'EUROPE' AND {_HAS.format("inter")}""",
    "route_facets": _ROUTES
    + f""", h AS (SELECT * FROM r WHERE {_HAS.format("ia")}) SELECT 'category' AS facet, category AS value, count(*) AS n FROM h GROUP BY category
  UNION ALL SELECT 'origin_state', origin_state, count(*) FROM h GROUP BY origin_state UNION ALL SELECT 'dest_state', dest_state, count(*) FROM h GROUP BY dest_state UNION ALL SELECT 'all', NULL, count(*) FROM h""",
    "registry_faults": _REGISTRY + ' SELECT registry, "at", error FROM e',
    "registry_validation": _REGISTRY + r""" SELECT regexp_replace(regexp_replace(error, '^sources\[\d+\]( \([^)]*\))?: ', ''), ' ''[^'']*'', must be.*', '') AS fault, count(*) AS n FROM e GROUP BY 1""",
    "horizon_listing": index.named(index.CELLS) + " SELECT route_id, horizon, period, round(100 * index, 4) AS index_100, n_matched, method FROM cells ORDER BY period DESC, route_id, horizon LIMIT 500",
    "horizon_analysis": index.named(index.CELLS)
    + """, l AS (SELECT horizon, count(*) AS n, round(avg(fare), 6) AS mean, round(min(fare), 6) AS least, round(max(fare), 6) AS most, round(quantile_cont(fare, 0.5), 6) AS median FROM valid GROUP BY 1),
  i AS (SELECT horizon, count(*) AS n_routes, round(100 * avg(index), 4) AS mean_index, sum(n_matched)::BIGINT AS n_matched FROM cells WHERE period = (SELECT max(period) FROM cells) GROUP BY 1)
  SELECT l.*, n_routes, mean_index, n_matched FROM l LEFT JOIN i USING (horizon)""",
    "anomaly_list": _ANOMALIES
    + """ SELECT *, 'open' AS asked FROM (SELECT * FROM a WHERE status = 'open' ORDER BY day DESC, order_id DESC, line_no DESC LIMIT 50)
  UNION ALL SELECT *, 'route' FROM (SELECT * FROM a WHERE route_id = 7 ORDER BY day DESC, order_id DESC, line_no DESC LIMIT 50)""",
    "observation_search": f"""WITH {QUOTES_SQL}, o AS (SELECT order_id, line_no, fare, route_id, concat_ws(chr(10), substr(carrier, 7, 2) || '-' || (product % 900 + 100), 'R' || route_id || '-H' || horizon, carrier, CASE WHEN line_no <> 3 THEN 'src_' || source_type END) AS text FROM quotes)
  SELECT order_id, line_no FROM o WHERE text ILIKE '%7-h3%' AND fare BETWEEN 500 AND 80000 UNION ALL SELECT order_id, line_no FROM o WHERE contains(lower(text), 'src_a') AND route_id = 7""",
    "index_changes": _MONTHS
    + """, m AS (SELECT 'mom' AS kind, day, value, CAST(day - INTERVAL 1 MONTH AS DATE) AS anchor FROM s UNION ALL SELECT 'yoy', day, value, CAST(day - INTERVAL 12 MONTH AS DATE) FROM s),
  f AS (SELECT m.kind, m.day, m.value, p.day AS matched_day, p.value AS previous FROM m LEFT JOIN s p ON abs(p.day - anchor) <= 7 AND date_trunc('month', p.day) = date_trunc('month', anchor)
    QUALIFY row_number() OVER (PARTITION BY m.kind, m.day ORDER BY abs(p.day - anchor), p.day) = 1)
  SELECT kind, day, round(value, 6) AS value, matched_day, round(100 * (value / previous - 1), 4) AS change_pct, CASE WHEN previous IS NULL THEN 'insufficient_history' ELSE 'available' END AS status,
    CASE WHEN previous IS NULL THEN 'Not available — the collected series is too short for a ' || CASE kind WHEN 'mom' THEN 'monthly' ELSE 'yearly' END || ' comparison' ELSE format('{:+.2f}%', round(100 * (value / previous - 1), 4)) END AS told FROM f""",
    "bulletin_report": index.named(index.ROUTES).replace(f"WITH {QUOTES_SQL}", cleaning.VALIDATED, 1)
    + """, newest AS (SELECT max(period) AS period FROM routes WHERE publishable), own AS (SELECT * FROM routes WHERE publishable AND period = (SELECT period FROM newest)),
  ranked AS (SELECT route_id, round(index, 6) AS v, row_number() OVER (ORDER BY round(own.index, 6) DESC, route_id) AS top, row_number() OVER (ORDER BY round(own.index, 6), route_id) AS low FROM own),
  hz AS (SELECT horizon, count(*) AS n, avg(index) AS mean, sum(n_matched)::BIGINT AS matched FROM cells WHERE period = (SELECT period FROM newest) GROUP BY horizon),
  every AS (SELECT * FROM quotes WHERE source_type = 'N' AND method = 'web_scrape')
  SELECT period, round(100 * sum(weight * index) / sum(weight), 4) AS index, round(sum(weight), 6) AS coverage, count(*) AS n_routes, sum(weight) >= 0.7 AS publishable,
    (SELECT string_agg(printf('%d=%.4f', route_id, v), ' ' ORDER BY top) FROM ranked WHERE top <= 5) AS top_routes, (SELECT string_agg(printf('%d=%.4f', route_id, v), ' ' ORDER BY low) FROM ranked WHERE low <= 5) AS bottom_routes,
    (SELECT string_agg(printf('T+%d:%d:%.4f:%d', horizon, n, 100 * mean, matched), ' ' ORDER BY horizon) FROM hz) AS horizons, (SELECT count(*) FROM weights WHERE route_id NOT IN (SELECT route_id FROM own)) AS n_missing,
    (SELECT count(*) FROM every) AS n_observations, (SELECT round(100 * avg(CASE WHEN fare BETWEEN 500 AND 80000 THEN 1.0::DOUBLE ELSE 0.0 END), 2) FROM every) AS quality_pct, (SELECT min(day) FROM every) AS first_day, (SELECT max(day) FROM every) AS last_day,
    (SELECT count(*) FROM judged WHERE excluded IS NULL AND len(flags) > 0 AND order_id % 5 > 1) AS anomalies_open
  FROM parts WHERE period = (SELECT period FROM newest) GROUP BY period""",
}
