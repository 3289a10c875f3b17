"""Index queries over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import elementary as el
from tidemark.operators import governance as gov
from tidemark.sources.store import settle
from tidemark.sources.tables import QUOTES_SQL, WHOLE_SQL, basket, index_quotes, scoped, valid_quotes

BASE = 1995
#: A type and a method, of which some queries are made. The others take quotes of all; guarded_index refuses to.
NAMED = {"source_type": "N", "method": "web_scrape"}


def prices(spark, d, **scope):
    return el.product_prices(index_quotes(spark, d, **scope))


def brand_prices(spark, d):
    """Prices with a brand as the product: so wide that every cell matches several."""
    q = index_quotes(spark, d, **NAMED).withColumns({"product": F.col("carrier"), "spec": F.col("carrier")})
    return el.product_prices(q)


def cells(spark, d, **scope):
    """Elementary cells of direct flights. Prices serve both matchings, and are written once."""
    return el.exact_or_spec(settle(prices(spark, d, **scope), "prices"), BASE)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def product_geomean_prices(spark, d):
    return prices(spark, d).drop("spec").withColumn("price", F.round("price", 7))


def base_price_set(spark, d):
    return (prices(spark, d).filter(F.col("period") == BASE).select("route_id", "horizon", "product", "price", "n_quotes").withColumn("price", F.round("price", 7)))


def jevons_elementary(spark, d):
    return rounded(el.jevons(el.matched(prices(spark, d), "product", BASE)).drop("log_sd"), "index")


def carli_elementary(spark, d):
    return rounded(el.carli(el.matched(brand_prices(spark, d), "product", BASE)), "index")


def dutot_elementary(spark, d):
    return rounded(el.dutot(el.matched(prices(spark, d), "product", BASE)), "index")


def gm_ratio_elementary(spark, d):
    return rounded(el.geomean_ratio(prices(spark, d), BASE), "index")


def jevons_time_reversal(spark, d):
    pairs = el.matched(el.spec_prices(prices(spark, d)), "spec", BASE)
    inside = pairs.filter(F.col("price") / F.col("base_price") == el.clip(F.col("price") / F.col("base_price")))
    turned = inside.select(*el.CELL, "spec", F.col("base_price").alias("price"), F.col("price").alias("base_price"))
    there = inside.groupBy(*el.CELL).agg(el.geomean(F.col("price") / F.col("base_price")).alias("forward"))
    back = turned.groupBy(*el.CELL).agg(el.geomean(F.col("price") / F.col("base_price")).alias("backward"))
    return rounded(there.join(back, el.CELL).withColumn("product", F.col("forward") * F.col("backward")), "forward", "backward", "product")


def product_churn(spark, d):
    return el.churn(prices(spark, d), BASE)


def reappeared_products(spark, d):
    return el.reappeared(prices(spark, d), BASE)


def spec_fallback_index(spark, d):
    return rounded(cells(spark, d).drop("log_sd"), "index")


def elementary_uncertainty(spark, d):
    return rounded(el.with_uncertainty(cells(spark, d)), "index", "se", "ci_low", "ci_high")


def route_weights(spark, d):
    return rounded(agg.weights(basket(spark, d)), "weight")


def route_index(spark, d, **scope):
    return rounded(agg.route_indices(cells(spark, d, **scope)), "index", "weight_present")


def national_index(spark, d):
    c = cells(spark, d)
    routes = agg.route_indices(c).filter("publishable")
    found = agg.national(routes, agg.weights(basket(spark, d)), ["period"])
    return rounded(found, "coverage", "index")


def national_by_horizon(spark, d):
    found = agg.national(cells(spark, d).drop("n_matched"), agg.weights(basket(spark, d)), ["period", "horizon"])
    return rounded(found, "coverage", "index")


def parts(spark, d):
    return agg.contributions(agg.route_indices(cells(spark, d)).filter("publishable"), agg.weights(basket(spark, d)))


def national_contributions(spark, d):
    return rounded(parts(spark, d), "weight", "index", "points", "share_pct")


def missing_routes(spark, d):
    c = settle(cells(spark, d), "cells")
    return rounded(agg.missing_routes(agg.route_indices(c), c, agg.weights(basket(spark, d))), "weight")


def change_decomposition(spark, d):
    return rounded(agg.decompose_change(settle(parts(spark, d), "parts")), "change_points", "share_pct")


def national_index_with_connections(spark, d):
    routes = agg.route_indices(cells(spark, d, direct_only=False)).filter("publishable")
    return rounded(agg.national(routes, agg.weights(basket(spark, d)), ["period"]), "coverage", "index")


def guarded_index(spark, d, **scope):
    """The national index with its guard: of what is named in scope, and nothing else is assumed."""
    unnamed = {"source_type": None, "method": None} | scope
    routes = agg.route_indices(cells(spark, d, **unnamed)).filter("publishable")
    found = agg.national(routes, agg.weights(basket(spark, d)), ["period"]).select("period", "index", "coverage")
    return gov.guarded(rounded(found, "index", "coverage"), settle(gov.index_guard(scoped(valid_quotes(spark, d), **unnamed), BASE), "guard"))


def national_index_unnamed(spark, d):
    """Refused: the quotes are of several types."""
    return guarded_index(spark, d)


def national_index_by_scope(spark, d):
    """One type with all its methods is refused, one type and method gives figures; so does a type that has one method."""
    asked = {"type": {"source_type": "N"}, "both": NAMED, "method": {"method": "api"}}
    found = [guarded_index(spark, d, **scope).withColumn("scope", F.lit(name)) for name, scope in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def national_uncertainty(spark, d):
    return rounded(agg.national_uncertainty(el.with_uncertainty(cells(spark, d)), agg.weights(basket(spark, d))), "se_reference", "se_corrected")


PRICES = f"""WITH {WHOLE_SQL}, prices AS (
  SELECT route_id, horizon, period, product, spec, exp(avg(ln(fare))) AS price, count(*) AS n_quotes FROM direct GROUP BY ALL
), exact_pairs AS (
  SELECT c.route_id, c.horizon, c.period, c.price, b.price AS base_price
  FROM prices c JOIN prices b ON c.route_id = b.route_id AND c.horizon = b.horizon AND c.product = b.product
  WHERE b.period = {BASE} AND c.period > {BASE}
), spec_prices AS (
  SELECT route_id, horizon, period, spec, exp(avg(ln(price))) AS price, sum(n_quotes) AS n_quotes FROM prices GROUP BY ALL
), spec_pairs AS (
  SELECT c.route_id, c.horizon, c.period, c.spec, c.price, b.price AS base_price
  FROM spec_prices c JOIN spec_prices b ON c.route_id = b.route_id AND c.horizon = b.horizon AND c.spec = b.spec
  WHERE b.period = {BASE} AND c.period > {BASE}
)"""


def _jevons_sql(name: str, pairs: str, least: int) -> str:
    return f""", {name}_rel AS (
  SELECT route_id, horizon, period, CASE WHEN price / base_price < 0.1 OR price / base_price > 10 THEN 1 ELSE 0 END AS clipped,
         least(greatest(price / base_price, 0.1), 10.0) AS rel FROM {pairs}
), {name}_bound AS (
  SELECT route_id, horizon, period, count(*) AS n, quantile_cont(rel, 0.01) AS lo, quantile_cont(rel, 0.99) AS hi FROM {name}_rel GROUP BY ALL
), {name} AS (
  SELECT route_id, horizon, period, count(*) AS n_matched, CAST(sum(clipped) AS BIGINT) AS n_clipped,
         exp(avg(ln(w))) AS index, stddev_samp(ln(w)) AS log_sd
  FROM (SELECT r.*, CASE WHEN n >= 10 THEN least(greatest(rel, lo), hi) ELSE rel END AS w
        FROM {name}_rel r JOIN {name}_bound USING (route_id, horizon, period))
  GROUP BY ALL HAVING count(*) >= {least}
)"""


def named(sql: str) -> str:
    """sql over the quotes of NAMED alone."""
    return sql.replace(WHOLE_SQL, QUOTES_SQL)


BRANDS = named(PRICES).replace("period, product, spec, exp(avg(ln(fare))) AS price", "period, carrier AS product, carrier AS spec, exp(avg(ln(fare))) AS price")
EXACT = PRICES + _jevons_sql("exact", "exact_pairs", 3)
CELLS = (
    EXACT
    + _jevons_sql("spec_cells", "spec_pairs", 2)
    + """, cells AS (
  SELECT *, 'exact' AS method FROM exact
  UNION ALL SELECT *, 'spec' AS method FROM spec_cells s
  WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.route_id = s.route_id AND e.horizon = s.horizon AND e.period = s.period)
), weights AS (SELECT route_id, passengers, passengers / sum(passengers) OVER () AS weight FROM basket)"""
)
ROUTES = (
    CELLS
    + """, routes AS (
  SELECT route_id, period, sum(0.2 * index) / sum(0.2) AS index, count(*) AS n_horizons, sum(0.2::DOUBLE) AS weight_present,
         list_sort(list(horizon)) AS present, count(*) >= 2 AS publishable
  FROM cells WHERE n_matched >= 3 GROUP BY route_id, period
), parts AS (
  SELECT period, route_id, weight, index, 100 * weight * index / sum(weight) OVER (PARTITION BY period) AS points
  FROM routes JOIN weights USING (route_id) WHERE publishable
)"""
)
UNCERTAIN = (
    CELLS
    + ", t AS (SELECT unnest([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,25,30,40,60,120]) AS df, unnest([12.706,4.303,3.182,2.776,2.571,2.447,2.365,2.306,2.262,2.228,2.201,2.179,2.160,2.145,2.131,2.120,2.110,2.101,2.093,2.086,2.060,2.042,2.021,2.000,1.980]::DOUBLE[]) AS t)"
    + """, judged AS (
  SELECT c.*, CASE WHEN n_matched - 1 > 120 THEN 1.959964 ELSE (SELECT arg_max(t, df) FROM t WHERE df <= n_matched - 1) END * log_sd / sqrt(n_matched) AS half,
         CASE WHEN n_matched < 3 THEN 'too_few' WHEN log_sd <= 1e-12 THEN 'no_spread' ELSE 'log_relatives' END AS basis
  FROM cells c
), uncertain AS (
  SELECT route_id, horizon, period, n_matched, index, basis,
         CASE basis WHEN 'too_few' THEN NULL WHEN 'no_spread' THEN 0.0 ELSE index * log_sd / sqrt(n_matched) END AS se,
         CASE basis WHEN 'too_few' THEN NULL WHEN 'no_spread' THEN index ELSE exp(ln(index) - half) END AS ci_low,
         CASE basis WHEN 'too_few' THEN NULL WHEN 'no_spread' THEN index ELSE exp(ln(index) + half) END AS ci_high
  FROM judged
)"""
)

QUERIES = {
    f.__name__: f
    for f in (
        national_index, product_geomean_prices, base_price_set, jevons_elementary, carli_elementary, dutot_elementary, gm_ratio_elementary,
        jevons_time_reversal, product_churn, reappeared_products, spec_fallback_index, elementary_uncertainty, route_weights, route_index,
        national_by_horizon, national_contributions, missing_routes, change_decomposition, national_uncertainty, national_index_with_connections,
        national_index_unnamed, national_index_by_scope,
    )
}

ORACLE = {
    "product_geomean_prices": PRICES + " SELECT route_id, horizon, period, product, round(price, 7) AS price, n_quotes FROM prices",
    "base_price_set": PRICES + f" SELECT route_id, horizon, product, round(price, 7) AS price, n_quotes FROM prices WHERE period = {BASE}",
    "jevons_elementary": EXACT + " SELECT route_id, horizon, period, n_matched, n_clipped, round(index, 6) AS index FROM exact",
    "carli_elementary": BRANDS + " SELECT route_id, horizon, period, count(*) AS n_matched, round(avg(price / base_price), 6) AS index FROM exact_pairs GROUP BY ALL HAVING count(*) >= 3",
    "dutot_elementary": PRICES + " SELECT route_id, horizon, period, count(*) AS n_matched, round(avg(price) / avg(base_price), 6) AS index FROM exact_pairs GROUP BY ALL HAVING count(*) >= 3",
    "gm_ratio_elementary": PRICES
    + f""", bound AS (
  SELECT route_id, horizon, period, count(*) AS n, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM prices GROUP BY ALL
), level AS (
  SELECT route_id, horizon, period, count(*) AS n, exp(avg(ln(CASE WHEN n >= 10 THEN least(greatest(price, lo), hi) ELSE price END))) AS level
  FROM prices JOIN bound USING (route_id, horizon, period) GROUP BY ALL
) SELECT c.route_id, c.horizon, c.period, c.n, b.n AS n_base, round(c.level / b.level, 6) AS index
  FROM level c JOIN level b ON c.route_id = b.route_id AND c.horizon = b.horizon
  WHERE b.period = {BASE} AND c.period > {BASE} AND c.n >= 3 AND b.n >= 3""",
    "jevons_time_reversal": PRICES
    + """ SELECT route_id, horizon, period, round(exp(avg(ln(price / base_price))), 6) AS forward, round(exp(avg(ln(base_price / price))), 6) AS backward,
  round(exp(avg(ln(price / base_price))) * exp(avg(ln(base_price / price))), 6) AS product
  FROM spec_pairs WHERE price / base_price BETWEEN 0.1 AND 10 GROUP BY ALL""",
    "product_churn": PRICES
    + f""", now AS (SELECT route_id, horizon, period, product FROM prices WHERE period > {BASE}),
was AS (SELECT c.route_id, c.horizon, c.period, b.product FROM (SELECT DISTINCT route_id, horizon, period FROM now) c
  JOIN prices b ON b.route_id = c.route_id AND b.horizon = c.horizon AND b.period = {BASE})
SELECT route_id, horizon, period, count(*) FILTER (WHERE n AND w) AS n_matched, count(*) FILTER (WHERE n) AS n_current, count(*) FILTER (WHERE w) AS n_base,
  count(*) FILTER (WHERE n AND NOT w) AS n_new, count(*) FILTER (WHERE w AND NOT n) AS n_gone
FROM (SELECT route_id, horizon, period, product, bool_or(n) AS n, bool_or(w) AS w
      FROM (SELECT *, true AS n, false AS w FROM now UNION ALL SELECT *, false, true FROM was) GROUP BY ALL) GROUP BY ALL""",
    "reappeared_products": PRICES
    + f""" SELECT route_id, horizon, period, count(*) AS n_new, count(*) FILTER (WHERE EXISTS (
    SELECT 1 FROM prices e WHERE e.route_id = p.route_id AND e.horizon = p.horizon AND e.product = p.product AND e.period > {BASE} AND e.period < p.period)) AS n_reappeared
  FROM prices p WHERE period > {BASE} AND NOT EXISTS (
    SELECT 1 FROM prices b WHERE b.route_id = p.route_id AND b.horizon = p.horizon AND b.product = p.product AND b.period = {BASE}) GROUP BY ALL""",
    "spec_fallback_index": CELLS + " SELECT route_id, horizon, period, n_matched, n_clipped, round(index, 6) AS index, method FROM cells",
    "elementary_uncertainty": UNCERTAIN
    + " SELECT route_id, horizon, period, n_matched, round(index, 6) AS index, round(se, 6) AS se, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, basis FROM uncertain",
    "route_weights": f"WITH {QUOTES_SQL} SELECT route_id, passengers, round(passengers / sum(passengers) OVER (), 6) AS weight FROM basket",
    "route_index": ROUTES
    + """ SELECT route_id, period, round(index, 6) AS index, n_horizons, round(weight_present, 6) AS weight_present, array_to_string(present, ',') AS horizons_included,
  array_to_string(list_filter([1, 7, 15, 30, 45], lambda h: NOT list_contains(present, h)), ',') AS horizons_missing, publishable FROM routes""",
    "national_index": ROUTES
    + """ SELECT period, count(*) AS n_routes, round(sum(weight), 6) AS coverage, round(100 * sum(weight * index) / sum(weight), 6) AS index,
  sum(weight) >= 0.7 AS publishable, abs(sum(weight) - 1) > 1e-9 AS renormalised FROM parts GROUP BY period""",
    "national_by_horizon": CELLS
    + """ SELECT period, horizon, count(*) AS n_routes, round(sum(weight), 6) AS coverage, round(100 * sum(weight * index) / sum(weight), 6) AS index,
  sum(weight) >= 0.7 AS publishable, abs(sum(weight) - 1) > 1e-9 AS renormalised FROM cells JOIN weights USING (route_id) GROUP BY period, horizon""",
    "national_contributions": ROUTES
    + """ SELECT period, route_id, round(weight, 6) AS weight, round(index, 6) AS index, round(points, 6) AS points,
  round(100 * points / sum(points) OVER (PARTITION BY period), 6) AS share_pct, row_number() OVER (PARTITION BY period ORDER BY points DESC, route_id) AS rank FROM parts""",
    "missing_routes": ROUTES
    + """ SELECT p.period, w.route_id, round(w.weight, 6) AS weight,
  CASE WHEN EXISTS (SELECT 1 FROM cells c WHERE c.route_id = w.route_id AND c.period = p.period) THEN 'insufficient_horizons' ELSE 'route_not_collected' END AS reason
  FROM (SELECT DISTINCT period FROM cells) p CROSS JOIN weights w
  WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE r.publishable AND r.route_id = w.route_id AND r.period = p.period)""",
    "change_decomposition": ROUTES
    + """, moved AS (SELECT c.period, c.route_id, c.points - b.points AS change_points FROM parts c JOIN parts b ON b.route_id = c.route_id AND b.period = c.period - 1)
  SELECT period, route_id, round(change_points, 6) AS change_points, round(100 * change_points / sum(change_points) OVER (PARTITION BY period), 6) AS share_pct,
  row_number() OVER (PARTITION BY period ORDER BY round(abs(change_points), 9) DESC, route_id) AS rank FROM moved""",
    "national_uncertainty": UNCERTAIN
    + """, route_se AS (SELECT route_id, period, CASE WHEN count(se) = count(*) THEN sqrt(sum(se * se)) / count(*) END AS se
  FROM uncertain WHERE n_matched >= 3 GROUP BY ALL HAVING count(*) >= 2)
  SELECT period, count(*) AS n_routes, round(CASE WHEN count(se) = count(*) THEN sqrt(sum(weight * weight * se * se)) END, 6) AS se_reference,
  round(CASE WHEN count(se) = count(*) THEN 100 * sqrt(sum(weight * weight * se * se)) / sum(weight) END, 6) AS se_corrected
  FROM route_se JOIN weights USING (route_id) GROUP BY period""",
}
ORACLE["national_index_with_connections"] = ORACLE["national_index"].replace("FROM direct GROUP BY ALL", "FROM valid GROUP BY ALL")


def _guarded_sql(scope: str) -> str:
    """The national index over a scope, and the guard's row over it: types and methods of base and later quotes."""
    body = named(ORACLE["national_index"]).replace("FROM direct GROUP BY ALL", f"FROM valid WHERE stops = 0 AND {scope} GROUP BY ALL")
    return f"""(WITH i AS ({body}), u AS (WITH {QUOTES_SQL} SELECT * FROM valid WHERE period >= {BASE} AND {scope}), g AS (
  SELECT coalesce(string_agg(DISTINCT source_type, ',' ORDER BY source_type), '') AS source_types, coalesce(string_agg(DISTINCT method, ',' ORDER BY method), '') AS methods,
    CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE period = {BASE}) = 0 THEN 'no_base_period_data' WHEN count(DISTINCT source_type) > 1 THEN 'mixed_provenance'
      WHEN count(DISTINCT method) > 1 THEN 'MIXED_ACQUISITION_METHODS' END AS refusal FROM u)
  SELECT period, index, coverage, source_types, methods, refusal FROM i, g WHERE refusal IS NULL
  UNION ALL SELECT NULL, NULL, NULL, source_types, methods, refusal FROM g WHERE refusal IS NOT NULL)"""


ORACLE["national_index_unnamed"] = "SELECT * FROM " + _guarded_sql("true")
ORACLE["national_index_by_scope"] = " UNION ALL ".join(
    f"SELECT *, '{name}' AS scope FROM " + _guarded_sql(scope)
    for name, scope in (("type", "source_type = 'N'"), ("both", "source_type = 'N' AND method = 'web_scrape'"), ("method", "method = 'api'"))
)
