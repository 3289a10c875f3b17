"""Queries that normalise, deduplicate and validate, and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.operators import cleaning as cl
from tidemark.sources.store import computed_once
from tidemark.sources.tables import QUOTES_SQL, quotes, read

FINGERPRINT = ["product", "month"]
PRIORITY = ["R", "A", "N"]


def monthly(spark, d):
    return quotes(spark, d).withColumn("month", F.date_trunc("month", "day").cast("date"))


TIE = ["order_id", "line_no"]
KEPT = ["product", "month", "source_type", "day", "fare", "order_id", "line_no"]


def _kept(df, order):
    return cl.keep_first(df.select(*KEPT), FINGERPRINT, [*order, *TIE]).withColumn("fare", F.round("fare", 7))


def dedupe_priority(spark, d):
    return _kept(monthly(spark, d), [cl.source_rank(F.col("source_type"), PRIORITY), F.col("fare")])


def dedupe_lowest(spark, d):
    return _kept(monthly(spark, d), [F.col("fare"), cl.source_rank(F.col("source_type"), PRIORITY)])


def dedupe_recent(spark, d):
    return _kept(monthly(spark, d), [F.desc("day"), cl.source_rank(F.col("source_type"), PRIORITY), F.col("fare")])


def dedupe_spread(spark, d):
    groups = monthly(spark, d).groupBy(*FINGERPRINT).agg(F.count("*").alias("n"), F.min("fare").alias("lo"), F.max("fare").alias("hi"))
    spread = F.when(F.col("lo") > 0, 100 * (F.col("hi") - F.col("lo")) / F.col("lo"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_kept"), F.sum(F.col("n") - 1).alias("n_dropped"), F.round(F.max(spread), 6).alias("max_spread_pct")
    )


def validated(spark, d):
    """Quotes with parts that need not add up: the base is the price without discount, the taxes are the tariff's; priority 1 is the day itself."""
    q = quotes(spark, d).withColumn("horizon", F.when(F.col("horizon") == 1, 0).otherwise(F.col("horizon")))
    # every 7th line at a tenth of its fare, every 11th at twenty times: as faulty quotes are
    fare = F.when(F.col("order_id") % 7 == 0, F.col("fare") / 10).when(F.col("order_id") % 11 == 0, F.col("fare") * 20).otherwise(F.col("fare"))
    q = q.withColumn("fare", F.round(fare, 4))
    q = q.withColumn("base", F.round(F.col("fare") * (1 - F.col("discount") * 6), 4)).withColumn("taxes", F.round(F.col("fare") - F.col("base") + F.when(F.col("line_no") == 2, 1.5).otherwise(0.0), 4))
    q = computed_once(q, ["fare", "base", "taxes"])
    flags = cl.rule_flags(F.col("fare"), F.col("base"), F.col("taxes"), F.col("horizon"), F.col("stops") == 1)
    return computed_once(q.withColumn("excluded", cl.exclusion(F.col("fare"))).withColumn("flags", flags), ["excluded", "flags"])


def validate_rules(spark, d):
    v = validated(spark, d)
    action = F.when(F.col("excluded").isNotNull(), "excluded").when(F.size("flags") > 0, "flagged").otherwise("accepted")
    return v.select("order_id", "line_no", "product", action.alias("action"), F.coalesce("excluded", F.array_join("flags", ",")).alias("reason"))


def flag_histogram(spark, d):
    """Quotes by flag, beside all quotes and the share that no exclusion hits."""
    v = validated(spark, d)
    told = F.when(F.col("excluded").isNotNull(), F.array("excluded")).otherwise(F.col("flags"))
    flags = v.select(F.explode(told).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    total = v.agg(F.count("*").alias("n_all"), F.round(100 * F.avg(F.col("excluded").isNull().cast("double")), 6).alias("valid_pct"))
    return flags.join(F.broadcast(total), F.lit(True))


def prior_day_change(spark, d):
    """Valid fares by route and horizon against the median of the latest earlier day; each 19th quote is off by a factor."""
    factor = F.when(F.col("order_id") % 19 == 0, F.when(F.col("line_no") % 2 == 0, 6.0).otherwise(0.02)).otherwise(1.0)
    q = quotes(spark, d).withColumn("fare", F.col("fare") * factor)
    m = cl.prior_day_medians(q.filter(F.col("fare").between(cl.FARE_MIN, cl.FARE_MAX)), ["route_id", "horizon"], "day", "fare")
    pct = F.when(F.col("prior_median") > 0, 100 * (F.col("median") - F.col("prior_median")) / F.col("prior_median"))
    return m.select("route_id", "horizon", "day", "n", *[F.round(c, 6).alias(c) for c in ("median", "prior_median")], F.round(pct, 6).alias("change_pct"), cl.change_flag(F.col("median"), F.col("prior_median")).alias("flag"))


def fence_quotes(spark, d):
    """Quotes of a route and horizon by day; each 23rd is ten times as dear."""
    return quotes(spark, d).select("route_id", "horizon", "day", "order_id", "line_no", (F.col("fare") * F.when(F.col("order_id") % 23 == 0, 10.0).otherwise(1.0)).alias("fare"))


def iqr_window_fence(spark, d):
    found = cl.windowed_fence(fence_quotes(spark, d), ["route_id", "horizon"], ["day", "order_id", "line_no", "fare"], "fare")
    return found.select("order_id", "line_no", "route_id", "horizon", "n_past", "outlier")


def iqr_recursive(spark, d):
    found = cl.recursive_fence(fence_quotes(spark, d), ["route_id", "horizon"], ["day", "order_id", "line_no", "fare"], "fare")
    return found.select("order_id", "line_no", "route_id", "horizon", "n_past", "outlier")


def fields(spark, d):
    """Raw text fields made from the tables' strings, for the normalisers."""
    part = read(spark, d, "part")
    clock = F.format_string("%d:%02d %s", F.col("p_partkey") % 14, F.col("p_partkey") % 60, F.element_at(F.array(F.lit("AM"), F.lit("PM"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")))
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % by + 1).cast("int"))
    return part.select(
        "p_partkey", "p_brand", "p_size", clock.alias("clock"), pick(["saver", "FLEX", "Max", "Lite", ""], 5).alias("family"),
        pick(["eco", "premium-economy", " Business ", "F", "bunk"], 5).alias("label"), pick(["15 KG", "1PC", "20", "", "7.5kg"], 5).alias("bag"),
        pick(["yes", "No", "maybe", "1"], 4).alias("refund"), pick(["DEL", "bom ", "XXX", "GOX"], 4).alias("airport"),
        pick(["6e 123", "6E-77", "99", "AB-1", "6E"], 5).alias("number"),
    )


def normalize_fields(spark, d):
    return fields(spark, d).select(
        "p_partkey", fn.time_band(F.col("clock")).alias("band"), fn.canonical_tier(F.col("family")).alias("tier"), fn.cabin(F.col("label")).alias("cabin"),
        fn.baggage_kg(F.col("bag")).alias("bag_kg"), fn.tri_state(F.col("refund")).alias("refundable"), fn.airport_fee(F.col("airport")).alias("fee"),
        fn.flight_number(F.lit("6E"), F.col("number")).alias("flight"), fn.stops(F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3), F.col("p_size") % 5).alias("stops"),
    )


def product_keys(spark, d):
    f = fields(spark, d)
    key = fn.product_key(
        F.upper(F.trim("airport")), F.lit("BLR"), F.lit("6E"), fn.flight_number(F.lit("6E"), F.col("number")), fn.cabin(F.col("label")), F.nullif(F.col("family"), F.lit("")),
        F.col("p_size") % 2, fn.tri_state(F.col("refund")), fn.baggage_kg(F.col("bag")), F.lit(7), fn.time_band(F.col("clock")),
    )
    return f.select("p_partkey", key.alias("product_key"), fn.key_hash(key).alias("key_hash"), fn.spec_key(key).alias("spec_key"))


def tariff_unbundle(spark, d):
    q = read(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 10, 0).alias("total"))
    parts = fn.unbundle(F.col("total"), F.lit("BLR"))
    return q.select("o_orderkey", "total", *[F.round(c, 2).alias(n) for n, c in parts.items()])


def domain_root(spark, d):
    return read(spark, d, "pages").select("page_id", fn.domain_root(F.col("url")).alias("domain"))


def redact_url(spark, d):
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), F.lit("&token=abc&sessionid=9")).otherwise(F.lit("?api_key=xyz&n=1&auth=u")))
    return read(spark, d, "pages").select("page_id", fn.redact_url(url).alias("url"))


def block_detect(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return read(spark, d, "pages").select("page_id", fn.blocked(title, F.col("html"), (F.lit(200) + F.col("page_id") % 3 * 203 % 405).cast("int")).alias("blocked"))


RANK = "CASE source_type WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
MONTHLY = f"WITH {QUOTES_SQL}, monthly AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM quotes)"


def _dedupe_sql(order: str) -> str:
    return MONTHLY + f" SELECT product, month, source_type, day, round(fare, 7) AS fare, order_id, line_no FROM monthly QUALIFY row_number() OVER (PARTITION BY product, month ORDER BY {order}, order_id, line_no) = 1"


VALIDATED = f"""WITH {QUOTES_SQL}, told AS (
  SELECT q.* REPLACE (CASE WHEN horizon = 1 THEN 0 ELSE horizon END AS horizon, round(CASE WHEN order_id % 7 = 0 THEN fare / 10 WHEN order_id % 11 = 0 THEN fare * 20 ELSE fare END, 4) AS fare)
  FROM quotes q
), based AS (SELECT *, round(fare * (1 - discount * 6), 4) AS base FROM told
), split AS (SELECT *, round(fare - base + CASE WHEN line_no = 2 THEN 1.5 ELSE 0.0 END, 4) AS taxes FROM based
), judged AS (
  SELECT *, CASE WHEN fare <= 0 THEN 'non_positive_fare' WHEN fare < 500 THEN 'below_minimum_fare' WHEN fare > 80000 THEN 'above_maximum_fare' END AS excluded,
    list_filter([CASE WHEN stops = 0 AND abs(base + taxes - fare) > 1.0 THEN 'component_mismatch' END, CASE WHEN stops = 0 AND taxes / fare > 0.5 THEN 'high_tax_ratio' END,
      CASE WHEN stops = 0 AND taxes / fare < 0.05 THEN 'low_tax_ratio' END, CASE WHEN horizon >= 30 AND fare > 25000 THEN 'suspiciously_high_advance_fare' END,
      CASE WHEN horizon = 0 AND fare < 1500 THEN 'suspiciously_low_same_day_fare' END], lambda x: x IS NOT NULL) AS flags
  FROM split
)"""
FENCED = f"""WITH RECURSIVE {QUOTES_SQL}, line AS (
  SELECT order_id, line_no, route_id, horizon, fare * CASE WHEN order_id % 23 = 0 THEN 10.0 ELSE 1.0 END AS fare, row_number() OVER (PARTITION BY route_id, horizon ORDER BY day, order_id, line_no, fare) AS k FROM quotes
)"""
FENCE = FENCED + """, walk AS (
  SELECT 0::BIGINT AS k, route_id, horizon, NULL::BIGINT AS order_id, NULL::INTEGER AS line_no, 0::BIGINT AS n_past, false AS outlier, []::DOUBLE[] AS held FROM line WHERE k = 1
  UNION ALL
  SELECT k, route_id, horizon, order_id, line_no, n_past, outlier, CASE WHEN outlier THEN held ELSE list_append(held, fare)[-500:] END FROM (
    SELECT *, n_past >= 10 AND (fare < q1 - 3 * (q3 - q1) OR fare > q3 + 3 * (q3 - q1)) AS outlier FROM (
      SELECT line.k, line.route_id, line.horizon, line.order_id, line.line_no, line.fare, walk.held, len(walk.held) AS n_past,
        list_aggregate(walk.held, 'quantile_cont', 0.25) AS q1, list_aggregate(walk.held, 'quantile_cont', 0.75) AS q3
      FROM walk JOIN line ON line.route_id = walk.route_id AND line.horizon = walk.horizon AND line.k = walk.k + 1))
) SELECT order_id, line_no, route_id, horizon, n_past, coalesce(outlier, false) AS outlier FROM walk WHERE k > 0"""
FIELDS = """WITH f AS (SELECT p_partkey, p_size,
  CAST(p_partkey % 14 AS INTEGER) AS hh, ['AM', 'PM', ''][p_partkey % 3 + 1] AS half,
  ['SAVER', 'FLEX', 'MAX', 'LITE', NULL][p_partkey % 5 + 1] AS family, ['STANDARD', 'FLEX', 'PREMIUM', 'LITE', 'STANDARD'][p_partkey % 5 + 1] AS tier,
  ['ECONOMY', 'PREMIUM_ECONOMY', 'BUSINESS', 'FIRST', 'ECONOMY'][p_partkey % 5 + 1] AS cabin, [15, NULL, 20, NULL, 7][p_partkey % 5 + 1]::INTEGER AS bag_kg,
  [true, false, NULL, true][p_partkey % 4 + 1] AS refundable, [320.0, 340.0, 220.0, 350.0][p_partkey % 4 + 1]::DOUBLE AS fee, ['DEL', 'BOM', 'XXX', 'GOX'][p_partkey % 4 + 1] AS airport,
  ['6E-123', '6E-77', '6E-99', 'AB-1', '6E'][p_partkey % 5 + 1] AS flight FROM part
), g AS (SELECT *, CASE WHEN half = 'PM' AND hh < 12 THEN hh + 12 WHEN half = 'AM' AND hh = 12 THEN 0 ELSE hh END AS hour FROM f
), h AS (SELECT *, CASE WHEN hour <= 5 THEN '00:00-05:59' WHEN hour <= 11 THEN '06:00-11:59' WHEN hour <= 17 THEN '12:00-17:59' ELSE '18:00-23:59' END AS band FROM g)"""

QUERIES = {
    f.__name__: f
    for f in (
        dedupe_priority, dedupe_lowest, dedupe_recent, dedupe_spread, validate_rules, flag_histogram, prior_day_change, iqr_window_fence, iqr_recursive,
        normalize_fields, product_keys, tariff_unbundle, domain_root, redact_url, block_detect,
    )
}

ORACLE = {
    "dedupe_priority": _dedupe_sql(f"{RANK}, fare"),
    "dedupe_lowest": _dedupe_sql(f"fare, {RANK}"),
    "dedupe_recent": _dedupe_sql(f"day DESC, {RANK}, fare"),
    "dedupe_spread": MONTHLY
    + """ SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_kept, CAST(sum(n - 1) AS BIGINT) AS n_dropped, round(max(CASE WHEN lo > 0 THEN 100 * (hi - lo) / lo END), 6) AS max_spread_pct
  FROM (SELECT count(*) AS n, min(fare) AS lo, max(fare) AS hi FROM monthly GROUP BY product, month)""",
    "validate_rules": VALIDATED
    + " SELECT order_id, line_no, product, CASE WHEN excluded IS NOT NULL THEN 'excluded' WHEN len(flags) > 0 THEN 'flagged' ELSE 'accepted' END AS action, coalesce(excluded, array_to_string(flags, ','), '') AS reason FROM judged",
    "flag_histogram": VALIDATED
    + """ SELECT flag, count(*) AS n, (SELECT count(*) FROM judged) AS n_all, (SELECT round(100 * avg(CASE WHEN excluded IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM judged) AS valid_pct
  FROM (SELECT unnest(CASE WHEN excluded IS NOT NULL THEN [excluded] ELSE flags END) AS flag FROM judged) GROUP BY flag""",
    "prior_day_change": f"""WITH {QUOTES_SQL}, off AS (SELECT route_id, horizon, day, fare * CASE WHEN order_id % 19 = 0 THEN CASE WHEN line_no % 2 = 0 THEN 6.0 ELSE 0.02 END ELSE 1.0 END AS fare FROM quotes),
  m AS (SELECT route_id, horizon, day, count(*) AS n, quantile_cont(fare, 0.5) AS median FROM off WHERE fare BETWEEN 500 AND 80000 GROUP BY ALL),
  p AS (SELECT *, lag(median) OVER (PARTITION BY route_id, horizon ORDER BY day) AS prior_median FROM m)
  SELECT route_id, horizon, day, n, round(median, 6) AS median, round(prior_median, 6) AS prior_median, round(100 * (median - prior_median) / prior_median, 6) AS change_pct,
    CASE WHEN abs(median - prior_median) / prior_median * 100 > 300 THEN CASE WHEN median > prior_median THEN 'daily_change_spike' ELSE 'daily_change_collapse' END END AS flag FROM p""",
    "iqr_window_fence": FENCED
    + """ SELECT order_id, line_no, route_id, horizon, n_past, coalesce(n_past >= 10 AND (fare < q1 - 3 * (q3 - q1) OR fare > q3 + 3 * (q3 - q1)), false) AS outlier FROM (
    SELECT *, count(fare) OVER past AS n_past, quantile_cont(fare, 0.25) OVER past AS q1, quantile_cont(fare, 0.75) OVER past AS q3
    FROM line WINDOW past AS (PARTITION BY route_id, horizon ORDER BY k ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))""",
    "iqr_recursive": FENCE,
    "normalize_fields": FIELDS
    + " SELECT p_partkey, band, tier, cabin, bag_kg, refundable, fee, flight, CAST(CASE WHEN p_size % 3 > 0 THEN p_size % 3 WHEN p_size % 5 >= 1 THEN p_size % 5 - 1 ELSE 0 END AS INTEGER) AS stops FROM h",
    "product_keys": FIELDS
    + """, k AS (SELECT p_partkey, tier, airport, cabin, p_size, concat_ws('|', airport, 'BLR', '6E', flight, cabin, coalesce(family, 'UNSPECIFIED'), CAST(p_size % 2 AS VARCHAR),
    CASE WHEN refundable IS NULL THEN 'REFUNKNOWN' WHEN refundable THEN 'REF' ELSE 'NONREF' END, CASE WHEN bag_kg IS NULL THEN 'BAGUNKNOWN' ELSE 'BAG' || bag_kg END, 'H7', 'BAND_' || band) AS product_key FROM h)
  SELECT p_partkey, product_key, substr(sha256(product_key), 1, 32) AS key_hash, concat_ws('|', airport, 'BLR', '6E', cabin, tier, CAST(p_size % 2 AS VARCHAR), 'H7') AS spec_key FROM k""",
    "tariff_unbundle": """WITH t AS (SELECT o_orderkey, round(o_totalprice / 10, 0) AS total FROM orders), b AS (
  SELECT *, total > 236 + 360 + 300 + 500 AS whole, CASE WHEN total > 236 + 360 + 300 + 500 THEN round((total - 236 - 360 - 300) / 1.05, 2) ELSE round(total * 0.75, 2) END AS base_fare FROM t
), x AS (SELECT *, CASE WHEN whole THEN round(round(base_fare * 0.05, 2) + 236, 2) ELSE round(total * 0.15, 2) END AS taxes, CASE WHEN whole THEN 360.0 ELSE round(total * 0.05, 2) END AS airport_fee FROM b)
  SELECT o_orderkey, total, base_fare, taxes, airport_fee, round(total - base_fare - taxes - airport_fee, 2) AS convenience FROM x""",
    "domain_root": """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages), s AS (SELECT page_id, host, string_split(host, '.') AS p FROM h)
  SELECT page_id, CASE WHEN len(p) <= 2 OR regexp_full_match(host, '[0-9.]+') THEN host WHEN array_to_string(p[-2:], '.') IN ('co.in', 'com.in', 'gov.in', 'org.in', 'net.in', 'co.uk', 'org.uk', 'ac.in') THEN array_to_string(p[-3:], '.')
    ELSE array_to_string(p[-2:], '.') END AS domain FROM s""",
    "redact_url": """SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&token=abc&sessionid=9' ELSE '?api_key=xyz&n=1&auth=u' END,
  '([?&](?:token|access_token|auth|key|api_key|apikey|secret|session|sessionid|password)=)[^&#]*', '\\1[REDACTED]', 'gi') AS url FROM pages""",
    "block_detect": """SELECT page_id, (200 + page_id % 3 * 203 % 405) IN (403, 429) OR regexp_matches(lower(concat_ws(' ', regexp_extract(html, '<title>([^<]*)', 1), substr(html, 1, 4000))), 'captcha|challenge|unusual traffic') AS blocked FROM pages""",
}
