"""Queries over captured pages, cards and payloads made from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import pages as pg
from tidemark.sources.tables import read

#: Carriers' names on the cards, by part; the last one is nobody's.
SHOWN = ["IndiGo", "Air India Express", "Air India", "SpiceJet", "Vistara", "Akasa Air", "Nobody"]


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (key % len(values) + 1).cast("int"))


def card_texts(spark, d):
    """A card for each part: carrier, clock with a narrow no-break space, stops and a price with a no-break space."""
    k = F.col("p_partkey")
    clock = F.format_string("%d:%02d %s", k % 12 + 1, k % 60, _pick(k, ["AM", "PM"]))
    price = F.format_string("₹ %,d", F.floor("p_retailprice").cast("int") * _pick(k, [1, 4, 90, 5]))
    text = F.concat_ws("\n", _pick(k, SHOWN), clock, F.lit("2 hr"), _pick(k, ["Nonstop", "1 stop", "non-stop"]), price)
    return read(spark, d, "part").select("p_partkey", "p_retailprice", text.alias("card"), _pick(k, ["DEL", "BOM", "CCU"]).alias("origin"), F.lit("BLR").alias("dest"))


def portal_cards(spark, d):
    found = pg.cards(card_texts(spark, d), "card", "origin", "dest", "p_partkey", **pg.PRESETS["portal"])
    return found.select("p_partkey", "origin", "carrier", "fare", "dep_time", "stops", "flight", "band")


def airline_cards(spark, d):
    """The same cards as an airline's own: its carrier on all of them, its bounds."""
    found = pg.cards(card_texts(spark, d), "card", "origin", "dest", "p_partkey", **pg.PRESETS["airline"])
    return found.select("p_partkey", "origin", "carrier", "fare", "dep_time", "stops", "flight")


def ota_cards(spark, d):
    """Cards with a headline price, a grand total or amounts alone, with and without a flight number."""
    k = F.col("p_partkey")
    price = F.floor("p_retailprice").cast("int") + 2000
    told = F.format_string("%,d", price)
    tail = F.when(k % 3 == 0, F.concat(told, F.lit(" | Book Now | 9,999"))).when(k % 3 == 1, F.concat(F.lit("9,100 | Grand Total | "), told)).otherwise(F.concat(told, F.lit(" | 8,888 | off 1,200")))
    number = F.when(k % 2 == 0, F.concat(_pick(k, ["6E", "UK", "I5", "QP"]), F.lit("-"), (k % 900 + 100).cast("string"))).otherwise(_pick(k, SHOWN))
    text = F.concat_ws(" | ", number, F.format_string("%02d:%02d", k % 24, k % 60), F.lit("23:59"), F.when(k % 5 == 0, "Non-Stop").otherwise("1 Stop"), F.when(k % 4 == 0, "15 KG | Check-in"), F.when(k % 7 == 0, "3 Seats Left"), F.when(k % 6 == 0, "Refundable").otherwise("Non-Refundable"), tail)
    cards = read(spark, d, "part").select("p_partkey", text.alias("card"), F.lit("DEL").alias("origin"), F.lit("BOM").alias("dest"))
    found = pg.ota_cards(cards, "card", "origin", "dest", "p_partkey")
    return found.select("p_partkey", "carrier", "flight", "fare", "stops", "baggage_kg", "seats", "refundable", "is_surrogate")


def price_clusters(spark, d):
    """Lines around each price of texts of a few cards each."""
    cards = card_texts(spark, d).select("origin", F.floor(F.col("p_partkey") / 50).alias("page"), F.struct("p_partkey", "card").alias("of"))
    texts = cards.groupBy("origin", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("of")), lambda x: x.card), "\n").alias("text"))  # at most fifty cards
    return pg.price_clusters(texts, "text").select("origin", "page", "at", "block")


def rpc_pages(spark, d):
    """A page for each fifty parts and origin: offers in cards of every third page, as lines between others on the rest."""
    k = F.col("p_partkey")
    shown = _pick(k, ["IndiGo", "Air India", "SpiceJet", "Akasa Air", "Nobody", "QP 1402"])
    price = F.format_string("%,d", F.floor("p_retailprice").cast("int") * _pick(k, [1, 4, 90, 5]))
    clock = lambda at, half: F.format_string("%d:%02d\u202f%s", at % 12 + 1, k % 60, F.lit(half))
    page = F.concat_ws("-", _pick(k, ["DEL", "BOM", "CCU"]), F.floor(k / 50).cast("string"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    inside = F.concat(tag("b", shown), tag("i", clock(k, "AM")), tag("i", clock(k + 3, "PM")), tag("u", _pick(k, ["Nonstop", "1 stop", "non stop"])), tag("p", F.concat(F.lit("from <s>₹</s>"), tag("em", F.concat(F.lit("₹"), price)))))
    apart = F.lit("<hr><p>x</p><p>y</p><p>z</p><p>w</p>")
    line = F.concat(tag("p", shown), tag("p", clock(k, "AM")), tag("p", _pick(k, ["Nonstop", "1 stop", "non stop"])), tag("p", F.concat(F.lit("₹ "), price)), apart)
    cards = F.floor(k / 50) % 3 == 0
    offer = F.struct(k.alias("k"), F.when(cards, F.concat(F.lit('<div data-x="1" class="a yR1fYc">'), inside, F.lit("</div>"))).otherwise(line).alias("part"))
    # a page has at most fifty parts
    made = read(spark, d, "part").groupBy(page.alias("page"), _pick(k, ["DEL", "BOM", "CCU"]).alias("origin")).agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    return made.select("page", "origin", F.lit("BLR").alias("dest"), F.concat(F.lit("<html><script>₹ 999</script><body>"), F.array_join(F.transform("offers", lambda o: o.part), ""), F.lit("</body></html>")).alias("html"))


def rpc_quotes(spark, d):
    """Carrier, fare, times, stops and parts of the tariff of each offer on those pages."""
    found = pg.rpc_quotes(rpc_pages(spark, d), "html", "page", "origin", "dest")
    return found.select("page", "carrier", "fare", F.replace("dep_time", F.lit("\u202f"), F.lit(" ")).alias("dep_time"), "arr_time", "stops", "flight", "band", F.round("base_fare", 2).alias("base_fare"))


def metasearch_cards(spark, d):
    """Cards of a site that writes "direct", with and without a flight number and a clock."""
    k = F.col("p_partkey")
    shown = _pick(k, ["IndiGo", "Air India", "Akasa Air", "Nobody", "SpiceJet"])
    number = F.when(k % 4 == 0, F.concat(_pick(k, ["6E", "QP", "SG"]), F.lit(" "), (k % 900 + 100).cast("string")))
    text = F.concat_ws("\n", shown, number, F.when(k % 6 > 0, F.format_string("%02d:%02d", k % 24, k % 60)), _pick(k, ["Direct", "non stop", "1 stop"]), F.format_string("₹ %,d", F.floor("p_retailprice").cast("int") * _pick(k, [1, 5, 60])))
    cards = read(spark, d, "part").select("p_partkey", (k % 200).alias("page"), text.alias("card"), F.lit("DEL").alias("origin"), F.lit("BOM").alias("dest"))
    found = pg.site_quotes(cards, "card", "skyscanner", "page", "origin", "dest", "p_partkey")
    return found.select("p_partkey", "page", "carrier", "fare", "dep_time", "stops", "flight", "is_surrogate", "band")


def page_state(spark, d):
    """Result pages of each kind made around the tables' pages: amounts in nested elements, attributes in any order, cards whose parts do not add up."""
    k = F.col("page_id")
    price = F.lit(4000) + k
    card = F.concat(
        F.lit('<div id="x" class="wide flight-card"><b class="airline-code">AI</b><em class="airline-name">Air <!-- no --> India</em><i class="flight-number">AI-'), k, F.lit('</i><img src="a"><span data-unit="inr" class="fare-total"><b>₹</b>'), F.format_string("%,d", price),
        F.lit('</span><span data-amount="'), price - 900, F.lit('" class="fare-base">?</span><span class="fare-taxes"><i>'), F.when(k % 2 == 0, 900).otherwise(700), F.lit('</i></span><p class="dep-time"> 07:45 </p></div>'),
    )
    row = F.concat(F.lit('<table><tr data-airline-code="6E" class="flight-row"><td class="fare-total"><span>₹</span><b>'), price, F.lit("</b></td></tr></table>"))
    none = F.lit('<table><tr class="flight-row"><td class="fare-total">-</td></tr></table>')
    html = F.when(k % 8 == 0, F.concat(F.lit('<div class="error-container"></div>'), card)).when(k % 8 == 1, '<p id="cf-challenge">').when(k % 8 == 2, F.concat(card, card)).when(k % 8 == 3, row)
    html = html.when(k % 8 == 4, '<div class="x sold-out-banner">').when(k % 8 == 5, card).when(k % 8 == 6, none).otherwise(F.concat(F.lit("<h1>Error <b>500</b></h1>"), row))
    found = pg.page_quotes(read(spark, d, "pages").select("page_id", html.alias("html")), "html")
    return found.select("page_id", "state", "n_quotes", "place", "carrier", "airline", "flight", "fare", "base", "taxes", "dep_time")


def gds_offers(spark, d):
    """A payload of an offer for each order: one or two segments, some of another route, some without a price."""
    k = F.col("o_orderkey")
    place = lambda code, at: F.struct(F.lit(code).alias("iataCode"), F.lit(at).alias("at")) if isinstance(code, str) else F.struct(code.alias("iataCode"), F.lit(at).alias("at"))
    leg = lambda a, b, n: F.struct(place(a, "2026-01-02T07:45:00").alias("departure"), place(b, "2026-01-02T10:05:00").alias("arrival"), F.lit("ai").alias("carrierCode"), n.cast("string").alias("number"))
    end = F.when(k % 5 == 0, "GOI").otherwise("BOM")
    legs = F.when(k % 3 == 0, F.array(leg("DEL", F.lit("HYD"), k % 1000), leg("HYD", end, k % 900))).otherwise(F.array(leg("DEL", end, k % 1000)))
    offer = F.struct(
        k.cast("string").alias("id"), F.lit(4).alias("numberOfBookableSeats"),
        F.struct(F.lit("INR").alias("currency"), F.when(k % 7 != 0, F.round("o_totalprice", 2).cast("string")).alias("grandTotal"), F.lit("100.00").alias("base")).alias("price"),
        F.array(F.struct(legs.alias("segments"))).alias("itineraries"),
        F.array(F.struct(F.array(F.struct(F.lit("BUSINESS").alias("cabin"), F.lit("FLEX").alias("brandedFare"), F.struct(F.lit(23).alias("weight")).alias("includedCheckedBags"))).alias("fareDetailsBySegment"))).alias("travelerPricings"),
    )
    payloads = read(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.array(offer).alias("data"))).alias("payload"), F.lit("DEL").alias("origin"), F.lit("BOM").alias("dest"))
    found = pg.offers(payloads, "payload", "origin", "dest")
    return found.select("o_orderkey", "flight", "fare", "taxes", "stops", "cabin", "family", "baggage_kg", "dep_time", "reject")


def fixture_scan(spark, d):
    """A fixture file for each thousand customers, scanned for one pair and horizon."""
    c = read(spark, d, "customer")
    one = F.struct(
        F.when(F.col("c_custkey") % 2 == 0, "del").otherwise("BOM").alias("origin"), F.lit("BLR").alias("destination"), _pick(F.col("c_custkey"), [1, 7, 30]).alias("horizon"), F.lit(" 6e ").alias("airline_code"),
        F.col("c_acctbal").alias("fare_total"), F.lit("eco").alias("cabin"), F.when(F.col("c_custkey") % 5 == 0, 1).alias("stops"),
    )
    files = c.groupBy(F.floor(F.col("c_custkey") / 1000)).agg(F.to_json(F.struct(F.collect_list(one).alias("observations"))).alias("file"))
    return pg.fixture_scan(files, "file", "DEL", "BLR", 7)


QUERIES = {f.__name__: f for f in (portal_cards, airline_cards, ota_cards, price_clusters, rpc_quotes, metasearch_cards, page_state, gds_offers, fixture_scan)}

CARDS = """WITH c AS (SELECT p_partkey, p_partkey AS k, floor(p_retailprice)::BIGINT * [1, 4, 90, 5][p_partkey % 4 + 1] AS fare, ['DEL', 'BOM', 'CCU'][p_partkey % 3 + 1] AS origin,
  ['6E', 'IX', 'AI', 'SG', 'AI', 'QP', NULL][p_partkey % 7 + 1] AS carrier, format('{}:{:02d} {}', k % 12 + 1, k % 60, ['AM', 'PM'][k % 2 + 1]) AS dep_time, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS stops,
  CASE WHEN k % 2 = 0 THEN (k % 12 + 1) % 12 ELSE (k % 12 + 1) % 12 + 12 END AS hour FROM part)"""
ORACLE = {
    "portal_cards": CARDS
    + """, q AS (SELECT p_partkey, origin, carrier, fare::DOUBLE AS fare, dep_time, stops, carrier || '-' || origin || 'BLR-' || regexp_replace(dep_time, '[^0-9A-Z]', '', 'g') AS flight,
  CASE WHEN hour <= 5 THEN '00:00-05:59' WHEN hour <= 11 THEN '06:00-11:59' WHEN hour <= 17 THEN '12:00-17:59' ELSE '18:00-23:59' END AS band FROM c WHERE carrier IS NOT NULL AND fare BETWEEN 500 AND 80000)
  SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY origin, flight ORDER BY p_partkey) = 1""",
    "airline_cards": CARDS
    + """ SELECT p_partkey, origin, 'AI' AS carrier, fare::DOUBLE AS fare, dep_time, stops, 'AI-' || origin || 'BLR-' || regexp_replace(dep_time, '[^0-9A-Z]', '', 'g') AS flight
  FROM c WHERE fare BETWEEN 800 AND 95000 QUALIFY row_number() OVER (PARTITION BY origin, dep_time ORDER BY p_partkey) = 1""",
    "ota_cards": """WITH c AS (SELECT p_partkey, p_partkey AS k, (floor(p_retailprice) + 2000)::DOUBLE AS price FROM part), q AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN ['6E', 'AI', 'IX', 'QP'][k % 4 + 1] ELSE ['6E', 'IX', 'AI', 'SG', 'AI', 'QP', NULL][k % 7 + 1] END AS carrier, format('{:02d}:{:02d}', k % 24, k % 60) AS dep,
    CASE WHEN k % 3 = 2 THEN least(price, 8888) ELSE price END AS fare FROM c
), f AS (SELECT *, CASE WHEN k % 2 = 0 THEN carrier || '-' || (k % 900 + 100) ELSE carrier || '-DELBOM-' || replace(dep, ':', '') END AS flight FROM q WHERE carrier IS NOT NULL)
  SELECT p_partkey, carrier, flight, fare, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS stops, CASE WHEN k % 4 = 0 THEN 15 END AS baggage_kg, CASE WHEN k % 7 = 0 THEN 3 END AS seats, k % 6 = 0 AS refundable, k % 2 = 1 AS is_surrogate
  FROM f QUALIFY row_number() OVER (PARTITION BY flight, dep, fare ORDER BY p_partkey) = 1""",
    "price_clusters": """WITH c AS (SELECT p_partkey AS k, ['DEL', 'BOM', 'CCU'][p_partkey % 3 + 1] AS origin, p_partkey // 50 AS page,
    concat_ws(chr(10), ['IndiGo', 'Air India Express', 'Air India', 'SpiceJet', 'Vistara', 'Akasa Air', 'Nobody'][p_partkey % 7 + 1], format('{}:{:02d}', p_partkey % 12 + 1, p_partkey % 60) || chr(8239) || ['AM', 'PM'][p_partkey % 2 + 1],
      '2 hr', ['Nonstop', '1 stop', 'non-stop'][p_partkey % 3 + 1], '₹' || chr(160) || format('{:,}', floor(p_retailprice)::BIGINT * [1, 4, 90, 5][p_partkey % 4 + 1])) AS card FROM part),
  t AS (SELECT origin, page, string_split(string_agg(card, chr(10) ORDER BY k), chr(10)) AS lines FROM c GROUP BY ALL), l AS (SELECT *, unnest(range(len(lines))) AS i FROM t)
  SELECT origin, page, i::INTEGER AS "at", array_to_string(lines[greatest(i - 3, 1):i + 5], chr(10)) AS block FROM l WHERE contains(lines[i + 1], '₹')""",
    "rpc_quotes": """WITH p AS (SELECT p_partkey AS k, ['DEL', 'BOM', 'CCU'][p_partkey % 3 + 1] AS origin, ['DEL', 'BOM', 'CCU'][p_partkey % 3 + 1] || '-' || (p_partkey // 50) AS page, (p_partkey // 50) % 3 = 0 AS cards,
    ['6E', 'AI', 'SG', 'AI', NULL, 'QP'][p_partkey % 6 + 1] AS carrier, (floor(p_retailprice)::BIGINT * [1, 4, 90, 5][p_partkey % 4 + 1])::DOUBLE AS fare, ['Nonstop', '1 stop', 'non stop'][p_partkey % 3 + 1] AS told,
    format('{}:{:02d} AM', p_partkey % 12 + 1, p_partkey % 60) AS dep_time, format('{}:{:02d} PM', (p_partkey + 3) % 12 + 1, p_partkey % 60) AS arr_time FROM part
  ), q AS (SELECT *, CASE WHEN told = 'Nonstop' THEN 0 ELSE 1 END AS stops, carrier || '-' || origin || 'BLR-' || regexp_replace(dep_time, '[^0-9A-Z]', '', 'g') AS flight, (k % 12 + 1) % 12 AS hour FROM p WHERE carrier IS NOT NULL AND fare BETWEEN 600 AND 90000
    QUALIFY row_number() OVER (PARTITION BY page, carrier, dep_time, fare ORDER BY k) = 1),
  t AS (SELECT *, 236 + CASE origin WHEN 'DEL' THEN 320 WHEN 'BOM' THEN 340 ELSE 290 END + 300 AS fixed FROM q)
  SELECT page, carrier, fare, dep_time, CASE WHEN cards THEN arr_time END AS arr_time, stops, flight, CASE WHEN hour <= 5 THEN '00:00-05:59' ELSE '06:00-11:59' END AS band,
    round(CASE WHEN fare > fixed + 500 THEN round((fare - fixed) / 1.05, 2) ELSE round(fare * 0.75, 2) END, 2) AS base_fare FROM t""",
    "metasearch_cards": """WITH c AS (SELECT p_partkey, p_partkey AS k, p_partkey % 200 AS page, ['6E', 'AI', 'AI', NULL, 'SG'][p_partkey % 5 + 1] AS name, CASE WHEN p_partkey % 4 = 0 THEN ['6E', 'QP', 'SG'][p_partkey % 3 + 1] END AS code,
    (floor(p_retailprice)::BIGINT * [1, 5, 60][p_partkey % 3 + 1])::DOUBLE AS fare, CASE WHEN p_partkey % 6 > 0 THEN format('{:02d}:{:02d}', p_partkey % 24, p_partkey % 60) ELSE '12:00' END AS dep_time FROM part),
  n AS (SELECT *, CASE WHEN '6E' IN (name, code) THEN '6E' WHEN name = 'AI' THEN 'AI' WHEN 'SG' IN (name, code) THEN 'SG' ELSE code END AS carrier, CAST(substr(dep_time, 1, 2) AS INTEGER) AS hour FROM c),
  f AS (SELECT *, CASE WHEN code IS NULL THEN carrier || '-DELBOM-' || replace(dep_time, ':', '') ELSE code || '-' || (k % 900 + 100) END AS flight FROM n)
  SELECT p_partkey, page, carrier, fare, dep_time, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS stops, flight, code IS NULL AS is_surrogate,
    CASE WHEN hour <= 5 THEN '00:00-05:59' WHEN hour <= 11 THEN '06:00-11:59' WHEN hour <= 17 THEN '12:00-17:59' ELSE '18:00-23:59' END AS band
  FROM f WHERE carrier IS NOT NULL AND fare BETWEEN 600 AND 90000 QUALIFY row_number() OVER (PARTITION BY page, flight, dep_time, fare ORDER BY p_partkey) = 1""",
    "page_state": """WITH p AS (SELECT page_id, page_id % 8 AS kind, (4000 + page_id)::DOUBLE AS price FROM pages), two AS (SELECT unnest([0, 1]) AS i)
  SELECT page_id, 'SUCCESS' AS state, 2 AS n_quotes, i::INTEGER AS place, 'AI' AS carrier, 'AirIndia' AS airline, 'AI-' || page_id AS flight, price AS fare, price - 900 AS base, 900::DOUBLE AS taxes, '07:45' AS dep_time FROM p, two WHERE kind = 2
  UNION ALL SELECT page_id, 'SUCCESS', 1, 0, '6E', '', '', price, NULL, NULL, NULL FROM p WHERE kind = 3
  UNION ALL SELECT page_id, CASE WHEN kind IN (0, 7) THEN 'ERROR' WHEN kind = 1 THEN 'CAPTCHA_CHALLENGE' WHEN kind = 5 THEN 'SELECTOR_DRIFT' ELSE 'NO_RESULTS' END, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE kind NOT IN (2, 3)""",
    "gds_offers": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, round(o_totalprice, 2) AS price FROM orders)
  SELECT o_orderkey, 'AI-' || (k % 1000) AS flight, CASE WHEN k % 7 <> 0 THEN price END AS fare, CASE WHEN k % 7 <> 0 THEN round(price - 100, 2) END AS taxes, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS stops,
    'BUSINESS' AS cabin, 'FLEX' AS family, 23 AS baggage_kg, '07:45' AS dep_time, CASE WHEN k % 5 = 0 THEN 'route_mismatch' WHEN k % 7 = 0 THEN 'no_price' END AS reject FROM o""",
    "fixture_scan": "SELECT '6E' AS carrier, c_acctbal AS fare, 'ECONOMY' AS cabin, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS stops FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1",
}
