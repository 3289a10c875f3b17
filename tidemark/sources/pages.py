"""Quotes from captured text cards and result pages, as column pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fares import cabin, flight_number, time_band, unbundle
from tidemark.sources.markup import page_blocks, page_quotes
from tidemark.sources.store import computed_once

# Carrier names as cards show them, in order of precedence, with their codes; codes that merged into others.
CARRIERS = {"INDIGO": "6E", "AIR INDIA EXPRESS": "IX", "AIR INDIA": "AI", "AKASA AIR": "QP", "AKASA": "QP", "SPICEJET": "SG", "VISTARA": "AI"}
MERGED = {"UK": "AI", "I5": "IX"}
DIRECT = ["nonstop", "non-stop", "non stop", "0 stop"]
# What kinds of source ask of a card: least and greatest fare, convenience fee, kilograms of baggage, carrier.
PRESETS = {
    "portal": {"low": 500.0, "high": 80000.0, "fee": 300.0, "carrier": None},
    "metasearch": {"low": 600.0, "high": 90000.0, "fee": 350.0, "carrier": None},
    "airline": {"low": 800.0, "high": 95000.0, "fee": 350.0, "carrier": "AI"},
    "spider": {"low": 500.0, "high": 95000.0, "fee": 300.0, "carrier": None},
}
# Of RPC pages and of metasearch sites, what names a carrier, in order of precedence; words for direct flights; the time of a text without a clock, by site.
RPC_NAMES = {"6E": "6E", "INDIGO": "6E", "AI": "AI", "AIR INDIA": "AI", "SG": "SG", "SPICEJET": "SG", "QP": "QP", "AKASA": "QP", "IX": "IX", "AIR INDIA EXPRESS": "IX"}
SITE_NAMES = {"INDIGO": "6E", "6E": "6E", "AIR INDIA": "AI", "AI": "AI", "SPICEJET": "SG", "SG": "SG", "AKASA": "QP", "QP": "QP", "AIR INDIA EXPRESS": "IX", "IX": "IX"}
RPC_DIRECT, RPC_TIME = ["nonstop", "non-stop", "0 stop"], "09:30 AM"
SITE_DIRECT = {"makemytrip": ["non stop", "non-stop", "0 stop"], "goibibo": ["non stop", "non-stop", "0 stop"], "cleartrip": ["non stop", "non-stop", "0 stop"], "skyscanner": ["direct", "non-stop", "0 stop"]}
SITE_TIME = {"makemytrip": "08:00", "goibibo": "09:00", "cleartrip": "10:00", "skyscanner": "12:00"}
#: Blanks of any kind that cards have between parts: ASCII ones, no-break and narrow no-break spaces.
BLANK = r"[\s\u00A0\u202F]"


def amount(text: Column) -> Column:
    """A number from a text with currency signs and separators; null without digits."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


def _carrier(text: Column, names: dict[str, str] = CARRIERS) -> Column:
    code = F.lit(None)
    for name, value in reversed(names.items()):
        code = F.when(F.contains(F.upper(text), F.lit(name)), value).otherwise(code)
    return code


def _digits(x: Column) -> Column:
    return F.replace(F.nullif(x, F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def _read(df: DataFrame, text_col: str, **columns: Column) -> DataFrame:
    """df beside columns told of a text, each computed once a row: a filter on them does not read the text again, nor make it again from what it is made of."""
    once = computed_once(df, [text_col])
    told = computed_once(once.select("*", *[c.alias(n) for n, c in columns.items()]), list(columns))
    return told.select(*df.columns, *columns)


def _first_of(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """The first row of each key by place on its page."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(at))).filter("_rank = 1").drop("_rank")


def _quoted(found: DataFrame, origin_col: str, dest_col: str, fee: float, at: str, key: list[str]) -> DataFrame:
    """Cards with carrier, fare and dep_time: flight, band and tariff parts; the first of equal ones stays."""
    slug = F.regexp_replace(F.coalesce("dep_time", F.lit("0000")), r"\W", "")
    made = F.concat_ws("-", "carrier", F.concat(origin_col, dest_col), slug)
    found = found.withColumn("is_surrogate", F.col("number").isNull()).withColumn("flight", F.coalesce(F.concat_ws("-", "carrier", F.nullif("number", F.lit(""))), made))
    found = found.withColumn("flight", F.when(F.col("is_surrogate"), made).otherwise(F.col("flight"))).withColumn("band", time_band(F.col("dep_time"))).drop("number")
    first = _first_of(found, [origin_col, dest_col, *key], at)
    return first.select("*", *[c.alias(n) for n, c in unbundle(F.col("fare"), F.col(origin_col), fee).items()])


def cards(df: DataFrame, text_col: str, origin_col: str, dest_col: str, at_col: str, low: float = 500.0, high: float = 80000.0, fee: float = 300.0, carrier: str | None = None) -> DataFrame:
    """One quote for each card with a known carrier and a price within bounds; of equal flights the first on the page (at_col) stays.

    carrier: the code that an airline's own cards have; otherwise the card's text names it. A
    card without a clock has no departure time and an unspecified band. Null texts give none.
    """
    text = F.col(text_col)
    times = F.regexp_extract_all(text, F.lit(rf"(\d{{1,2}}:\d{{2}}{BLANK}*[AP]M)"), F.lit(1))
    clock = lambda i: F.regexp_replace(F.get(times, F.lit(i)), f"{BLANK}+", " ")
    found = _read(
        df, text_col, carrier=_carrier(text) if carrier is None else F.lit(carrier), fare=_digits(F.regexp_extract(text, rf"₹{BLANK}*([\d,]+)", 1)), dep_time=clock(0),
        arr_time=clock(1), stops=F.when(F.lower(text).rlike("|".join(DIRECT)), 0).otherwise(1), number=F.lit(None).cast("string"),
    ).filter(F.col("carrier").isNotNull() & F.col("fare").between(low, high))
    return _quoted(found, origin_col, dest_col, fee, at_col, ["flight"])


def ota_cards(df: DataFrame, text_col: str, origin_col: str, dest_col: str, at_col: str) -> DataFrame:
    """Quotes of an agency's cards, whose parts are separated by bars.

    The price is the headline before the booking button, else the stated grand total, else the
    least amount with a separator from 1,500 to 80,000. The carrier is that of the flight number, or
    of a name in the text. Baggage and seats are null unless told.
    """
    text = F.col(text_col)
    part = lambda pattern, i=1: F.regexp_extract(text, pattern, i)
    number = r"\b(6E|AI|IX|SG|QP|UK|I5|9I|S5)\s*-?\s*(\d{2,4})\b"
    told = F.nullif(part(number), F.lit(""))
    code = told
    for old, new in MERGED.items():
        code = F.when(told == old, new).otherwise(code)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2},\d{3})\b"), F.lit(1)), _digits)
    price = F.coalesce(
        _digits(part(r"(?i)([\d,]{4,6})\s*(?:\|\s*[\d,]{4,6})?\s*\|\s*(?:\+\s*More Fare|Book Now)")),
        _digits(part(r"(?i)Grand Total\s*\|\s*([\d,]{4,6})")),
        F.array_min(F.filter(tokens, lambda x: x.between(1500, 80000))),
    )
    times = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}:\d{2})\b"), F.lit(1))
    low, whole = F.lower(text), lambda x: F.nullif(x, F.lit("")).cast("int")
    found = df.select(
        "*", F.coalesce(code, _carrier(text)).alias("carrier"), F.nullif(part(number, 2), F.lit("")).alias("number"), price.alias("fare"), F.get(times, F.lit(0)).alias("dep_time"), F.get(times, F.lit(1)).alias("arr_time"),
        F.when(low.rlike("non-stop|nonstop|0 stop"), 0).otherwise(1).alias("stops"), F.when(F.contains(low, F.lit("flex")), "FLEX").when(F.contains(low, F.lit("max")), "MAX").otherwise("SAVER").alias("family"),
        whole(part(r"(?i)(\d+)\s*KGS?\s*(?:\||\s)*(?:Check-in|Baggage)")).alias("baggage_kg"), whole(part(r"(?i)(\d+)\s*Seats?\s*Left")).alias("seats"),
        (F.contains(low, F.lit("refundable")) & ~F.contains(low, F.lit("non-refundable"))).alias("refundable"),
    ).filter(F.col("carrier").isNotNull() & F.col("fare").between(500, 80000))
    return _quoted(found, origin_col, dest_col, 300.0, at_col, ["flight", "dep_time", "fare"])


def price_clusters(df: DataFrame, text_col: str, around: int = 4) -> DataFrame:
    """A row for each line of a text with a rupee sign: `at`, and `block`, that line with `around` lines before and behind it."""
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    found = df.select("*", lines.alias("_lines")).select("*", F.posexplode("_lines").alias("at", "_line")).filter(F.contains("_line", F.lit("₹")))
    first = F.greatest(F.col("at") - around, F.lit(0))
    block = F.array_join(F.slice("_lines", first + 1, F.col("at") + around + 1 - first), "\n")
    return found.withColumn("block", block).drop("_lines", "_line")


def rpc_quotes(df: DataFrame, html_col: str, page_col: str, origin_col: str, dest_col: str) -> DataFrame:
    """Quotes of RPC pages: of offer cards, or of the lines around each price where a page has none.

    Windows of neighbouring prices overlap and read the same first price; of equal flight, time and fare the first
    of a page stays. Blocks without a known carrier or a fare from 600 to 90,000 give none. A text without a
    clock has RPC_TIME. Every flight number is made of carrier, route and time.
    """
    each = page_blocks(df, html_col)
    text = F.col("block")
    times = F.regexp_extract_all(text, F.lit(rf"(\d{{1,2}}:\d{{2}}{BLANK}*[AP]M)"), F.lit(1))
    clock = lambda i: F.replace(F.get(times, F.lit(i)), F.lit("\u202f"), F.lit(" "))
    found = each.select(
        *[c for c in df.columns if c != html_col], "at", _carrier(text, RPC_NAMES).alias("carrier"), _digits(F.regexp_extract(text, rf"₹{BLANK}*([\d,]+)", 1)).alias("fare"),
        F.coalesce(clock(0), F.lit(RPC_TIME)).alias("dep_time"), clock(1).alias("arr_time"), F.when(F.lower(text).rlike("|".join(RPC_DIRECT)), 0).otherwise(1).alias("stops"), F.lit(None).cast("string").alias("number"),
    ).filter(F.col("carrier").isNotNull() & F.col("fare").between(600, 90000))
    return _quoted(found, origin_col, dest_col, 300.0, "at", [page_col, "flight", "dep_time", "fare"])


def site_quotes(df: DataFrame, text_col: str, site: str, page_col: str, origin_col: str, dest_col: str, at_col: str) -> DataFrame:
    """Quotes of a metasearch site's cards: PRESETS["metasearch"], the site's words for direct flights and its time for cards without a clock.

    A flight number in the text counts; it may be of another carrier than the card's name, as on shared flights.
    """
    text, own = F.col(text_col), PRESETS["metasearch"]
    number = F.regexp_extract(F.upper(text), r"(6E|AI|SG|QP|IX)[-\s]?(\d{3,4})", 2)
    code = F.regexp_extract(F.upper(text), r"(6E|AI|SG|QP|IX)[-\s]?(\d{3,4})", 1)
    time = F.nullif(F.regexp_extract(text, r"(\d{1,2}:\d{2})", 1), F.lit(""))
    found = _read(
        df, text_col, carrier=_carrier(text, SITE_NAMES), fare=_digits(F.regexp_extract(text, rf"₹{BLANK}*([\d,]+)", 1)), dep_time=F.coalesce(time, F.lit(SITE_TIME[site])),
        stops=F.when(F.lower(text).rlike("|".join(SITE_DIRECT[site])), 0).otherwise(1), number=F.nullif(number, F.lit("")), _code=code,
    ).filter(F.col("carrier").isNotNull() & F.col("fare").between(own["low"], own["high"]))
    told = found.withColumn("carrier_shown", F.col("carrier")).withColumn("carrier", F.when(F.col("number").isNotNull(), F.col("_code")).otherwise(F.col("carrier"))).drop("_code")
    quoted = _quoted(told, origin_col, dest_col, own["fee"], at_col, [page_col, "flight", "dep_time", "fare"])
    return quoted.withColumn("carrier", F.col("carrier_shown")).drop("carrier_shown")


#: An offer payload, as far as it is read.
OFFERS = """struct<data: array<struct<id: string, numberOfBookableSeats: int, validatingAirlineCodes: array<string>,
  price: struct<currency: string, total: string, grandTotal: string, base: string>,
  itineraries: array<struct<duration: string, segments: array<struct<departure: struct<iataCode: string, at: string>, arrival: struct<iataCode: string, at: string>, carrierCode: string, number: string>>>>,
  travelerPricings: array<struct<fareDetailsBySegment: array<struct<cabin: string, brandedFare: string, includedCheckedBags: struct<weight: int, quantity: int>>>>>>>>"""


def offers(df: DataFrame, json_col: str, origin_col: str, dest_col: str) -> DataFrame:
    """One row for each offer of a payload, with `reject`: why it is no quote, or null.

    The first itinerary counts: its first segment departs, its last arrives, and those must be the
    asked route. Taxes are what the total has beyond the base.
    """
    each = df.select("*", F.explode(F.from_json(json_col, OFFERS)["data"]).alias("_o"))
    segments = F.col("_o.itineraries")[0]["segments"]
    n = F.coalesce(F.size(segments), F.lit(0))
    first, last = F.get(segments, F.lit(0)), F.get(segments, n - 1)
    fare, base = F.coalesce("_o.price.grandTotal", "_o.price.total").try_cast("double"), F.col("_o.price.base").try_cast("double")
    detail = F.get(F.get(F.col("_o.travelerPricings"), F.lit(0))["fareDetailsBySegment"], F.lit(0))
    same = (first["departure"]["iataCode"] == F.col(origin_col)) & (last["arrival"]["iataCode"] == F.col(dest_col))
    reject = F.when(n < 1, "no_segments").when(~F.coalesce(same, F.lit(False)), "route_mismatch").when(fare.isNull() | (fare <= 0), "no_price").when(first["carrierCode"].isNull(), "no_carrier")
    return each.select(
        *df.columns, F.col("_o.id").alias("offer_id"), F.upper(first["carrierCode"]).alias("carrier"), flight_number(F.upper(first["carrierCode"]), first["number"]).alias("flight"),
        fare.alias("fare"), base.alias("base"), F.round(fare - base, 2).alias("taxes"), F.col("_o.price.currency").alias("currency"), (n - 1).alias("stops"), cabin(detail["cabin"]).alias("cabin"),
        detail["brandedFare"].alias("family"), detail["includedCheckedBags"]["weight"].alias("baggage_kg"), F.col("_o.numberOfBookableSeats").alias("seats"), F.substring(first["departure"]["at"], 12, 5).alias("dep_time"), reject.alias("reject"),
    )


def fixture_scan(df: DataFrame, json_col: str, origin: str, dest: str, horizon: int) -> DataFrame:
    """Observations of a fixture file's rows for one pair and horizon."""
    schema = "struct<observations: array<struct<origin: string, destination: string, horizon: int, airline_code: string, fare_total: double, cabin: string, stops: int>>>"
    each = df.select(F.explode(F.from_json(json_col, schema)["observations"]).alias("o")).select("o.*")
    kept = each.filter((F.upper("origin") == origin) & (F.upper("destination") == dest) & (F.col("horizon") == horizon))
    return kept.select(F.upper(F.trim("airline_code")).alias("carrier"), F.col("fare_total").alias("fare"), cabin(F.col("cabin")).alias("cabin"), F.coalesce("stops", F.lit(0)).alias("stops"))


def result_pages(df: DataFrame, html_col: str) -> DataFrame:
    """df with `state` and `quotes` of each page: page_quotes, with a page's quotes in one array. Pages are told apart by all columns of df; a page's own quotes are all that a row holds."""
    each = page_quotes(df.withColumn("_page", F.monotonically_increasing_id()), html_col)
    quote = F.struct("place", "carrier", "airline", "flight", "fare", "base", "taxes", "dep_time", "arr_time")
    found = each.groupBy("_page").agg(*[F.first(c).alias(c) for c in df.columns], F.first("state").alias("state"), F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), quote))).alias("quotes"))
    return found.drop("_page")
