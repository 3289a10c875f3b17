"""Scalar functions of fares and quotes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Departing user fees by airport, in rupees; other airports pay the default.
AIRPORT_FEES = {
    "DEL": 320.0, "BOM": 340.0, "BLR": 360.0, "HYD": 380.0, "AMD": 310.0, "LKO": 300.0, "MAA": 280.0, "CCU": 290.0, "GOI": 330.0,
    "GOX": 350.0, "PNQ": 250.0, "JAI": 290.0, "GAU": 260.0, "TRV": 270.0, "COK": 260.0, "IXC": 240.0, "PAT": 230.0, "BBI": 240.0,
    "VTZ": 220.0, "NAG": 240.0, "IDR": 230.0, "VNS": 230.0, "SXR": 210.0, "ATQ": 220.0, "RPR": 210.0, "IXB": 220.0,
}
DEFAULT_FEE, SECURITY_FEE, GST = 220.0, 236.0, 0.05

# Fare families by tier, and cabin labels.
STANDARD = ["SAVER", "VALUE", "REGULAR", "ECOLITE", "SPICESAVER", "STANDARD", "ECOVALUE", "UNSPECIFIED"]
FLEX = ["FLEX", "FLEXI", "ECOFLEX", "FLEXIPRO"]
PREMIUM = ["PREMIUM", "MAX"]
CABINS = {
    "ECONOMY": "ECONOMY", "ECO": "ECONOMY", "E": "ECONOMY", "COACH": "ECONOMY", "PREMIUM_ECONOMY": "PREMIUM_ECONOMY",
    "PREMIUMECONOMY": "PREMIUM_ECONOMY", "PREMIUM ECONOMY": "PREMIUM_ECONOMY", "W": "PREMIUM_ECONOMY", "BUSINESS": "BUSINESS",
    "BUS": "BUSINESS", "C": "BUSINESS", "FIRST": "FIRST", "F": "FIRST",
}
BANDS = ["00:00-05:59", "06:00-11:59", "12:00-17:59", "18:00-23:59"]
# Registries with two-part suffixes, hints of a challenge page, credential parameters and headers.
TWO_PART = ["co.in", "com.in", "gov.in", "org.in", "net.in", "co.uk", "org.uk", "ac.in"]
HINTS = ["captcha", "recaptcha", "hcaptcha", "challenge", "unusual traffic"]
CREDENTIALS = ["token", "access_token", "auth", "key", "api_key", "apikey", "secret", "session", "sessionid", "password"]
HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key"]


def _mapped(x: Column, pairs: dict) -> Column:
    out = F.lit(None)
    for key, value in pairs.items():
        out = F.when(x == key, value).otherwise(out)
    return out


def time_band(clock: Column) -> Column:
    """One of four bands of the day from a text such as '08:15 AM' or '14:30'; UNSPECIFIED without a time."""
    upper = F.upper(clock)
    pattern = r"(\d{1,2}):(\d{2})\s*([AP]M)?"
    hour, half = F.try_to_number(F.nullif(F.regexp_extract(upper, pattern, 1), F.lit("")), F.lit("99")).cast("int"), F.regexp_extract(upper, pattern, 3)
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when(hour.isNull(), "UNSPECIFIED").when(hour <= 5, BANDS[0]).when(hour <= 11, BANDS[1]).when(hour <= 17, BANDS[2]).otherwise(BANDS[3])


def canonical_tier(family: Column) -> Column:
    u = F.trim(F.upper(F.coalesce(family, F.lit(""))))
    return F.when(u.isin(STANDARD) | (u == ""), "STANDARD").when(u.isin(FLEX), "FLEX").when(u.isin(PREMIUM), "PREMIUM").otherwise(u)


def cabin(label: Column) -> Column:
    return F.coalesce(_mapped(F.replace(F.upper(F.trim(label)), F.lit("-"), F.lit("_")), CABINS), F.lit("ECONOMY"))


def stops(explicit: Column, segments: Column) -> Column:
    return F.coalesce(F.when(explicit >= 0, explicit), F.when(segments >= 1, segments - 1), F.lit(0))


def tri_state(text: Column) -> Column:
    u = F.lower(F.trim(text))
    return F.when(u.isin("true", "yes", "y", "1", "refundable"), True).when(u.isin("false", "no", "n", "0", "non-refundable", "nonrefundable"), False)


def baggage_kg(text: Column) -> Column:
    """Kilograms; null for allowances by piece."""
    return F.regexp_replace(F.upper(F.trim(text)), r"\s*KG$", "").try_cast("double").cast("int")


def flight_number(carrier: Column, number: Column) -> Column:
    """CARRIER-NUMBER, whether or not the number repeats the carrier or has a dash of its own."""
    u = F.nullif(F.replace(F.upper(F.trim(number)), F.lit(" "), F.lit("")), F.lit(""))
    rest = F.regexp_replace(F.substring(u, F.char_length(carrier) + 1, F.lit(20)), "^-+", "")
    own = F.when(rest == "", u).otherwise(F.concat_ws("-", carrier, rest))
    return F.when(F.startswith(u, carrier), own).when(F.contains(u, F.lit("-")), u).otherwise(F.concat(carrier, F.lit("-"), u))


def product_key(origin, dest, carrier, number, cabin_, family, stops_, refundable, baggage, horizon, band) -> Column:
    """The eleven parts that make two quotes the same product; undisclosed values have tokens of their own."""
    return F.concat_ws(
        "|", origin, dest, carrier, F.coalesce(number, F.lit("FLIGHTUNKNOWN")), cabin_, F.coalesce(F.upper(family), F.lit("UNSPECIFIED")), stops_.cast("string"),
        F.when(refundable.isNull(), "REFUNKNOWN").when(refundable, "REF").otherwise("NONREF"),
        F.when(baggage.isNull(), "BAGUNKNOWN").otherwise(F.concat(F.lit("BAG"), baggage.cast("string"))),
        F.concat(F.lit("H"), horizon.cast("string")), F.concat(F.lit("BAND_"), F.coalesce(band, F.lit("UNSPECIFIED"))),
    )


def spec_key(key: Column) -> Column:
    """The parts of a product key that say what is bought, without flight number, refund, baggage and band."""
    parts = F.split(key, r"\|")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(F.size(parts) >= 10, F.concat_ws("|", part(0), part(1), part(2), part(4), canonical_tier(part(5)), part(6), part(9))).otherwise(key)


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 32)


def airport_fee(origin: Column) -> Column:
    return F.coalesce(_mapped(F.upper(F.trim(origin)), AIRPORT_FEES), F.lit(DEFAULT_FEE))


def unbundle(total: Column, origin: Column, convenience: float = 300.0) -> dict[str, Column]:
    """Base, taxes, airport fee and convenience fee that add up to the total."""
    fee = airport_fee(origin)
    full = total > fee + SECURITY_FEE + convenience + 500.0
    base = F.when(full, F.round((total - SECURITY_FEE - fee - convenience) / (1 + GST), 2)).otherwise(F.round(total * 0.75, 2))
    taxes = F.when(full, F.round(F.round(base * GST, 2) + SECURITY_FEE, 2)).otherwise(F.round(total * 0.15, 2))
    fee = F.when(full, fee).otherwise(F.round(total * 0.05, 2))
    return {"base_fare": base, "taxes": taxes, "airport_fee": fee, "convenience": F.round(total - base - taxes - fee, 2)}


def domain_root(url: Column) -> Column:
    """The registered domain of an address; hosts of digits only are kept whole."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    parts = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(host.rlike(r"^[\d.]+$") | (F.size(parts) <= 2), host).when(last(2).isin(TWO_PART), last(3)).otherwise(last(2))


def redact_url(url: Column) -> Column:
    """The values of credential parameters are replaced."""
    return F.regexp_replace(url, r"(?i)([?&](?:" + "|".join(CREDENTIALS) + ")=)[^&#]*", "$1[REDACTED]")


def redact_headers(headers: Column) -> Column:
    """A map of headers with the values of those that carry credentials replaced."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(HEADERS) | F.endswith(F.lower(k), F.lit("-client-secret")), "[REDACTED]").otherwise(v))


def redact_text(text: Column) -> Column:
    """Bearer tokens and the values of access tokens in JSON are replaced."""
    bearer = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]")
    return F.regexp_replace(bearer, r'(?i)("access_token"\s*:\s*")[^"]+(")', "$1[REDACTED]$2")


def blocked(title: Column, html: Column, status: Column) -> Column:
    """Whether a page is a challenge in place of results."""
    head = F.lower(F.concat_ws(" ", title, F.substring(html, 1, 4000)))
    return F.coalesce(status.isin(403, 429), F.lit(False)) | head.rlike("|".join(HINTS))


def airline_code(raw: Column) -> Column:
    """Upper case without blanks around; null where there is none."""
    return F.nullif(F.upper(F.trim(raw)), F.lit(""))


def fx_rates(text: str) -> Column:
    """A map of rates from a text such as 'USD=83.2, EUR=90.1'; entries that are no numbers are left out."""
    pairs = F.transform(F.split(F.lit(text), ","), lambda x: F.struct(F.upper(F.trim(F.split_part(x, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.split_part(x, F.lit("="), F.lit(2))).try_cast("double").alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull() & (x["k"] != "")))


def to_inr(amount: Column, currency: Column, rates: Column) -> Column:
    """The amount in rupees; null where no positive rate is told."""
    code = F.upper(F.trim(F.coalesce(F.nullif(currency, F.lit("")), F.lit("INR"))))
    rate = F.try_element_at(rates, code)
    return F.when(code == "INR", amount).when(rate > 0, amount * rate)


def iso_date(text: Column) -> Column:
    return F.substring(F.trim(text), 1, 10).try_cast("date")


def payload_hash(text: Column) -> Column:
    return F.sha2(F.nullif(text, F.lit("")).cast("binary"), 256)


def dedupe_fingerprint(origin, dest, departs, carrier, number, cabin_, family, stops_, horizon, collected) -> Column:
    """One for the same seat from whatever source, at whatever price."""
    parts = F.concat_ws(
        "|", origin, dest, departs.cast("string"), carrier, F.coalesce(number, F.lit("NOFLIGHT")), cabin_, F.coalesce(family, F.lit("UNSPECIFIED")), stops_.cast("string"),
        F.concat(F.lit("H"), horizon.cast("string")), collected.cast("string"),
    )
    return key_hash(parts)


def dynamic_route_id(origin: Column, dest: Column) -> Column:
    return F.lit(1000) + F.crc32(F.concat(origin, F.lit("-"), dest).cast("binary")) % 900_000


def change_text(pct: Column, status: Column, label: str) -> Column:
    """A change with its sign, or plainly why there is none: never zero in its place."""
    short = f"Not available — the collected series is too short for a {label} comparison"
    why = F.when(status == "insufficient_history", short).when(status == "invalid_comparison_base", "Not available — the comparison period's index is not usable")
    told = F.replace(F.format_number(pct, 2), F.lit(","), F.lit(""))  # rounds the double itself, as the reference does; format_string rounds its shortest digits
    return F.when(pct.isNotNull(), F.concat(F.when(F.startswith(told, F.lit("-")), "").otherwise("+"), told, F.lit("%"))).otherwise(why)


def retry_delay(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before an attempt, the second waiting base."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 2), F.lit(most))


def titleized(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, r"\s+"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), " ")


def without_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def error_detail(body: Column) -> Column:
    """Title and detail of the first error that a reply's body tells, and no more of the body."""
    errors = F.from_json(body, "struct<errors: array<struct<title: string, detail: string>>>")["errors"]
    first = F.get(errors, F.lit(0))
    told = F.concat(F.coalesce(first["title"], F.lit("")), F.lit(": "), F.coalesce(first["detail"], F.lit("")))
    told = F.nullif(F.regexp_replace(told, "^[: ]+|[: ]+$", ""), F.lit(""))
    return F.when(F.try_parse_json(body).isNull(), "(no parseable error body)").otherwise(F.coalesce(F.when(F.size(errors) > 0, told), F.lit("(unspecified error)")))


def valid_horizons(asked: Column, policy: list[int]) -> tuple[Column, Column]:
    """The asked horizons in order, each once, and those that the policy does not have."""
    once = F.array_distinct(asked)
    return once, F.array_except(once, F.array(*[F.lit(x) for x in policy]))
