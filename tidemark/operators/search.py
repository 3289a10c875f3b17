"""Searches with facets, and listings in a fixed order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Routes up to this id are those of the basket.
LAST_BASKET_ROUTE = 25
FACETS = ["category", "origin_state", "dest_state"]


def asked(text: str) -> str:
    """A search text as it is compared: lower case, the first arrow or "to" as a dash."""
    return re.sub(r"\s*->\s*|\s*to\s*", "-", text.strip().lower(), count=1)


def with_airports(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """routes (route_id, origin_code, dest_code) with `category` and both ends' city, state and name, null where airports lacks the code.

    airports (code, city, state, name) is a dimension of one row an airport and is broadcast.
    """
    found = routes.withColumn("category", F.when(F.col("route_id") <= LAST_BASKET_ROUTE, "BASKET").otherwise("CUSTOM"))
    for end in ("origin", "dest"):
        own = airports.select(F.col("code").alias(f"{end}_code"), *[F.col(c).alias(f"{end}_{c}") for c in ("city", "state", "name")])
        found = found.join(F.broadcast(own), f"{end}_code", "left")
    return found


def route_hits(routes: DataFrame, text: str = "", **facets: str) -> DataFrame:
    """with_airports' rows that the facets (columns by name) allow and of which one of nine fields has the text: code, cities, states, names, and both pairs."""
    for column, value in facets.items():
        routes = routes.filter(F.col(column) == value)
    q = asked(text)
    if not q:
        return routes
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    pair = lambda c: F.concat(low(f"origin_{c}"), F.lit("-"), low(f"dest_{c}"))
    fields = [pair("code"), *[low(f"{end}_{c}") for c in ("city", "state", "name") for end in ("origin", "dest")], pair("city"), pair("state")]
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.contains(field, F.lit(q))
    return routes.filter(hit)


def facet_counts(hits: DataFrame) -> DataFrame:
    """How many rows each value of each facet has, and how many there are in all: one pass, by grouping sets. `facet` names the column, "all" has no value."""
    sets = [[F.col(c)] for c in FACETS] + [[]]
    level = F.grouping_id(*FACETS)
    counted = hits.groupingSets(sets, *FACETS).agg(level.alias("_level"), F.count("*").alias("n"))
    # a bit of the level is set where its column is grouped away
    of = {0b011: FACETS[0], 0b101: FACETS[1], 0b110: FACETS[2]}
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for bits, c in of.items():
        facet, value = F.when(F.col("_level") == bits, c).otherwise(facet), F.when(F.col("_level") == bits, F.col(c)).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def text_hits(rows: DataFrame, text: str, fields: list[str], **equal: str) -> DataFrame:
    """Rows that agree with `equal` and have the text in one of the fields, in either case; null fields have none."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value)
    q, hit = text.strip().lower(), F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.contains(F.lower(field), F.lit(q)), F.lit(False))
    return rows.filter(hit) if q else rows


def listing(rows: DataFrame, order: list[Column], limit: int, **equal: object) -> DataFrame:
    """The first rows in an order, of those that agree with the values given (None: any). A top-k of every task is merged, no full sort."""
    for column, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.orderBy(*order).limit(limit)
