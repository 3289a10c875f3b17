"""Reference tables: baskets and policies from JSON documents, checked as they are read; the capability table and the calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASKET = "basket_version string, routes array<struct<route_id: int, origin_code: string, destination_code: string, monthly_pax: long, is_active: boolean>>"
POLICY = """policy_version string, horizons array<struct<days: int, label: string>>, weighting struct<method: string, weights: map<string, double>>,
  requirements struct<min_horizons_for_route_index: int, min_matched_products_per_horizon: int>"""

# What each registered source is; the last one was assessed and declined.
CAPABILITIES = [
    ("amadeus", "live", True, True), ("live_portal", "live", True, False), ("easemytrip", "live", True, False), ("makemytrip", "live", True, False), ("goibibo", "live", True, False),
    ("cleartrip", "live", True, False), ("indigo", "live", True, False), ("air_india", "live", True, False), ("spicejet", "live", True, False), ("akasa", "live", True, False),
    ("skyscanner", "live", True, False), ("fast_flights", "live", True, False), ("simulator", "simulated", True, False), ("offline_fixture", "offline", True, False), ("kiwi", "live", False, False),
]

# Festivals with their days in two seasons, typical surge in per cent, index at its peak, and severity.
CALENDAR = [
    ("diwali", "2025-10-20", "2025-11-05", "2026-11-08", "2026-11-18", 52.5, 158.4, "CRITICAL"),
    ("chhath", "2025-11-06", "2025-11-12", "2026-11-19", "2026-11-25", 58.0, 164.2, "CRITICAL"),
    ("durga_puja", "2025-10-08", "2025-10-18", "2026-10-16", "2026-10-24", 39.5, 142.8, "HIGH"),
    ("new_year_goa", "2025-12-20", "2026-01-05", "2026-12-20", "2027-01-05", 44.0, 147.6, "HIGH"),
    ("pongal_sankranti", "2026-01-12", "2026-01-18", "2027-01-12", "2027-01-18", 32.0, 133.5, "MODERATE"),
    ("holi", "2026-03-10", "2026-03-18", "2027-02-28", "2027-03-06", 34.5, 136.2, "MODERATE"),
]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "name string, source_type string, enabled boolean, requires_credentials boolean")


def calendar(spark: SparkSession) -> DataFrame:
    """A row for each festival and season: twelve."""
    c = spark.createDataFrame([(f, *days, surge, severity) for f, *days, surge, _, severity in CALENDAR], "festival string, a string, b string, c string, d string, surge_pct double, severity string")
    seasons = F.array(*[F.struct(F.to_date(a).alias("first_day"), F.to_date(b).alias("last_day")) for a, b in (("a", "b"), ("c", "d"))])
    return c.select("festival", "surge_pct", "severity", F.inline(seasons))


def baskets(texts: DataFrame, text_col: str) -> DataFrame:
    """A row for each route of each document, with its weight by passengers; a document that may not be used is one row with its `fault`."""
    doc = texts.withColumn("_doc", F.from_json(text_col, BASKET, {"mode": "PERMISSIVE"}))
    routes, ids = F.col("_doc.routes"), F.col("_doc.routes.route_id")
    total = F.aggregate(routes, F.lit(0).cast("long"), lambda n, r: n + F.coalesce(r.monthly_pax, F.lit(0).cast("long")))
    fault = F.coalesce(
        F.when(F.col("_doc").isNull() | (F.col("_doc.basket_version").isNull() & routes.isNull()), "not a JSON basket"), F.when(routes.isNull() | (F.size(routes) == 0), "no routes"),
        F.when(F.exists(ids, lambda x: x.isNull()), "route without an id"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate route_id"),
        F.when(F.exists(routes, lambda r: F.coalesce(r.monthly_pax, F.lit(-1)) < 0), "passengers missing or negative"), F.when(total <= 0, "no passengers"),
    )
    judged = doc.withColumn("fault", fault).withColumn("_total", total)
    found = judged.select(*texts.columns, "fault", "_total", F.col("_doc.basket_version").alias("basket_version"), F.explode_outer(F.when(F.col("fault").isNull(), routes)).alias("_r"))
    return found.select(
        *[c for c in texts.columns if c != text_col], "basket_version", "_r.route_id", F.upper("_r.origin_code").alias("origin_code"), F.upper("_r.destination_code").alias("destination_code"),
        "_r.monthly_pax", F.coalesce("_r.is_active", F.col("_r").isNotNull()).alias("is_active"), (F.col("_r.monthly_pax") / F.col("_total")).alias("weight"), "fault",
    )


def policies(texts: DataFrame, text_col: str) -> DataFrame:
    """A row for each horizon of each document, with its declared weight, or equal ones where none are declared; else the `fault`."""
    doc = texts.withColumn("_doc", F.from_json(text_col, POLICY, {"mode": "PERMISSIVE"}))
    horizons, declared = F.col("_doc.horizons"), F.col("_doc.weighting.weights")
    some = F.coalesce(F.size(F.map_keys(declared)) > 0, F.lit(False))
    total = F.aggregate(F.map_values(declared), F.lit(0.0), lambda n, x: n + x)
    fault = F.coalesce(
        F.when(F.col("_doc").isNull() | (F.col("_doc.policy_version").isNull() & horizons.isNull()), "not a JSON policy"), F.when(horizons.isNull() | (F.size(horizons) == 0), "no horizons"),
        F.when(some & F.exists(horizons, lambda h: ~F.coalesce(F.map_contains_key(declared, h.days.cast("string")), F.lit(False))), "horizon without a weight"),
        F.when(some & ~F.coalesce(F.abs(total - 1) <= 1e-9, F.lit(False)), "weights do not sum to 1"),
    )
    judged = doc.withColumn("fault", fault).withColumn("_some", some).withColumn("_w", declared).withColumn("_n", F.size(horizons))
    found = judged.select(*texts.columns, "fault", "_some", "_w", "_n", F.col("_doc.policy_version").alias("policy_version"), F.explode_outer(F.when(F.col("fault").isNull(), horizons)).alias("_h"))
    weight = F.when(F.col("_some"), F.try_element_at("_w", F.col("_h.days").cast("string"))).otherwise(1 / F.col("_n"))
    return found.select(
        *[c for c in texts.columns if c != text_col], "policy_version", F.col("_h.days").alias("horizon"), F.coalesce("_h.label", F.concat(F.lit("T+"), F.col("_h.days"))).alias("label"),
        F.when(F.col("_h").isNotNull(), weight).alias("alpha"), "fault",
    )


OFFICIAL = """struct<monthly_benchmarks: array<struct<month: string, airfare_item_index: double, transport_index: double, cpi_combined: double, mospi_release_date: string, status: string>>>"""
BENCHMARK = """struct<daily_benchmarks: array<struct<date: string, dgca_benchmark_index: double, observed_yield_rpkm: double>>>"""


def _series(texts: DataFrame, text_col: str, schema: str, field: str, at: str, pattern: str, values: list[str], kind: str) -> DataFrame:
    """Documents' points exploded, `_p` and `fault`: a document at fault is one row without a point."""
    doc = texts.withColumn("_doc", F.from_json(text_col, schema, {"mode": "PERMISSIVE"}))
    points = F.col("_doc")[field]
    lacks = lambda v: F.exists(points, lambda p: ~F.coalesce(p[v] > 0, F.lit(False)))
    fault = F.coalesce(
        F.when(F.try_parse_json(text_col).isNull(), f"not a JSON {kind}"), F.when(points.isNull() | (F.size(points) == 0), "no points"),
        F.when(F.exists(points, lambda p: ~F.coalesce(p[at].rlike(pattern), F.lit(False))), f"{at} missing or malformed"),
        F.when(F.size(F.array_distinct(points[at])) < F.size(points), f"duplicate {at}"),
        *[F.when(lacks(v), f"{v} missing or not positive") for v in values],
    )
    judged = doc.withColumn("fault", fault)
    return judged.select(*[c for c in texts.columns if c != text_col], F.explode_outer(F.when(F.col("fault").isNull(), points)).alias("_p"), "fault")


def official(texts: DataFrame, text_col: str) -> DataFrame:
    """A row for each month of each document of an official series; a document that may not be used is one row with its `fault`."""
    found = _series(texts, text_col, OFFICIAL, "monthly_benchmarks", "month", r"^\d{4}-(0[1-9]|1[0-2])$", ["airfare_item_index", "transport_index", "cpi_combined"], "series")
    keys = [c for c in texts.columns if c != text_col]
    status = F.when(F.col("_p").isNotNull(), F.coalesce("_p.status", F.lit("FINAL")))
    return found.select(*keys, "_p.month", *[F.col(f"_p.{c}").alias(c) for c in ("airfare_item_index", "transport_index", "cpi_combined")], F.col("_p.mospi_release_date").try_cast("date").alias("release_date"), status.alias("status"), "fault")


def benchmark(texts: DataFrame, text_col: str) -> DataFrame:
    """A row for each day of each benchmark document, with the yield that is assumed where none is told; else its `fault`."""
    found = _series(texts, text_col, BENCHMARK, "daily_benchmarks", "date", r"^\d{4}-\d{2}-\d{2}$", ["dgca_benchmark_index"], "benchmark")
    keys = [c for c in texts.columns if c != text_col]
    rpkm = F.when(F.col("_p").isNotNull(), F.coalesce("_p.observed_yield_rpkm", F.lit(4.5)))
    return found.select(*keys, F.col("_p.date").try_cast("date").alias("day"), F.col("_p.dgca_benchmark_index").alias("index"), rpkm.alias("yield_rpkm"), "fault")


def load(spark: SparkSession, path: str, parse: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of one document, by `baskets` or `policies`; an error if the document is at fault."""
    rows = parse(spark.read.text(path, wholetext=True), "value")
    wrong = rows.filter("fault is not null").select("fault").first()
    if wrong is not None:
        raise ValueError(f"{path}: {wrong.fault}")
    return rows.drop("fault")


def ranked_sources(table: DataFrame) -> DataFrame:
    """The capability table in the order that it is listed in: by type, then name."""
    return table.withColumn("place", F.row_number().over(Window.orderBy("source_type", "name")).cast("long"))  # a row a source
