"""Elementary price indices: product prices, matched relatives, and the formulas over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import quantiles
from tidemark.sources.store import settle

CELL = ["route_id", "horizon", "period"]
CLIP_LOW, CLIP_HIGH = 0.1, 10.0
WINSOR_LOW, WINSOR_HIGH, WINSOR_LEAST = 0.01, 0.99, 10
MIN_MATCHED, MIN_SPEC = 3, 2

# Two-sided 95 % points of Student's t by degrees of freedom; between entries the lower one holds.
T_95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
    25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980,
}
Z_95 = 1.959964


def geomean(x: Column) -> Column:
    """The geometric mean of the positive values, in logs."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def product_prices(quotes: DataFrame) -> DataFrame:
    """A price for each product, cell and period: the geometric mean of its positive fares."""
    return quotes.filter("fare > 0").groupBy(*CELL, "product", "spec").agg(geomean(F.col("fare")).alias("price"), F.count("*").alias("n_quotes"))


def base_window(quotes: DataFrame, start: str, end: str) -> DataFrame:
    """quotes with period 0 for the days of [start, end]; earlier ones go, later ones keep their period. `matched` takes 0 as its base."""
    day = F.col("day")
    return quotes.filter(day >= F.lit(start).cast("date")).withColumn("period", F.when(day <= F.lit(end).cast("date"), 0).otherwise(F.col("period")))


def spec_prices(products: DataFrame) -> DataFrame:
    """Prices of specifications: geometric means of product prices, not of pooled quotes."""
    return products.groupBy(*CELL, "spec").agg(geomean(F.col("price")).alias("price"), F.sum("n_quotes").alias("n_quotes"))


def matched(prices: DataFrame, key: str, base: int, after: bool = True) -> DataFrame:
    """Pairs of each later period's price with the base period's, by route, horizon and key."""
    old = prices.filter(F.col("period") == base).select("route_id", "horizon", key, F.col("price").alias("base_price"))
    new = prices.filter(F.col("period") > base if after else F.lit(True))
    pairs = new.join(old, ["route_id", "horizon", key]).filter("price > 0 and base_price > 0")
    return pairs.select(*CELL, key, "price", "base_price")


def clip(relative: Column) -> Column:
    return F.least(F.greatest(relative, F.lit(CLIP_LOW)), F.lit(CLIP_HIGH))


def winsorized(pairs: DataFrame, by: list[str] = CELL, value: str = "relative", grain: float = 0.001) -> DataFrame:
    """pairs with `value` held between its cell's 1st and 99th percentile where the cell has WINSOR_LEAST values.

    The percentiles come from counts (see order_statistics; grain is the width of its parts), so that a
    cell of any size is spread over tasks.
    """
    pairs = settle(pairs, "winsorized")  # counted, looked through and held: read three times
    bounds = quantiles(pairs, by, value, {"_lo": WINSOR_LOW, "_hi": WINSOR_HIGH}, grain)
    held = F.when(F.col("n") >= WINSOR_LEAST, F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))).otherwise(F.col(value))
    return pairs.join(bounds, by).withColumn(value, held).drop("_lo", "_hi")


def jevons(pairs: DataFrame, least: int = MIN_MATCHED, by: list[str] = CELL) -> DataFrame:
    """The geometric mean of clipped, winsorized relatives, and what its uncertainty needs."""
    raw = F.col("price") / F.col("base_price")
    clipped = pairs.withColumn("_clipped", ((raw < CLIP_LOW) | (raw > CLIP_HIGH)).cast("long")).withColumn("relative", clip(raw))
    held = winsorized(clipped, by)
    return (
        held.groupBy(*by)
        .agg(
            F.count("*").alias("n_matched"),
            F.sum("_clipped").alias("n_clipped"),
            geomean(F.col("relative")).alias("index"),
            F.stddev_samp(F.ln("relative")).alias("log_sd"),
        )
        .filter(F.col("n_matched") >= least)
    )


def carli(pairs: DataFrame, least: int = MIN_MATCHED) -> DataFrame:
    return pairs.groupBy(*CELL).agg(F.count("*").alias("n_matched"), F.avg(F.col("price") / F.col("base_price")).alias("index")).filter(F.col("n_matched") >= least)


def dutot(pairs: DataFrame, least: int = MIN_MATCHED) -> DataFrame:
    return pairs.groupBy(*CELL).agg(F.count("*").alias("n_matched"), (F.avg("price") / F.avg("base_price")).alias("index")).filter(F.col("n_matched") >= least)


def geomean_ratio(prices: DataFrame, base: int, least: int = MIN_MATCHED) -> DataFrame:
    """The unmatched alternative: the ratio of geometric mean levels, each side winsorized by itself."""
    levels = winsorized(prices, CELL, "price", 1.0).groupBy(*CELL).agg(F.count("*").alias("n"), geomean(F.col("price")).alias("level"))
    old = levels.filter(F.col("period") == base).select("route_id", "horizon", F.col("n").alias("n_base"), F.col("level").alias("base_level"))
    new = levels.filter(F.col("period") > base)
    return new.join(old, ["route_id", "horizon"]).filter((F.col("n") >= least) & (F.col("n_base") >= least)).select(*CELL, "n", "n_base", (F.col("level") / F.col("base_level")).alias("index"))


def exact_or_spec(prices: DataFrame, base: int) -> DataFrame:
    """Cells by exact products where MIN_MATCHED match, else by specifications where MIN_SPEC match: `method` tells."""
    exact = jevons(matched(prices, "product", base)).withColumn("method", F.lit("exact"))
    spec = jevons(matched(spec_prices(prices), "spec", base), MIN_SPEC).withColumn("method", F.lit("spec"))
    return exact.unionByName(spec.join(exact.select(*CELL), CELL, "left_anti"))


def churn(prices: DataFrame, base: int) -> DataFrame:
    """Matched, new and disappeared products of every later cell, from one full outer join."""
    cells = prices.filter(F.col("period") > base).select(*CELL).distinct()
    old = prices.filter(F.col("period") == base).select("route_id", "horizon", "product")
    was = cells.join(old, ["route_id", "horizon"]).withColumn("_was", F.lit(1))
    now = prices.filter(F.col("period") > base).select(*CELL, "product").withColumn("_now", F.lit(1))
    both = now.join(was, [*CELL, "product"], "full")
    return both.groupBy(*CELL).agg(
        F.count(F.col("_now") * F.col("_was")).alias("n_matched"),
        F.count("_now").alias("n_current"),
        F.count("_was").alias("n_base"),
        F.count(F.when(F.col("_was").isNull(), 1)).alias("n_new"),
        F.count(F.when(F.col("_now").isNull(), 1)).alias("n_gone"),
    )


def reappeared(prices: DataFrame, base: int) -> DataFrame:
    """Products outside the base that an earlier later period had: how many, by cell."""
    later = prices.filter(F.col("period") > base)
    old = prices.filter(F.col("period") == base).select("route_id", "horizon", "product")
    fresh = later.join(old, ["route_id", "horizon", "product"], "left_anti")
    first = fresh.groupBy("route_id", "horizon", "product").agg(F.min("period").alias("_first"))
    back = fresh.join(first, ["route_id", "horizon", "product"])
    return back.groupBy(*CELL).agg(F.count("*").alias("n_new"), F.count(F.when(F.col("_first") < F.col("period"), 1)).alias("n_reappeared"))


def match_quality(prices: DataFrame, base: int) -> DataFrame:
    """Per later cell: products matched, their share of the base's, and both sides' geometric mean prices over them."""
    pairs = matched(prices, "product", base)
    held = prices.filter(F.col("period") == base).groupBy("route_id", "horizon").agg(F.count("*").alias("n_base"))
    found = pairs.groupBy(*CELL).agg(F.count("*").alias("n_matched"), geomean(F.col("price")).alias("level"), geomean(F.col("base_price")).alias("base_level"))
    return found.join(held, ["route_id", "horizon"]).withColumn("match_rate", F.col("n_matched") / F.col("n_base"))


def t_critical(df: Column) -> Column:
    found = F.lit(float("nan"))
    for least, value in T_95.items():
        found = F.when(df >= least, value).otherwise(found)
    return F.when(df > max(T_95), Z_95).otherwise(found)


def with_uncertainty(cells: DataFrame) -> DataFrame:
    """cells with `se`, `ci_low`, `ci_high` and `basis`, from the spread of log relatives."""
    n, mean = F.col("n_matched"), F.ln("index")
    se = F.col("log_sd") / F.sqrt(n)
    half = t_critical(n - 1) * se
    flat = F.col("log_sd") <= 1e-12
    known = n >= 3
    return cells.select(
        *CELL,
        "n_matched",
        "index",
        F.when(known, F.when(flat, 0.0).otherwise(F.col("index") * se)).alias("se"),
        F.when(known, F.when(flat, F.col("index")).otherwise(F.exp(mean - half))).alias("ci_low"),
        F.when(known, F.when(flat, F.col("index")).otherwise(F.exp(mean + half))).alias("ci_high"),
        F.when(~known, "too_few").when(flat, "no_spread").otherwise("log_relatives").alias("basis"),
    )
