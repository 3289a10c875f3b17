"""From elementary cells to routes and the nation: weights, gates, contributions, uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Policy: horizons with equal weights, and the gates.
HORIZONS, ALPHA = [1, 7, 15, 30, 45], 0.2
MIN_HORIZONS, MIN_HORIZON_MATCHED, MIN_COVERAGE = 2, 3, 0.70


def weights(basket: DataFrame) -> DataFrame:
    """basket with `weight`, passengers by their sum. The basket is a small dimension of one row a route."""
    total = basket.agg(F.sum("passengers").alias("_total"))
    return basket.join(F.broadcast(total), F.lit(True)).withColumn("weight", F.when(F.col("_total") > 0, F.col("passengers") / F.col("_total"))).drop("_total")


def route_indices(cells: DataFrame) -> DataFrame:
    """Horizons combined with policy weights, renormalised over those present; `publishable` needs MIN_HORIZONS."""
    usable = cells.filter((F.col("n_matched") >= MIN_HORIZON_MATCHED) & (F.col("index") > 0) & F.col("horizon").isin(HORIZONS))
    policy = F.array(*[F.lit(h) for h in HORIZONS])
    grouped = usable.groupBy("route_id", "period").agg(
        (F.sum(ALPHA * F.col("index")) / F.sum(F.lit(ALPHA))).alias("index"),
        F.count("*").alias("n_horizons"),
        F.sum(F.lit(ALPHA)).alias("weight_present"),
        F.array_sort(F.collect_set("horizon")).alias("_present"),
    )
    return grouped.select(
        "route_id",
        "period",
        "index",
        "n_horizons",
        "weight_present",
        F.array_join("_present", ",").alias("horizons_included"),
        F.array_join(F.array_except(policy, "_present"), ",").alias("horizons_missing"),
        (F.col("n_horizons") >= MIN_HORIZONS).alias("publishable"),
    )


def route_indices_by(cells: DataFrame, policy: DataFrame) -> DataFrame:
    """route_indices with the weights of a policy (horizon, alpha: a row a horizon), renormalised over the horizons present."""
    usable = cells.filter((F.col("n_matched") >= MIN_HORIZON_MATCHED) & (F.col("index") > 0)).join(F.broadcast(policy), "horizon")
    found = usable.groupBy("route_id", "period").agg(
        (F.sum(F.col("alpha") * F.col("index")) / F.sum("alpha")).alias("index"), F.count("*").alias("n_horizons"), F.sum("alpha").alias("weight_present"), F.sum("n_matched").alias("n_matched")
    )
    return found.withColumn("publishable", F.col("n_horizons") >= MIN_HORIZONS)


def national(routes: DataFrame, weighted: DataFrame, by: list[str]) -> DataFrame:
    """100 * sum(w * I) / sum(w) over the basket's routes present, with the coverage gate."""
    joined = routes.join(F.broadcast(weighted.select("route_id", "weight")), "route_id").filter(F.col("index") > 0)
    return (
        joined.groupBy(*by)
        .agg(
            F.count("*").alias("n_routes"),
            F.sum("weight").alias("coverage"),
            (100 * F.sum(F.col("weight") * F.col("index")) / F.sum("weight")).alias("index"),
        )
        .withColumn("publishable", F.col("coverage") >= MIN_COVERAGE)
        .withColumn("renormalised", F.abs(F.col("coverage") - 1) > 1e-9)
    )


def contributions(routes: DataFrame, weighted: DataFrame) -> DataFrame:
    """Each route's points and share of the period's index, and its rank."""
    joined = routes.join(F.broadcast(weighted.select("route_id", "weight")), "route_id").filter(F.col("index") > 0)
    of = Window.partitionBy("period")
    points = joined.withColumn("points", 100 * F.col("weight") * F.col("index") / F.sum("weight").over(of))
    share = 100 * F.col("points") / F.sum("points").over(of)
    return points.withColumn("share_pct", share).withColumn("rank", F.row_number().over(of.orderBy(F.desc("points"), "route_id"))).select(
        "period", "route_id", "weight", "index", "points", "share_pct", F.col("rank").cast("long").alias("rank")
    )


def missing_routes(routes: DataFrame, cells: DataFrame, weighted: DataFrame) -> DataFrame:
    """Basket routes without a publishable index in a period, with the reason."""
    periods = cells.select("period").distinct()
    wanted = periods.join(F.broadcast(weighted.select("route_id", "weight")), F.lit(True))
    present = routes.filter("publishable").select("route_id", "period")
    seen = cells.groupBy("route_id", "period").agg(F.count("*").alias("_cells"))
    reason = F.when(F.col("_cells").isNull(), "route_not_collected").otherwise("insufficient_horizons")
    return wanted.join(present, ["route_id", "period"], "left_anti").join(seen, ["route_id", "period"], "left").select("period", "route_id", "weight", reason.alias("reason"))


def decompose_change(parts: DataFrame) -> DataFrame:
    """Change of the index in points by route, from contributions of neighbouring periods; routes of both."""
    before = parts.select((F.col("period") + 1).alias("period"), "route_id", F.col("points").alias("_before"))
    moved = parts.join(before, ["period", "route_id"]).withColumn("change_points", F.col("points") - F.col("_before"))
    total = F.sum("change_points").over(Window.partitionBy("period"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc(F.round(F.abs("change_points"), 9)), "route_id"))
    share = F.when(F.abs(total) > 1e-12, 100 * F.col("change_points") / total)
    return moved.select("period", "route_id", "change_points", share.alias("share_pct"), rank.cast("long").alias("rank"))


def national_uncertainty(cells: DataFrame, weighted: DataFrame) -> DataFrame:
    """Standard errors of the national index by period.

    cells: with_uncertainty rows. A route's variance adds its horizons' with the weights
    applied; the nation's adds the routes'. `se_reference` takes ratio-scale errors with raw
    weights, `se_corrected` puts them on the index's scale with weights renormalised. One
    unknown error makes the period's unknown.
    """
    usable = cells.filter((F.col("n_matched") >= MIN_HORIZON_MATCHED) & F.col("horizon").isin(HORIZONS))
    routes = usable.groupBy("route_id", "period").agg(
        F.count("*").alias("n"), F.when(F.count("se") == F.count("*"), F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("se")
    ).filter(F.col("n") >= MIN_HORIZONS)
    joined = routes.join(F.broadcast(weighted.select("route_id", "weight")), "route_id")
    root = F.when(F.count("se") == F.count("*"), F.sqrt(F.sum(F.pow(F.col("weight") * F.col("se"), F.lit(2.0)))))
    return joined.groupBy("period").agg(F.count("*").alias("n_routes"), root.alias("se_reference"), (100 * root / F.sum("weight")).alias("se_corrected"))
