"""Index series: nearest-date changes, re-referencing, windows, co-movement, regression by moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_change(current: Column, previous: Column) -> tuple[Column, Column]:
    pct = F.when(previous > 0, 100 * (current / previous - 1))
    status = F.when(previous.isNull(), "insufficient_history").when(previous <= 0, "invalid_comparison_base").otherwise("available")
    return pct, status


def nearest(series: DataFrame, key: list[str], months: int, reach: int = 7) -> DataFrame:
    """series (key, day, value) with the value nearest to the day `months` earlier: within `reach` days and its month; earlier first.

    Each target day asks for its 2 * reach + 1 candidate days by equality, so that the band
    join is a hash or merge join on (key, day).
    """
    anchor = F.add_months("day", -months)
    asked = series.withColumn("_anchor", anchor).withColumn("_off", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    asked = asked.withColumn("_day", F.date_add("_anchor", F.col("_off"))).filter(F.trunc("_day", "month") == F.trunc("_anchor", "month"))
    past = series.select(*key, F.col("day").alias("_day"), F.col("value").alias("_value"))
    found = asked.join(past, [*key, "_day"]).groupBy(*key, "day").agg(F.min_by(F.struct("_day", "_value"), F.struct(F.abs("_off"), "_off")).alias("_hit"))
    return series.join(found, [*key, "day"], "left").select(*key, "day", "value", F.col("_hit._day").alias("matched_day"), F.col("_hit._value").alias("previous"))


def rebase(series: DataFrame, start: str, end: str) -> DataFrame:
    """series (day, value) with 100 at the geometric mean of its positive values in the window; unchanged if there are none."""
    divisor = series.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("value") > 0)).agg(F.exp(F.avg(F.ln("value"))).alias("divisor"))
    joined = series.join(F.broadcast(divisor), F.lit(True))
    return joined.withColumn("rebased", F.when(F.col("divisor").isNull(), F.col("value")).otherwise(100 * F.col("value") / F.col("divisor"))).withColumn("applied", F.col("divisor").isNotNull())


def reference_windows(series: DataFrame) -> DataFrame:
    return series.groupBy(F.year("day").alias("year")).agg(
        F.count("*").alias("n_points"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.countDistinct(F.month("day")) == 12).alias("complete")
    )


def quadratic_fit(df: DataFrame, x: str, y: str, by: list[str], least: int) -> DataFrame:
    """ln(y) on 1, x, x**2 from eight sums of one aggregate, solved by Cramer's rule in columns: betas, r2, n."""
    X, Y = F.col(x).cast("double"), F.ln(F.col(y))
    clean = df.filter((F.col(x) >= 0) & (F.col(y) > 0))
    total = lambda c, name: F.sum(c).alias(name)
    s = clean.groupBy(*by).agg(
        F.count("*").alias("n"), total(X, "s1"), total(X * X, "s2"), total(X * X * X, "s3"), total(X * X * X * X, "s4"),
        total(Y, "y0"), total(X * Y, "y1"), total(X * X * Y, "y2"), total(Y * Y, "yy"),
    ).filter(F.col("n") >= least)
    n, s1, s2, s3, s4, y0, y1, y2, yy = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2", "yy"))
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    d = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    s = s.withColumn("_d", d).filter(F.abs("_d") > 1e-6)
    s = s.withColumn("b0", det(y0, s1, s2, y1, s2, s3, y2, s3, s4) / F.col("_d"))
    s = s.withColumn("b1", det(n, y0, s2, s1, y1, s3, s2, y2, s4) / F.col("_d"))
    s = s.withColumn("b2", det(n, s1, y0, s1, s2, y1, s2, s3, y2) / F.col("_d"))
    tss = yy - y0 * y0 / n
    rss = yy - F.col("b0") * y0 - F.col("b1") * y1 - F.col("b2") * y2
    r2 = F.when(tss > 1e-6, F.least(F.greatest(1 - rss / tss, F.lit(0.0)), F.lit(1.0)))
    best = F.when(F.col("b2") > 1e-8, F.least(F.greatest(-F.col("b1") / (2 * F.col("b2")), F.lit(1.0)), F.lit(90.0)))
    return s.select(*by, "n", "b0", "b1", "b2", r2.alias("r2"), best.alias("best_x"))


def slope_pct(x: Column) -> Column:
    """Per cent that a fit's value changes by a unit at x."""
    return 100 * (F.col("b1") + 2 * F.col("b2") * x)


def curve(fits: DataFrame, points: list[int]) -> DataFrame:
    """Each fit's values and slopes at the points, a row each."""
    x = F.col("x").cast("double")
    at = fits.withColumn("x", F.explode(F.array(*[F.lit(p) for p in points])))
    return at.withColumn("predicted", F.exp(F.col("b0") + F.col("b1") * x + F.col("b2") * x * x)).withColumn("slope_pct", slope_pct(x))


def latest_before(series: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """asked (key, day) with the latest point of series (key, day, value) strictly before each day: `found_day`, `found`.

    Both are laid in one line by key and day; no range join.
    """
    line = asked.select(*key, "day", F.lit(1).alias("_ask"), F.lit(None).cast("double").alias("value")).unionByName(series.select(*key, "day", F.lit(0).alias("_ask"), F.col("value").cast("double").alias("value")))
    before = Window.partitionBy(*key).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    point = F.struct("day", "value")
    seen = line.withColumn("_hit", F.max(F.when(F.col("_ask") == 0, point)).over(before)).filter("_ask = 1")
    return seen.select(*key, "day", F.col("_hit.day").alias("found_day"), F.col("_hit.value").alias("found"))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict, grain: float = 1.0) -> DataFrame:
    """Per group: `n` (rows with a value) and the values at ranks, each a function of the column n, counted from 0.

    Rows are counted by distinct value, map-side first; counts are summed up by parts of width `grain` to
    find where each rank lies, and only the values of that part are ordered: no task gets
    a group's values whole.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")).withColumn("_part", F.floor(F.col(value) / grain))
    of = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = counts.groupBy(*by, "_part").agg(F.sum("_c").alias("_t"))
    parts = parts.withColumn("_before", F.sum("_t").over(of.orderBy("_part")) - F.col("_t")).withColumn("n", F.sum("_t").over(of))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("at")) for name, rank in ranks.items()]))
    asked = parts.select("*", asked.alias("_ask")).filter((F.col("_before") <= F.col("_ask.at")) & (F.col("_ask.at") < F.col("_before") + F.col("_t")))
    near = counts.join(asked.select(*by, "_part", "n", F.col("_ask.name").alias("_name"), (F.col("_ask.at") - F.col("_before")).alias("_at")), [*by, "_part"])
    near = near.withColumn("_up", F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy(value)))
    hit = near.filter((F.col("_up") - F.col("_c") <= F.col("_at")) & (F.col("_at") < F.col("_up")))
    return hit.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks])


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], grain: float = 1.0) -> DataFrame:
    """Per group: `n` and the exact quantiles named in points, between the two nearest values in proportion."""
    ranks = {}
    for name, p in points.items():
        ranks |= {f"_lo_{name}": lambda n, p=p: F.floor(p * (n - 1)), f"_hi_{name}": lambda n, p=p: F.ceil(p * (n - 1))}
    found = order_statistics(df, by, value, ranks, grain)
    between = lambda name, p: F.col(f"_lo_{name}") + (p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return found.select(*by, "n", *[between(name, p).alias(name) for name, p in points.items()])


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: `n` and the exact `median`, between the two middle values if there are two."""
    found = order_statistics(df, by, value, {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.ceil((n - 1) / 2)})
    return found.select(*by, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))
