"""Quotes and series read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days between a quote and its departure, by the leading digit of an order's priority.
HORIZONS = {"1": 1, "2": 7, "3": 15, "4": 30, "5": 45}
FARE_MIN, FARE_MAX = 500.0, 80000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation a line item: route, horizon, product, specification, fare and day."""
    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    digit = F.substring("o_orderpriority", 1, 1)
    horizon = F.lit(HORIZONS["5"])
    for key, days in HORIZONS.items():
        horizon = F.when(digit == key, days).otherwise(horizon)
    return (
        line.join(order.select("o_orderkey", "o_orderpriority", "o_orderdate"), line.l_orderkey == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("s_nationkey").alias("route_id"),
            horizon.alias("horizon"),
            F.col("l_partkey").alias("product"),
            F.concat_ws("|", "p_brand", "p_type").alias("spec"),
            F.col("p_brand").alias("carrier"),
            F.col("p_type").alias("family"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("fare"),
            F.to_date("l_shipdate").alias("day"),
            F.year("l_shipdate").alias("period"),
            F.when(F.col("l_linenumber") <= 5, 0).otherwise(1).alias("stops"),
            F.col("l_returnflag").alias("source_type"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_discount").alias("discount"),
            F.when(F.col("l_tax") > 0.07, "api").otherwise("web_scrape").alias("method"),
        )
    )


def valid_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).filter(F.col("fare").between(FARE_MIN, FARE_MAX))


def observations(quotes: DataFrame, start=None, end=None, routes=None, horizons=None, valid=None, source_type=None, newest: int | None = None) -> DataFrame:
    """The scan with optional predicates, all of them columns that Parquet can skip by; the newest rows first if a number is given."""
    day = F.col("day")
    asked = [
        None if start is None else day >= F.lit(start).cast("date"), None if end is None else day <= F.lit(end).cast("date"), None if routes is None else F.col("route_id").isin(routes),
        None if horizons is None else F.col("horizon").isin(horizons), None if valid is None else F.col("fare").between(FARE_MIN, FARE_MAX) == valid,
        None if source_type is None else F.col("source_type") == source_type,
    ]
    for predicate in asked:
        quotes = quotes if predicate is None else quotes.filter(predicate)
    return quotes if newest is None else quotes.orderBy(F.desc("day"), F.desc("order_id"), F.desc("line_no"), F.desc("fare")).limit(newest)


def scoped(quotes: DataFrame, source_type: str | None = None, method: str | None = None) -> DataFrame:
    """quotes of the source type and the acquisition method that are named."""
    for column, name in (("source_type", source_type), ("method", method)):
        quotes = quotes if name is None else quotes.filter(F.col(column) == name)
    return quotes


def index_quotes(spark: SparkSession, sf_dir: str, direct_only: bool = True, source_type: str | None = None, method: str | None = None) -> DataFrame:
    """The quotes that enter an index: valid ones, of direct flights unless told otherwise. An index that names no type or method must ask governance.index_guard."""
    q = scoped(valid_quotes(spark, sf_dir), source_type, method)
    return q.filter("stops = 0") if direct_only else q


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with their passengers: customers by nation."""
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("route_id")).agg(F.count("*").alias("passengers"))


#: The same tables as SQL for the oracle.
QUOTES_SQL = """
quotes AS (
  SELECT s_nationkey AS route_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 7 WHEN '3' THEN 15 WHEN '4' THEN 30 ELSE 45 END AS horizon,
         l_partkey AS product, p_brand || '|' || p_type AS spec, p_brand AS carrier, p_type AS family,
         l_extendedprice / l_quantity AS fare, CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INTEGER) AS period,
         CASE WHEN l_linenumber <= 5 THEN 0 ELSE 1 END AS stops, l_returnflag AS source_type,
         l_orderkey AS order_id, l_linenumber AS line_no, l_discount AS discount,
         CASE WHEN l_tax > 0.07 THEN 'api' ELSE 'web_scrape' END AS method
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), valid AS (SELECT * FROM quotes WHERE fare BETWEEN 500 AND 80000), direct AS (SELECT * FROM valid WHERE stops = 0 AND source_type = 'N' AND method = 'web_scrape'),
basket AS (SELECT c_nationkey AS route_id, count(*) AS passengers FROM customer GROUP BY 1)
"""
#: The same with direct flights of all types and methods.
WHOLE_SQL = QUOTES_SQL.replace(" AND source_type = 'N' AND method = 'web_scrape'", "")
