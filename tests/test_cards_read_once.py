"""A card's text is made once a row, however many columns and filters read it."""

from pyspark.sql import functions as F

from tidemark.sources import pages


def test_card_text_is_made_once(spark):
    df = spark.range(40).select("id", F.concat(F.lit("only here: "), F.col("id"), F.lit(" IndiGo ₹ 4,000")).alias("card"), F.lit("DEL").alias("o"), F.lit("BOM").alias("d"), F.lit(1).alias("page"))
    for found in (pages.site_quotes(df, "card", "skyscanner", "page", "o", "d", "id"), pages.cards(df, "card", "o", "d", "id")):
        plan = found.select("id", "carrier", "fare", "flight")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("only here") == 1
