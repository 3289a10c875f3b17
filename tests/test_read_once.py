"""Work that a plan does once: the quotes of fare_stats are joined and written once."""

from tidemark import catalog

SF = "/root/testdata/sf0.001"


def test_fare_stats_reads_line_items_once(spark):
    df = catalog.queries()["fare_stats"](spark, SF)
    assert not any("lineitem" in x for x in df.inputFiles())  # what is left reads what was written once
