"""Index queries over quotes of every type and method: on small tables, they give what quotes of one type and method give."""

import datetime as dt
import random

import pytest

from tidemark import catalog

WHOLE = [
    "national_index",
    "product_geomean_prices",
    "base_price_set",
    "jevons_elementary",
    "dutot_elementary",
    "gm_ratio_elementary",
    "jevons_time_reversal",
    "product_churn",
    "reappeared_products",
    "spec_fallback_index",
    "elementary_uncertainty",
    "route_index",
    "national_by_horizon",
    "national_contributions",
    "missing_routes",
    "change_decomposition",
    "national_uncertainty",
    "national_index_with_connections",
    "headline_rows",
    "national_latest",
    "national_changes",
    "uncertainty_bands",
    "match_quality",
    "route_extremes",
    "weighted_horizon_index",
    "base_window_index",
]


def tables(spark, path, mixed):
    """Twelve products, eleven of them in the base, on four routes in three years and at five horizons. If mixed, types and methods of the same quotes change from line to line."""
    r, lines, orders = random.Random(5), [], []
    for year in (1995, 1996, 1997):
        for horizon in range(5):
            key = len(orders)
            orders.append((key, key % 5, f"{horizon + 1}-X", dt.datetime(year, 6, 1)))
            for i in range(48 if year > 1995 else 44):  # the last product is new after the base
                kind, tax = ("NRA"[i % 3], 0.02 if i % 2 else 0.08) if mixed else ("N", 0.02)
                lines.append((key, i // 4, i % 4, 6 if i % 11 == 0 else 1, 1.0, round(r.uniform(900, 9000), 2), 0.0, tax, kind, dt.datetime(year, 6, 15)))
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz"),
        "part": ([(k, f"Brand#{k % 3}", f"T{k % 2}") for k in range(12)], "p_partkey long, p_brand string, p_type string"),
        "supplier": ([(k, k) for k in range(4)], "s_suppkey long, s_nationkey int"),
        "customer": ([(k, k % 5) for k in range(50)], "c_custkey long, c_nationkey int"),
        "region": ([(0,), (1,)], "r_regionkey int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    return [tables(spark, str(tmp_path_factory.mktemp(x)), x == "mixed") for x in ("mixed", "one")]


def rows(spark, name, path):
    df = catalog.queries()[name](spark, path)
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", WHOLE)
def test_every_type_and_method(spark, both, name):
    mixed, one = (rows(spark, name, path) for path in both)
    assert one and mixed == one
