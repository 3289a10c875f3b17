"""Registries, states, reviews, late rows and run outcomes on small inputs of their own."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.operators import aggregates as agg
from tidemark.operators import cleaning as cl
from tidemark.operators import elementary as el
from tidemark.operators import governance as gov
from tidemark.sources import registries as reg
from tidemark.sources import store


def written(tmp_path, body):
    path = tmp_path / "doc.json"
    path.write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    return f"file://{path}"


def test_baskets(spark, tmp_path):
    routes = [{"route_id": i, "origin_code": "abc", "destination_code": "XYZ", "monthly_pax": p} for i, p in ((4, 30), (2, 10), (9, 0))]
    got = {r.route_id: r for r in reg.load(spark, written(tmp_path, {"basket_version": "3", "routes": routes, "more": {"x": 1}}), reg.baskets).collect()}
    assert {k: (r.weight, r.origin_code, r.is_active) for k, r in got.items()} == {4: (0.75, "ABC", True), 2: (0.25, "ABC", True), 9: (0.0, "ABC", True)}


@pytest.mark.parametrize(
    ("routes", "fault"),
    [([], "no routes"), (None, "no routes"), ([(1, 5), (1, 6)], "duplicate"), ([(None, 5)], "without an id"), ([(1, 0)], "no passengers"), ([(1, None), (2, 3)], "missing or negative"), ("[", "not a JSON")],
)
def test_faulty_baskets(spark, tmp_path, routes, fault):
    body = routes if isinstance(routes, str) else {"basket_version": "1", "routes": routes and [{"route_id": i, "monthly_pax": p} for i, p in routes]}
    with pytest.raises(ValueError, match=fault):
        reg.load(spark, written(tmp_path, body), reg.baskets)


def test_policies(spark, tmp_path):
    days = [{"days": 1}, {"days": 7, "label": "week"}]
    load = lambda weights: reg.load(spark, written(tmp_path, {"policy_version": "1", "horizons": days, "weighting": {"weights": weights}}), reg.policies)
    assert sorted((r.horizon, r.label, r.alpha) for r in load({}).collect()) == [(1, "T+1", 0.5), (7, "week", 0.5)]
    assert sorted((r.horizon, r.alpha) for r in load({"1": 0.9, "7": 0.1}).collect()) == [(1, 0.9), (7, 0.1)]
    for weights, fault in (({"1": 1.0}, "without a weight"), ({"1": 0.9, "7": 0.3}, "sum to 1")):
        with pytest.raises(ValueError, match=fault):
            load(weights)


def test_policy_weights_are_renormalised(spark):
    cells = spark.createDataFrame([(1, 2001, 1, 1.5, 5), (1, 2001, 7, 0.5, 3), (1, 2001, 9, 7.0, 9), (1, 2001, 15, 9.0, 2), (2, 2001, 1, 1.25, 3)], "route_id int, period int, horizon int, index double, n_matched long")
    policy = spark.createDataFrame([(1, 0.6), (7, 0.2), (15, 0.2)], "horizon int, alpha double")
    got = {r.route_id: r for r in agg.route_indices_by(cells, policy).collect()}
    assert got[1]["index"] == pytest.approx((0.6 * 1.5 + 0.2 * 0.5) / 0.8) and got[1].publishable and got[1].weight_present == pytest.approx(0.8)
    assert got[2]["index"] == 1.25 and not got[2].publishable


@pytest.mark.parametrize("cut", [0, 7, 300, 640, 900])
def test_restored_fences_go_on(spark, cut):
    r = random.Random(cut)
    rows = [(i % 2, i, None if i % 37 == 0 else r.uniform(90, 110) * (r.choice([8.0, 0.05]) if i % 29 == 0 else 1)) for i in range(1300)] + [(7, i, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, at int, x double")
    fence = lambda part, state=None: cl.recursive_fence(part, ["k"], ["at"], "x", state=state)
    whole = {(x.k, x.at): (x.n_past, x.outlier) for x in fence(df).collect()}
    first = fence(df.filter(F.col("at") < cut))
    state = cl.export_fences(first, ["k"], ["at"], "x")
    second = fence(df.filter(F.col("at") >= cut), state)
    assert {(x.k, x.at): (x.n_past, x.outlier) for x in first.unionByName(second).collect()} == whole
    told = lambda s: {x.k: (list(x.held), x.withheld) for x in s.collect()}
    end = told(cl.export_fences(second, ["k"], ["at"], "x", state))
    assert end == told(cl.export_fences(fence(df), ["k"], ["at"], "x")) and max(len(h) for h, _ in end.values()) == cl.FENCE_WINDOW
    seen = cl.diagnostics(cl.export_fences(fence(df), ["k"], ["at"], "x")).first()
    assert (seen.n_keys, seen.n_ready, seen.n_withheld) == (3, 2, sum(o for _, o in whole.values())) and seen.n_withheld > 0


def test_state_of_another_version_is_left_out(spark):
    df = spark.createDataFrame([(1, i, 10.0 + i % 3) for i in range(20)], "k int, at int, x double")
    state = cl.export_fences(cl.recursive_fence(df, ["k"], ["at"], "x"), ["k"], ["at"], "x").withColumn("version", F.lit(cl.STATE_VERSION - 1))
    got = cl.recursive_fence(df, ["k"], ["at"], "x", state=state).agg(F.max("n_past").alias("n")).first()
    assert got.n == 19
    assert cl.diagnostics(state.limit(0)).first().asDict() == {"n_keys": 0, "n_ready": 0, "n_withheld": 0}


def test_reference_days(spark):
    m = spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(i), float(i)) for k in (1, 2) for i in range(40 * k)], "k int, day date, median double")
    got = cl.newest_days(m, ["k"], "day", 50).groupBy("k").agg(F.count("*").alias("n"), F.min("median").alias("least")).collect()
    assert {r.k: (r.n, r.least) for r in got} == {1: (40, 0.0), 2: (50, 30.0)}


def test_reviews(spark):
    o = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id int, is_valid boolean")
    r = spark.createDataFrame([(1, "error", 1), (1, "genuine", 2), (2, "genuine", 1), (2, "error", 2), (3, "error", 1)], "id int, verdict string, reviewed_at int")
    assert [(x.id, x.revision) for x in store.review_revisions(o, r, "id").collect()] == [(2, "anomaly_review")]
    assert sorted(x.id for x in store.with_reviews(o, r, "id").filter("is_valid").collect()) == [1, 4]


def test_late_rows_replace_their_days_only(spark, tmp_path):
    schema, path, log = "day int, x double", f"file://{tmp_path}/t", f"file://{tmp_path}/log"
    level = lambda df: df.groupBy("day").agg(F.avg("x").alias("level"))
    rows, late = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], schema), spark.createDataFrame([(1, 9.0), (3, 1.0)], schema)
    store.publish(level(rows), path, log, ["day"], "level", "day")
    for _ in range(2):
        store.publish(store.recomputed(rows, late, "day", level), path, log, ["day"], "level", "day", why="late_data")
    assert sorted((r.day, r.level) for r in spark.read.parquet(path).collect()) == [(1, 5.0), (2, 5.0), (3, 1.0)]
    assert sorted((r.day, r.kind) for r in spark.read.parquet(log).collect()) == [(1, "initial_publication"), (1, "late_data"), (2, "initial_publication"), (3, "initial_publication")]


def test_sources_stay_known(spark):
    told = lambda *rows: spark.createDataFrame(rows, "name string, enabled boolean, at int")
    got = store.register(store.register(None, told(("a", True, 1), ("b", True, 1)), "name", "at"), told(("b", False, 5), ("c", None, 5)), "name", "at")
    assert sorted(tuple(r) for r in got.select("name", "enabled", "first_seen", "last_updated").collect()) == [("a", True, 1, 1), ("b", False, 1, 5), ("c", None, 5, 5)]


@pytest.mark.parametrize(
    ("mode", "rows", "status"),
    [
        ("live", [("SUCCESS", 4)], "SUCCESS"), ("live", [("SUCCESS", 4), ("FAILED", 0)], "PARTIAL"), ("live", [("UNAVAILABLE", 0)] * 2, "UNAVAILABLE"), ("live", [("UNAVAILABLE", 0), ("FAILED", 0)], "FAILED"),
        ("live", [("SUCCESS", 0)], "FAILED"), ("offline", [("UNAVAILABLE", 0)], "FAILED"), ("offline", [("FAILED", 0), ("SUCCESS", 1)], "OFFLINE"), ("simulated", [("SUCCESS", None), ("SUCCESS", 2)], "SIMULATED"),
    ],
)
def test_run_status(spark, mode, rows, status):
    df = spark.createDataFrame([(1, mode, s, n, None) for s, n in rows], "run int, mode string, status string, n_rows int, error string")
    assert gov.run_status(df, ["run"]).first().status == status


def test_base_window(spark):
    q = spark.createDataFrame([(dt.date(2024, m, 1), m) for m in range(1, 7)], "day date, period int")
    assert sorted(r.period for r in el.base_window(q, "2024-02-01", "2024-03-01").collect()) == [0, 0, 4, 5, 6]


def test_redaction(spark):
    df = spark.createDataFrame([("https://x.in/?Auth=1&b=2&SESSIONID=3#f", 'BEARER a.b/c~== ok "access_token":"t"', {"COOKIE": "c", "Host": "h"}), (None, None, None)], "url string, text string, headers map<string, string>")
    got = df.select(fn.redact_url(F.col("url")).alias("u"), fn.redact_text(F.col("text")).alias("t"), fn.redact_headers(F.col("headers")).alias("h")).collect()
    assert tuple(got[0]) == ("https://x.in/?Auth=[REDACTED]&b=2&SESSIONID=[REDACTED]#f", 'Bearer [REDACTED] ok "access_token":"[REDACTED]"', {"COOKIE": "[REDACTED]", "Host": "h"})
    assert tuple(got[1]) == (None, None, None)


@pytest.mark.parametrize(
    ("parse", "body", "expected"),
    [
        (reg.official, {"monthly_benchmarks": [{"month": "2026-01", "airfare_item_index": 1, "transport_index": 2, "cpi_combined": 3}]}, ("2026-01", 1.0, 2.0, 3.0, None, "FINAL", None)),
        (reg.official, {"monthly_benchmarks": [{"month": "2026-13", "airfare_item_index": 1, "transport_index": 2, "cpi_combined": 3}]}, (*[None] * 6, "month missing or malformed")),
        (reg.official, {"monthly_benchmarks": [{"month": "2026-01", "airfare_item_index": 1, "transport_index": 2, "cpi_combined": 3}] * 2}, (*[None] * 6, "duplicate month")),
        (reg.official, {"monthly_benchmarks": [{"month": "2026-01", "airfare_item_index": 0, "transport_index": 2, "cpi_combined": 3}]}, (*[None] * 6, "airfare_item_index missing or not positive")),
        (reg.official, {"months": []}, (*[None] * 6, "no points")),
        (reg.official, "{cut", (*[None] * 6, "not a JSON series")),
        (reg.benchmark, {"daily_benchmarks": [{"date": "2026-01-05", "dgca_benchmark_index": 101.5}]}, (dt.date(2026, 1, 5), 101.5, 4.5, None)),
        (reg.benchmark, {"daily_benchmarks": [{"date": "5 Jan", "dgca_benchmark_index": 101.5}]}, (None, None, None, "date missing or malformed")),
    ],
)
def test_series_documents(spark, parse, body, expected):
    text = body if isinstance(body, str) else json.dumps(body)
    assert [tuple(x) for x in parse(spark.createDataFrame([(text,)], "text string"), "text").collect()] == [expected]


def test_error_details(spark):
    bodies = {'{"errors": [{"title": "T", "detail": "d"}, {"title": "U"}]}': "T: d", '{"errors": [{"detail": "only"}]}': "only", '{"errors": [{"title": "T:"}]}': "T", '{"errors": [{}]}': "(unspecified error)", "[]": "(unspecified error)", "<p>": "(no parseable error body)"}
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert {x.b: x.t for x in df.select("b", fn.error_detail(F.col("b")).alias("t")).collect()} == bodies
