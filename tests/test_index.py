"""Axioms of the index formulas, gates of the aggregates, and the cleaning rules, on small hand-made inputs."""

import datetime as dt
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.operators import aggregates as agg
from tidemark.operators import cleaning as cl
from tidemark.operators import elementary as el
from tidemark.operators import series as sr
from tidemark.sources import pages, store


def pairs(spark, base, now):
    rows = [(1, 1, 2001, i, float(q), float(p)) for i, (p, q) in enumerate(zip(base, now))]
    return spark.createDataFrame(rows, "route_id int, horizon int, period int, product int, price double, base_price double")


def index_of(df):
    found = df.collect()
    return found[0]["index"] if found else None


def drawn(seed, n, low=700, high=9000):
    r = random.Random(seed)
    return [round(r.uniform(low, high), 2) for _ in range(n)]


@pytest.mark.parametrize("factor", [1.0, 1.27, 0.64])
def test_jevons_proportional(spark, factor):
    base = drawn(1, 6)
    assert index_of(el.jevons(pairs(spark, base, [x * factor for x in base]))) == pytest.approx(factor, abs=1e-9)


def test_jevons_geomean_and_reversal(spark):
    base, now = drawn(2, 7), drawn(3, 7)
    p = pairs(spark, base, now)
    relatives = [min(max(y / x, 0.1), 10) for x, y in zip(base, now)]
    there = index_of(el.jevons(p))
    assert there == pytest.approx(math.prod(relatives) ** (1 / 7))
    assert there * index_of(el.jevons(pairs(spark, now, base))) == pytest.approx(1)
    assert index_of(el.carli(p)) == pytest.approx(sum(y / x for x, y in zip(base, now)) / 7) and index_of(el.carli(p)) >= there
    assert index_of(el.dutot(p)) == pytest.approx(sum(now) / sum(base))


def test_least_matched_and_clip(spark):
    assert index_of(el.jevons(pairs(spark, drawn(4, 2), drawn(5, 2)))) is None
    got = el.jevons(pairs(spark, [*drawn(4, 3), 11.0], [*drawn(4, 3), 1111.0])).collect()[0]
    assert got["index"] == pytest.approx(10 ** (1 / 4)) and got["n_clipped"] == 1


def test_winsor_needs_ten(spark):
    now = [x * 1.0 for x in range(1, 10)] + [90.0]
    got = index_of(el.jevons(pairs(spark, [10.0] * 10, now)))
    rel = sorted(min(max(x / 10, 0.1), 10) for x in now)
    at = lambda p: rel[int(p * 9)] + (p * 9 - int(p * 9)) * (rel[min(int(p * 9) + 1, 9)] - rel[int(p * 9)])
    held = [min(max(x, at(0.01)), at(0.99)) for x in rel]
    assert got == pytest.approx(math.exp(sum(map(math.log, held)) / 10))


PRICES = "route_id int, horizon int, period int, product int, spec string, price double, n_quotes long"


def test_spec_fallback_and_churn(spark):
    rows = [(1, 1, 1995, i, f"s{i}", 100.0 * (i + 1), 1) for i in range(3)] + [(1, 1, 1996, 10 + i, f"s{i}", 110.0 * (i + 1), 1) for i in range(3)]
    found = el.exact_or_spec(spark.createDataFrame(rows, PRICES), 1995).collect()
    assert [(r.method, r.n_matched) for r in found] == [("spec", 3)] and found[0]["index"] == pytest.approx(1.1)
    rows = [(1, 1, 1995, i, "s", 1.0, 1) for i in range(4)] + [(1, 1, 1996, i, "s", 1.0, 1) for i in (0, 1, 2, 9)] + [(1, 1, 1997, 9, "s", 1.0, 1)]
    df = spark.createDataFrame(rows, PRICES)
    got = {r.period: r for r in el.churn(df, 1995).collect()}
    assert (got[1996].n_matched, got[1996].n_new, got[1996].n_gone) == (3, 1, 1)
    assert {r.period: r.n_reappeared for r in el.reappeared(df, 1995).collect()} == {1996: 0, 1997: 1}


CELL = "route_id int, horizon int, period int, n_matched long, `index` double"


def test_route_gates(spark):
    rows = [(1, h, 1, 5, v) for h, v in ((1, 1.2), (15, 1.0), (45, 1.1))] + [(2, 7, 1, 5, 1.0), (3, 1, 1, 2, 1.0), (3, 7, 1, 3, 1.0)]
    got = {r.route_id: r for r in agg.route_indices(spark.createDataFrame(rows, CELL)).collect()}
    assert got[1]["index"] == pytest.approx(1.1) and got[1].horizons_included == "1,15,45" and got[1].horizons_missing == "7,30"
    assert got[1].publishable and not got[2].publishable and got[3].n_horizons == 1


def test_national_coverage_and_contributions(spark):
    w = spark.createDataFrame([(1, 0.4), (2, 0.35), (3, 0.25)], "route_id int, weight double")
    routes = lambda xs: spark.createDataFrame([(i, 1, x) for i, x in xs], "route_id int, period int, `index` double")
    all_three = agg.national(routes([(1, 1.2), (2, 0.95), (3, 1.1)]), w, ["period"]).first()
    assert all_three["index"] == pytest.approx(100 * (0.48 + 0.3325 + 0.275)) and all_three.publishable and not all_three.renormalised
    two = agg.national(routes([(1, 1.1), (2, 1.1)]), w, ["period"]).first()
    assert two["index"] == pytest.approx(110) and two.coverage == pytest.approx(0.75) and two.renormalised
    assert not agg.national(routes([(3, 1.05)]), w, ["period"]).first().publishable
    parts = agg.contributions(routes([(1, 1.15), (2, 0.9), (3, 1.05)]), w).collect()
    assert sum(r.share_pct for r in parts) == pytest.approx(100)
    both = routes([(1, 1.0), (2, 1.0), (3, 1.0)]).union(spark.createDataFrame([(1, 2, 1.1), (2, 2, 0.95), (3, 2, 1.05)]))
    moved = sorted(agg.decompose_change(agg.contributions(both, w)).collect(), key=lambda r: r["rank"])
    assert [(r.route_id, round(r.change_points, 6)) for r in moved] == [(1, 4.0), (2, -1.75), (3, 1.25)]


def test_uncertainty(spark):
    got = el.with_uncertainty(el.jevons(pairs(spark, [100.0] * 4, [110.0, 120.0, 90.0, 100.0]))).first()
    logs = [math.log(x) for x in (1.1, 1.2, 0.9, 1.0)]
    mean = sum(logs) / 4
    se = math.sqrt(sum((x - mean) ** 2 for x in logs) / 3) / 2
    assert got.se == pytest.approx(math.exp(mean) * se) and got.ci_high == pytest.approx(math.exp(mean + 3.182 * se))


def series(spark, rows):
    return spark.createDataFrame([("x", dt.date.fromisoformat(d), v) for d, v in rows], "k string, day date, value double")


def test_nearest_and_changes(spark):
    s = series(spark, [("2026-03-31", 110.0), ("2026-02-26", 100.0), ("2026-03-01", 90.0), ("2024-02-29", 5.0), ("2024-03-31", 6.0)])
    got = {r.day.isoformat(): r for r in sr.nearest(s, ["k"], 1).collect()}
    assert got["2026-03-31"].previous == 100.0  # 03-01 is another month
    assert got["2024-03-31"].previous == 5.0 and got["2026-02-26"].previous is None
    tie = series(spark, [("2026-09-10", 1.0), ("2026-08-08", 2.0), ("2026-08-12", 3.0)])
    assert {r.day.isoformat(): r.previous for r in sr.nearest(tie, ["k"], 1).collect()}["2026-09-10"] == 2.0
    pct, status = sr.period_change(F.lit(110.0), F.col("p"))
    rows = spark.createDataFrame([(None,), (100.0,), (0.0,)], "p double").select(pct, status).collect()
    assert [r[1] for r in rows] == ["insufficient_history", "available", "invalid_comparison_base"] and rows[1][0] == pytest.approx(10)


def test_rebase(spark):
    s = series(spark, [("2026-08-01", 100.0), ("2026-08-02", 110.0), ("2026-08-03", 120.0)]).drop("k")
    got = [r.rebased for r in sr.rebase(s, "2026-08-02", "2026-08-02").orderBy("day").collect()]
    assert got == pytest.approx([100 / 1.1, 100, 120 / 1.1])
    assert [r.rebased for r in sr.rebase(s, "2020-01-01", "2020-12-31").orderBy("day").collect()] == [100, 110, 120]


def test_elasticity(spark):
    r = random.Random(9)
    bowl = lambda x: math.exp(9.2 - 0.05 * x + 0.0006 * x * x)
    rows = [(x, bowl(x) * math.exp(r.gauss(0, 0.01))) for x in (2, 5, 9, 14, 20, 33, 41, 52) for _ in range(3)]
    df = spark.createDataFrame(rows, "d int, f double")
    fit = sr.quadratic_fit(df, "d", "f", [], 3).first()
    assert fit.r2 > 0.99 and fit.b1 == pytest.approx(-0.05, abs=0.004) and fit.b2 == pytest.approx(0.0006, abs=1e-4) and fit.n == 24
    assert fit.best_x == pytest.approx(-fit.b1 / (2 * fit.b2))
    got = sr.curve(sr.quadratic_fit(df, "d", "f", [], 3), [3, 40]).orderBy("x").collect()
    assert [x.predicted for x in got] == pytest.approx([bowl(3), bowl(40)], rel=0.03) and got[0].slope_pct < 0 < got[1].slope_pct + 1
    assert sr.quadratic_fit(spark.createDataFrame([(1, 5.0)] * 4, "d int, f double"), "d", "f", [], 3).count() == 0


def test_order_statistics(spark):
    r = random.Random(10)
    rows = [(k, r.choice([round(r.uniform(-5, 9), 1), 3.25])) for k in [*"aaab" * 60, "c", "d", "d"]] + [("a", None), (None, 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    by = {k: sorted(v for x, v in rows if x == k and v is not None) for k in {x for x, _ in rows}}
    found = {x.k: x for x in sr.medians(df.filter("k is not null"), ["k"], "v").collect()}
    assert {k: (x.n, x.median) for k, x in found.items()} == {k: (len(v), pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)) for k, v in by.items() if k}
    whole = sorted(v for _, v in rows if v is not None)
    got = sr.order_statistics(df, [], "v", {"upper": lambda n: F.floor(n / 2), "least": lambda n: F.lit(0)}).first()
    assert (got.n, got.upper, got.least) == (len(whole), whole[len(whole) // 2], whole[0])
    assert sr.medians(df.limit(0), [], "v").first().n is None and sr.medians(df.limit(0), ["k"], "v").count() == 0


def test_rules_and_bands(spark):
    rows = [(5000.0, 2000.0, 3000.0, 7), (1200.0, 1000.0, 200.0, 0), (5500.0, 4400.0, 1100.0, 7), (26000.0, 22000.0, 4000.0, 30)]
    df = spark.createDataFrame(rows, "fare double, base double, taxes double, h int")
    got = [r[0] for r in df.select(cl.rule_flags(F.col("fare"), F.col("base"), F.col("taxes"), F.col("h"), F.lit(False))).collect()]
    assert got == [["high_tax_ratio"], ["suspiciously_low_same_day_fare"], [], ["suspiciously_high_advance_fare"]]
    texts = ["12:30 AM", "5:59", "06:00 am", "11:59", "12:00 PM", "17:59", "6:00 PM", "25:00", None, "", "invalid"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.time_band(F.col("t"))).collect()]
    assert got == [*[fn.BANDS[i] for i in (0, 0, 1, 1, 2, 2, 3, 3)], "UNSPECIFIED", "UNSPECIFIED", "UNSPECIFIED"]
    parts = spark.createDataFrame([(5956.0,), (700.0,)], "t double").select("t", *[c.alias(n) for n, c in fn.unbundle(F.col("t"), F.lit("DEL")).items()]).collect()
    assert all(r.base_fare + r.taxes + r.airport_fee + r.convenience == pytest.approx(r.t, abs=1e-4) for r in parts)


@pytest.mark.parametrize("keep", [False, True])
def test_fence_agrees_with_sorting(spark, keep):
    import numpy as np

    r = random.Random(1)
    values = [r.gauss(100, 5) if r.random() < 0.95 else r.uniform(0, 400) for _ in range(700)]
    clean, expected = [], []
    for x in values:
        past = clean[-500:]
        q1, q3 = np.percentile(past, [25, 75]) if len(past) >= 10 else (0, 0)
        out = len(past) >= 10 and (x < q1 - 3 * (q3 - q1) or x > q3 + 3 * (q3 - q1))
        expected.append(bool(out))
        if keep or not out:
            clean.append(x)
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("k", 3, None)], "k string, i int, v double")
    got = {x.i: x.outlier for x in cl.recursive_fence(df, ["k"], ["i"], "v", keep).collect() if x.v is not None}
    assert [got[i] for i in range(700)] == expected and cl.recursive_fence(df, ["k"], ["i"], "v").filter("v is null and not outlier").count() == 1


def test_cards_and_pages(spark):
    texts = ["7:05\u202fAM – 9:50\u202fAM\nIndiGo\n2 hr\nNonstop\n₹\u00a05,130", "IndiGo 7:05 AM ₹4,700 nonstop", "Air India Express\n1 stop\n₹6,240", "Nobody ₹5,000", "IndiGo no price", "SpiceJet ₹90", "Vistara\u00a01:15\u00a0PM ₹8,080", None]
    df = spark.createDataFrame([(i, t, "DEL", "BOM") for i, t in enumerate(texts)], "i int, t string, o string, d string")
    got = sorted((r.carrier, r.fare, r.stops, r.dep_time, r.band) for r in pages.cards(df, "t", "o", "d", "i").collect())
    assert got == [("6E", 5130.0, 0, "7:05 AM", "06:00-11:59"), ("AI", 8080.0, 1, "1:15 PM", "12:00-17:59"), ("IX", 6240.0, 1, None, "UNSPECIFIED")]  # the first of equal flights stays
    found = pages.result_pages(spark.createDataFrame([(1, None), (1, None)], "i int, h string"), "h").collect()
    assert [(r.state, r.quotes) for r in found] == [("NO_RESULTS", [])] * 2


def test_publication_logs_what_vanishes_and_reviews_are_applied(spark, tmp_path):
    at, log = f"file://{tmp_path}/i", f"file://{tmp_path}/l"
    df = lambda rows: spark.createDataFrame(rows, "year int, horizon int, value double")
    store.publish(df([(2020, 1, 5.0), (2020, 7, 6.0), (2021, 1, 7.0)]), at, log, ["year", "horizon"], "value", "year")
    for _ in range(2):
        store.publish(df([(2020, 1, 5.5)]), at, log, ["year", "horizon"], "value", "year")
    got = sorted((r.year, r.horizon, r.previous, r.new, r.kind) for r in spark.read.parquet(log).collect() if r.kind != "initial_publication")
    assert got == [(2020, 1, 5.0, 5.5, "recomputation"), (2020, 7, 6.0, None, "withdrawal")]
    assert sorted((r.year, r.value) for r in spark.read.parquet(at).collect()) == [(2020, 5.5), (2021, 7.0)]
    seen = spark.createDataFrame([(i, True) for i in range(4)], "id int, is_valid boolean")
    reviews = spark.createDataFrame([(1, "error", 1), (1, "fine", 2), (2, "fine", 1), (2, "error", 3)], "id int, verdict string, reviewed_at int")
    assert [r.is_valid for r in store.with_reviews(seen, reviews, "id").orderBy("id").collect()] == [True, True, False, True]


def test_runs_captures_and_upserts(spark, tmp_path):
    judged = spark.createDataFrame([(1, 1, 900.0, None, []), (2, 1, 950.0, None, ["odd", "high"]), (3, 1, 1.0, "below_minimum_fare", [])], "order_id long, line_no int, fare double, excluded string, flags array<string>")
    for run in ("a", "b", "a"):
        store.persist_run(judged, f"file://{tmp_path}/run", run)
    count = lambda name: spark.read.parquet(f"file://{tmp_path}/run/{name}").filter("run_id = 'a'").count()
    assert [count(x) for x in ("observations", "validation", "normalized", "anomalies")] == [3, 3, 2, 2]
    web = spark.createDataFrame([("http://a.in/?token=x", "one"), ("http://a.in/?token=y", "one"), ("http://b.in/", "two")], "u string, h string")
    for _ in range(2):
        store.store_captures(web, f"file://{tmp_path}/c", F.col("u"), "h")
    got = spark.read.parquet(f"file://{tmp_path}/c").collect()
    assert len(got) == 2 and not any("token=x" in r.url or "token=y" in r.url for r in got)
    source = lambda rows: spark.createDataFrame(rows, "name string, status string, at int")
    source([("s1", "old", 1), ("s2", "old", 1)]).write.parquet(f"file://{tmp_path}/s")
    assert sorted(map(tuple, store.upsert(source([("s2", "new", 2), ("s3", "new", 2)]), f"file://{tmp_path}/s", "name", "at").collect())) == [("s1", "old", 1), ("s2", "new", 2), ("s3", "new", 2)]
    ids = spark.range(1).select(fn.dynamic_route_id(F.lit("DEL"), F.lit("BOM")).alias("a")).first()
    assert ids.a == 1000 + zlib.crc32(b"DEL-BOM") % 900_000


def test_store_is_idempotent(spark, tmp_path):
    at, log = f"file://{tmp_path}/index", f"file://{tmp_path}/log"
    df = lambda v: spark.createDataFrame([(2020, None, v), (2021, 7, 50.0)], "year int, horizon int, value double")
    for value in (100.0, 100.0, 101.0):
        store.publish(df(value), at, log, ["year", "horizon"], "value", "year")
    got = sorted((r.new, r.kind) for r in spark.read.parquet(log).collect() if r.year == 2020)
    assert got == [(100.0, "initial_publication"), (101.0, "recomputation")]
    assert spark.read.parquet(log).count() == 3 and spark.read.parquet(at).count() == 2
    for _ in range(2):
        store.snapshot_once(spark.createDataFrame([("v1", 1)], "version string, x int"), f"file://{tmp_path}/w", "version")
    assert spark.read.parquet(f"file://{tmp_path}/w").count() == 1
