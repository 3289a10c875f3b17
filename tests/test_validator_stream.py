"""The validator as a stream: bounded state, late files, restarts from exported state; and the guard of an index."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import cleaning as cl
from tidemark.operators import governance as gov
from tidemark.streaming import validator as vd

DAY = dt.date(2026, 1, 1)


def plain(files):
    """Verdicts by the same rules, one quote after the other."""
    held, days, out = {}, {}, []
    for file in files:
        for route, horizon, day, order, line, fare in sorted(file, key=lambda x: (x[2], x[3], x[4])):
            excluded = "non_positive_fare" if fare is None or fare <= 0 else "below_minimum_fare" if fare < 500 else "above_maximum_fare" if fare > 80000 else None
            if excluded:
                out.append((route, horizon, order, line, "excluded", excluded))
                continue
            clean, seen, flags = held.setdefault((route, horizon), []), days.setdefault((route, horizon), {}), []
            at = lambda p, s: s[int(p * (len(s) - 1))] + (p * (len(s) - 1) % 1) * (s[min(int(p * (len(s) - 1)) + 1, len(s) - 1)] - s[int(p * (len(s) - 1))])
            s = sorted(clean)
            wide = 3 * (at(0.75, s) - at(0.25, s)) if len(s) >= 10 else None
            odd = wide is not None and not at(0.25, s) - wide <= fare <= at(0.75, s) + wide
            if odd:
                flags.append("iqr_high_outlier" if fare > at(0.5, s) else "iqr_low_outlier")
            prior = max((x for x in seen if x < day), default=None)
            if prior:
                was = at(0.5, sorted(seen[prior]))
                if abs(fare - was) / was > 3:
                    flags.append("daily_change_spike" if fare > was else "daily_change_collapse")
            if horizon >= 30 and fare > 25000:
                flags.append("suspiciously_high_advance_fare")
            if not odd:
                held[route, horizon] = (clean + [fare])[-cl.FENCE_WINDOW :]
            seen.setdefault(day, []).append(fare)
            for stale in sorted(seen)[: -cl.DAYS_KEPT]:
                del seen[stale]
            out.append((route, horizon, order, line, "flagged" if flags else "accepted", ",".join(flags)))
    return out


def quotes(n_files=4, per=260, seed=9):
    r, files, order = random.Random(seed), [], 0
    for f in range(n_files):
        rows = []
        for _ in range(per):
            order += 1
            late = f * 40 + r.randint(0, 39) - (r.random() < 0.1) * r.randint(30, 120)
            fare = r.choice([None, -5.0, 499.0, 90000.0]) if r.random() < 0.04 else round(r.gauss(4000, 300) * r.choice([1] * 20 + [7, 0.2]), 2)
            rows.append((r.choice([1, 1, 1, 2]), r.choice([7, 30]), DAY + dt.timedelta(days=max(0, late)), order, 1, fare))
        files.append(rows)
    return files


def frames(spark, files):
    return [spark.createDataFrame(x, vd.INPUT) for x in files]


def test_verdicts_restart_and_work(spark):
    files = quotes()
    expected = sorted(plain(files))
    assert len({x[5] for x in expected}) >= 6
    stream = vd.in_waves(vd.ValidatorStream(spark), frames(spark, files))
    assert sorted(map(tuple, stream.verdicts().collect())) == expected
    state = stream.export().collect()
    assert max(len(x.days) for x in state) <= cl.DAYS_KEPT and {x.version for x in state} == {cl.STATE_VERSION}
    assert sum(x.withheld for x in state) == sum("iqr" in x[5] for x in expected)
    assert vd.diagnostics(stream.export()).first().n_keys == 4
    # the same from state exported half way, on an empty checkpoint
    first = vd.in_waves(vd.ValidatorStream(spark), frames(spark, files[:2]))
    kept = spark.createDataFrame(first.export().collect(), first.export().schema)
    second = vd.in_waves(vd.ValidatorStream(spark, state=kept), frames(spark, files[2:]))
    assert sorted(map(tuple, first.verdicts().unionByName(second.verdicts()).collect())) == expected
    # state of another version is left out: the fences start empty
    fresh = vd.in_waves(vd.ValidatorStream(spark, state=kept.withColumn("version", F.lit(1))), frames(spark, files[2:]))
    assert sorted(map(tuple, fresh.verdicts().collect())) == sorted(plain(files[2:]))


def test_a_later_batch_reads_no_more_than_an_early_one(spark):
    files = [[(1, 7, DAY + dt.timedelta(days=i), i * 100 + k, 1, 1000.0 + k) for k in range(20)] for i in range(5)]
    stream, read = vd.ValidatorStream(spark), []
    for file in frames(spark, files):
        stream.add(file)
        read.append(stream.run())
    assert read == [20] * 5 and stream.run() == 0
    assert stream.verdicts().count() == 100
    assert [len(x.clean) for x in stream.export().collect()] == [100]


def test_odd_rows(spark):
    stream = vd.ValidatorStream(spark)
    assert stream.verdicts().count() == 0
    vd.in_waves(stream, frames(spark, [[(None, 7, DAY, 1, 1, 900.0), (1, None, None, 2, 1, 900.0), (1, 7, None, 3, 1, None), (1, 7, DAY, 4, 1, float("nan"))], []]))
    assert sorted((x.order_id, x.action) for x in stream.verdicts().collect()) == [(1, "accepted"), (2, "accepted"), (3, "excluded"), (4, "excluded")]


def test_index_guard(spark):
    of = lambda rows: gov.index_guard(spark.createDataFrame(rows, "period int, source_type string, method string"), 1995)
    told = lambda rows: tuple(of(rows).first())
    assert told([(1995, "live", "api"), (1996, "live", "api"), (1990, "simulated", "x")]) == ("live", "api", None)
    assert told([(1995, "live", "api")] * 9 + [(1995, "simulated", "api"), (1996, "live", "api")]) == ("live,simulated", "api", "mixed_provenance")
    assert told([(1995, "live", "api"), (1996, "live", "web_scrape")]) == ("live", "api,web_scrape", "MIXED_ACQUISITION_METHODS")
    assert told([(1996, "live", "api"), (1996, "simulated", "api")])[2] == "no_base_period_data"
    assert told([]) == ("", "", None)
    figures = spark.createDataFrame([(1996, 1.1), (1997, 1.2)], "period int, index double")
    assert gov.guarded(figures, of([(1995, "live", "api")])).count() == 2
    refused = gov.guarded(figures, of([(1995, "live", "api"), (1995, "offline", "api")])).collect()
    assert [(x.period, x["index"], x.refusal) for x in refused] == [(None, None, "mixed_provenance")]
