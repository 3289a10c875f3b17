"""Late data as a stream: what is recomputed, replaced and logged, once for each batch."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import late

SCHEMA = "month date, route_id int, day date, fare double"


def rows(spark, *told):
    made = [(dt.date(2026, m, 1), r, dt.date(2026, m, d), float(f)) for m, r, d, f in told]
    return spark.createDataFrame(made, SCHEMA)


def means(df):
    return df.groupBy("month", "route_id", "day").agg(F.round(F.avg("fare"), 6).alias("level"))


def told(stream):
    log = sorted((int(x.batch), x.route_id, x.day.isoformat(), x.previous, x.new, x.kind) for x in stream.log().collect())
    return log, sorted((x.route_id, x.day.isoformat(), x.level) for x in stream.figures().collect())


def test_late_rows_replace_their_months_only_and_once(spark):
    stream = late.LateStream(spark, SCHEMA, "month", ["month", "route_id", "day"], "level", means)
    stream.add(rows(spark, (1, 1, 5, 100), (1, 2, 5, 50), (2, 1, 3, 10)))
    stream.run()
    of_february = lambda: {x for x in stream.figures().inputFiles() if "month=2026-02-01" in x}
    files = of_february()
    late_rows = rows(spark, (1, 1, 5, 300), (1, 1, 6, 70), (1, 2, 5, 50))
    stream.add(late_rows)
    stream.run()
    first = told(stream)
    assert first == (
        [
            (0, 1, "2026-01-05", None, 100.0, "initial_publication"), (0, 1, "2026-02-03", None, 10.0, "initial_publication"), (0, 2, "2026-01-05", None, 50.0, "initial_publication"),
            (1, 1, "2026-01-05", 100.0, 200.0, "late_data"), (1, 1, "2026-01-06", None, 70.0, "initial_publication"),
        ],
        [(1, "2026-01-05", 200.0), (1, "2026-01-06", 70.0), (1, "2026-02-03", 10.0), (2, "2026-01-05", 50.0)],
    )
    assert of_february() == files  # untouched
    stream.step(late_rows, 1)  # the batch runs again
    assert told(stream) == first


def test_a_step_that_failed_before_it_replaced_figures(spark, monkeypatch):
    stream = late.LateStream(spark, SCHEMA, "month", ["month", "route_id", "day"], "level", means)
    stream.step(rows(spark, (1, 1, 5, 100)), 0)
    real, calls = late.replace_partitions, []

    def failing(df, path, keys):
        calls.append(path)
        if path.endswith("figures"):
            raise RuntimeError("lost")
        real(df, path, keys)

    monkeypatch.setattr(late, "replace_partitions", failing)
    try:
        stream.step(rows(spark, (1, 1, 5, 200)), 1)
    except RuntimeError:
        pass
    monkeypatch.setattr(late, "replace_partitions", real)
    assert [x[2] for x in told(stream)[1]] == [100.0]
    stream.step(rows(spark, (1, 1, 5, 200)), 1)
    log, figures = told(stream)
    assert log[1:] == [(1, 1, "2026-01-05", 100.0, 150.0, "late_data")] and figures == [(1, "2026-01-05", 150.0)]


def test_an_empty_batch(spark):
    stream = late.LateStream(spark, SCHEMA, "month", ["month", "route_id", "day"], "level", means)
    stream.step(rows(spark, (1, 1, 5, 100)), 0)
    stream.step(rows(spark, (1, 1, 5, 100)).limit(0), 1)
    assert len(told(stream)[0]) == 1 and stream.figures().count() == 1
