"""Streaming queries over the events table, and SQL for those whose result a batch can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import cleaning
from tidemark.sources.store import settle
from tidemark.sources.tables import QUOTES_SQL, read
from tidemark.streaming import events as ev
from tidemark.streaming import late as lt
from tidemark.streaming import validator as vd


def local_start(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_tumbling(spark, d):
    return local_start(ev.drain(ev.tumbling(ev.source(spark, d)), "tumbling", ["start", "event_type"]))


def stream_sliding(spark, d):
    return local_start(ev.drain(ev.sliding(ev.source(spark, d)), "sliding", ["start", "event_type"]))


def stream_sessions(spark, d):
    """Sessions that are over: none can grow that ended two days before the latest event."""
    return local_start(ev.drain(ev.sessions(ev.source(spark, d)), "sessions"))


def stream_fence(spark, d):
    return ev.fenced(ev.source(spark, d))


def waves(spark, d):
    """Quotes in the four files that they come in: by day, each 17th order one file late, each 41st in the last one."""
    due = F.when(F.col("day") < "1994-01-01", 0).when(F.col("day") < "1996-01-01", 1).when(F.col("day") < "1998-01-01", 2).otherwise(3)
    late = F.when(F.col("order_id") % 41 == 0, 3).when(F.col("order_id") % 17 == 0, F.least(due + 1, F.lit(3))).otherwise(due)
    quotes = settle(cleaning.fence_quotes(spark, d).withColumn("wave", late), "waves")
    return [quotes.filter(F.col("wave") == i) for i in range(4)]


def stream_validator(spark, d):
    return vd.in_waves(vd.ValidatorStream(spark), waves(spark, d)).verdicts()


def stream_validator_restarted(spark, d):
    """Half the files, the state exported, and a new stream from it over the others: the verdicts of an unbroken run."""
    files = waves(spark, d)
    first = vd.in_waves(vd.ValidatorStream(spark), files[:2])
    second = vd.in_waves(vd.ValidatorStream(spark, state=settle(first.export(), "validator-state")), files[2:])
    return first.verdicts().unionByName(second.verdicts())


def validator_diagnostics(spark, d):
    return vd.diagnostics(vd.in_waves(vd.ValidatorStream(spark), waves(spark, d)).export())


def daily_levels(rows):
    """Geometric mean fare of each route and day, rounded so that it does not depend on the order of a sum."""
    return rows.groupBy("month", "route_id", "day").agg(F.round(F.exp(F.avg(F.ln("fare"))), 6).alias("level"))


def late_run(spark, d):
    stream = lt.LateStream(spark, "month date, route_id int, day date, fare double", "month", ["month", "route_id", "day"], "level", daily_levels)
    for file in waves(spark, d):
        stream.add(file.filter(F.col("fare").between(500, 80000)).withColumn("month", F.trunc("day", "month")))
        stream.run()
    return stream


def late_revisions(spark, d):
    """What each of the four files changed in the published levels."""
    return late_run(spark, d).log().select("batch", "route_id", "day", "previous", "new", "kind").withColumn("batch", F.col("batch").cast("int"))


def late_figures(spark, d):
    """The levels that are published in the end."""
    return late_run(spark, d).figures().select("route_id", "day", "level")


def rate_limit_recursive(spark, d):
    return ev.limited(read(spark, d, "events"), limit=3, seconds=86400)


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_fence, stream_validator, stream_validator_restarted, validator_diagnostics, late_revisions, late_figures, rate_limit_recursive)}
_WAVES = f"""WITH RECURSIVE {QUOTES_SQL}, q AS (
  SELECT route_id, horizon, day, order_id, line_no, fare * CASE WHEN order_id % 23 = 0 THEN 10.0 ELSE 1.0 END AS fare,
    CASE WHEN day < DATE '1994-01-01' THEN 0 WHEN day < DATE '1996-01-01' THEN 1 WHEN day < DATE '1998-01-01' THEN 2 ELSE 3 END AS due FROM quotes
), w AS (SELECT *, CASE WHEN order_id % 41 = 0 THEN 3 WHEN order_id % 17 = 0 THEN least(due + 1, 3) ELSE due END AS wave,
    CASE WHEN fare <= 0 THEN 'non_positive_fare' WHEN fare < 500 THEN 'below_minimum_fare' WHEN fare > 80000 THEN 'above_maximum_fare' END AS excluded FROM q
), line AS (SELECT *, row_number() OVER (PARTITION BY route_id, horizon ORDER BY wave, day, order_id, line_no, fare) AS k FROM w WHERE excluded IS NULL),
walk AS (
  SELECT 0::BIGINT AS k, route_id, horizon, false AS outlier, NULL::DOUBLE AS middle, []::DOUBLE[] AS held, []::DATE[] AS days, NULL::DATE AS prior_day FROM line WHERE k = 1
  UNION ALL
  SELECT k, route_id, horizon, outlier, middle, CASE WHEN outlier THEN held ELSE list_append(held, fare)[-500:] END,
    list_sort(list_distinct(list_append(days, day)))[-90:], list_max(list_filter(days, lambda x: x < day)) FROM (
    SELECT *, len(held) >= 10 AND (fare < q1 - 3 * (q3 - q1) OR fare > q3 + 3 * (q3 - q1)) AS outlier FROM (
      SELECT line.k, line.route_id, line.horizon, line.fare, line.day, walk.held, walk.days, list_aggregate(walk.held, 'quantile_cont', 0.5) AS middle,
        list_aggregate(walk.held, 'quantile_cont', 0.25) AS q1, list_aggregate(walk.held, 'quantile_cont', 0.75) AS q3
      FROM walk JOIN line ON line.route_id = walk.route_id AND line.horizon = walk.horizon AND line.k = walk.k + 1))
)"""
_VERDICTS = _WAVES + """, m AS (
  SELECT walk.route_id, walk.horizon, walk.k, quantile_cont(p.fare, 0.5) AS median FROM walk JOIN line p
  ON p.route_id = walk.route_id AND p.horizon = walk.horizon AND p.day = walk.prior_day AND p.k < walk.k GROUP BY ALL
), f AS (
  SELECT line.route_id, line.horizon, order_id, line_no, array_to_string(list_filter([
    CASE WHEN outlier THEN CASE WHEN fare > middle THEN 'iqr_high_outlier' ELSE 'iqr_low_outlier' END END,
    CASE WHEN 100 * abs(fare - median) / median > 300 THEN CASE WHEN fare > median THEN 'daily_change_spike' ELSE 'daily_change_collapse' END END,
    CASE WHEN line.horizon >= 30 AND fare > 25000 THEN 'suspiciously_high_advance_fare' END, CASE WHEN line.horizon = 0 AND fare < 1500 THEN 'suspiciously_low_same_day_fare' END
  ], lambda x: x IS NOT NULL), ',') AS reason
  FROM line JOIN walk USING (route_id, horizon, k) LEFT JOIN m ON m.route_id = line.route_id AND m.horizon = line.horizon AND m.k = line.k
) SELECT route_id, horizon, order_id, line_no, CASE WHEN reason = '' THEN 'accepted' ELSE 'flagged' END AS action, reason FROM f
UNION ALL SELECT route_id, horizon, order_id, line_no, 'excluded', excluded FROM w WHERE excluded IS NOT NULL"""

ORACLE = {
    "stream_validator": _VERDICTS,
    "stream_validator_restarted": _VERDICTS,
    "validator_diagnostics": _WAVES + """, keys AS (SELECT DISTINCT route_id, horizon FROM w), last AS (
  SELECT route_id, horizon, arg_max(held, k) AS held, arg_max(days, k) AS days, count(*) FILTER (WHERE outlier) AS withheld FROM walk GROUP BY ALL)
  SELECT count(*) AS n_keys, count(*) FILTER (WHERE len(held) >= 10) AS n_ready, coalesce(max(len(days)), 0)::INTEGER AS most_days, coalesce(sum(withheld), 0)::BIGINT AS n_withheld FROM keys LEFT JOIN last USING (route_id, horizon)""",
    "late_revisions": _WAVES.split(", line AS (")[0].rstrip() + """, b AS (SELECT unnest([0, 1, 2, 3]) AS batch), v AS (
  SELECT batch, route_id, day, round(exp(avg(ln(fare))), 6) AS level FROM w JOIN b ON wave <= batch WHERE excluded IS NULL GROUP BY ALL
), c AS (SELECT batch, route_id, day, level, lag(level) OVER (PARTITION BY route_id, day ORDER BY batch) AS previous FROM v)
SELECT batch, route_id, day, previous, level AS new, CASE WHEN previous IS NULL THEN 'initial_publication' ELSE 'late_data' END AS kind FROM c WHERE previous IS DISTINCT FROM level""",
    "late_figures": _WAVES.split(", line AS (")[0].rstrip() + " SELECT route_id, day, round(exp(avg(ln(fare))), 6) AS level FROM w WHERE excluded IS NULL GROUP BY ALL",
    "stream_fence": """WITH RECURSIVE line AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id, value) AS k FROM events),
  walk AS (
    SELECT 0::BIGINT AS k, event_type, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, false AS outlier, []::DOUBLE[] AS held FROM line WHERE k = 1
    UNION ALL
    SELECT k, event_type, event_id, value, outlier, CASE WHEN outlier THEN held ELSE list_append(held, value)[-500:] END FROM (
      SELECT *, len(held) >= 10 AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS outlier FROM (
        SELECT line.k, line.event_type, line.event_id, line.value, walk.held, list_aggregate(walk.held, 'quantile_cont', 0.25) AS q1, list_aggregate(walk.held, 'quantile_cont', 0.75) AS q3
        FROM walk JOIN line ON line.event_type = walk.event_type AND line.k = walk.k + 1))
  ) SELECT event_id, event_type, value, coalesce(outlier, false) AS outlier FROM walk WHERE k > 0""",
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": """SELECT start, event_type, count(*) AS n FROM (
  SELECT event_type, unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start, ts FROM events)
  WHERE ts >= start AND ts < start + INTERVAL 2 DAY GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k
  HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)""",
    "rate_limit_recursive": """WITH RECURSIVE line AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  walk AS (
    SELECT 0::BIGINT AS k, user_id, NULL::BIGINT AS event_id, false AS admitted, 0::BIGINT AS retry_after, []::BIGINT[] AS held FROM line WHERE k = 1
    UNION ALL
    SELECT k, user_id, event_id, len(near) < 3, CASE WHEN len(near) < 3 THEN 0 ELSE greatest(1, CAST(ceil((near[1] + 86400000000 - t) / 1000000) AS BIGINT)) END, CASE WHEN len(near) < 3 THEN list_append(near, t) ELSE near END FROM (
      SELECT line.k, line.user_id, line.event_id, line.t, list_filter(walk.held, lambda x: x > line.t - 86400000000) AS near FROM walk JOIN line ON line.user_id = walk.user_id AND line.k = walk.k + 1)
  ) SELECT event_id, user_id, admitted, retry_after FROM walk WHERE k > 0""",
}
