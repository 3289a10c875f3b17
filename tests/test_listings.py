"""Searches, facets, registry rules, SQL functions and the limiter's waits on small inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fares as fn
from tidemark.functions import sql as sq
from tidemark.operators import governance as gov
from tidemark.operators import search as se
from tidemark.streaming import events as ev


def test_sql_functions_are_the_columns(spark):
    sq.register(spark)
    sq.register(spark)  # again
    clocks = ["8:15 AM", "12:05 am", "12:30 PM", "23:59", "5:59", "18:00", "", None, "noon", "11:59pm"]
    rows = [(c, f, a, t) for c in clocks for f, a, t in ((None, "del ", 900.0), ("flexi", "BOM", 12000.0), (" Max", None, 1386.0), ("odd", "XXX", 1.5))]
    df = spark.createDataFrame(rows, "clock string, family string, airport string, total double")
    parts = fn.unbundle(F.col("total"), F.col("airport"), 350.0)
    columns = df.select(fn.time_band(F.col("clock")), fn.canonical_tier(F.col("family")), fn.airport_fee(F.col("airport")), *parts.values())
    names = ["tariff_base", "tariff_taxes", "tariff_fee", "tariff_convenience"]
    told = spark.sql(f"SELECT time_band(clock), canonical_tier(family), airport_fee(airport), {', '.join(f'{n}(total, airport, 350D)' for n in names)} FROM {{df}}", df=df)
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(map(tuple, columns.collect()), key=repr)


AIRPORTS = [("AAA", "Ton City", "North", "Ton Field"), ("BBB", "Bay", "South", "Bay International"), ("CCC", "Cape", "North", "Cape Field")]


@pytest.fixture(scope="module")
def known(spark):
    airports = spark.createDataFrame(AIRPORTS, "code string, city string, state string, name string")
    routes = [(1, "AAA", "BBB"), (2, "BBB", "CCC"), (30, "CCC", "AAA"), (31, "AAA", "ZZZ"), (32, None, "AAA")]
    return se.with_airports(spark.createDataFrame(routes, "route_id int, origin_code string, dest_code string"), airports)


def ids(df):
    return sorted(x.route_id for x in df.collect())


def test_route_search(known):
    assert se.asked(" Bay -> Cape ") == "bay-cape" and se.asked("Bay to Cape to X") == "bay-cape to x"
    assert ids(se.route_hits(known)) == [1, 2, 30, 31, 32] and ids(se.route_hits(known, "bay->cape")) == [2] and ids(se.route_hits(known, "south -> north")) == [2]
    assert ids(se.route_hits(known, "AAA-b")) == [1] and ids(se.route_hits(known, "INTERNATIONAL")) == [1, 2] and ids(se.route_hits(known, "zzz")) == [31]
    assert ids(se.route_hits(known, "field", category="CUSTOM", dest_state="North")) == [30, 32] and ids(se.route_hits(known, "nowhere")) == []


def test_facets(known):
    got = {(x.facet, x.value): x.n for x in se.facet_counts(se.route_hits(known, "a")).collect()}
    assert got == {
        ("category", "BASKET"): 2, ("category", "CUSTOM"): 3, ("origin_state", "North"): 3, ("origin_state", "South"): 1, ("origin_state", None): 1,
        ("dest_state", "North"): 3, ("dest_state", "South"): 1, ("dest_state", None): 1, ("all", None): 5,
    }
    assert [(x.facet, x.n) for x in se.facet_counts(known.limit(0)).collect()] in ([("all", 0)], [])


def test_text_hits_and_listings(spark):
    rows = spark.createDataFrame([(1, "6E-7", None, "x"), (2, None, "Src_A", "x"), (3, "ai-9", "b", "y")], "i int, flight string, source string, kind string")
    of = lambda df: [x.i for x in df.orderBy("i").collect()]
    assert of(se.text_hits(rows, " src_a ", ["flight", "source"])) == [2] and of(se.text_hits(rows, "E-", ["flight", "source"], kind="x")) == [1] and of(se.text_hits(rows, "", ["flight"], kind="y")) == [3]
    assert [x.i for x in se.listing(rows, [F.desc("i")], 2).collect()] == [3, 2] and [x.i for x in se.listing(rows, [F.desc("i")], 5, kind="x", i=None).collect()] == [2, 1]


GOOD = '{"source_id": "a", "display_name": "A", "operator": "o", "acquisition_method": "API", "permission_status": "APPROVED", "maximum_requests_per_day": 5, "contact": "m"}'


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"registry_version": "1", "sources": [%s, %s]}' % (GOOD, GOOD), []),
        ("[1]", [(None, "Registry root must be a YAML dictionary")]), ("{cut", [(None, "Registry root must be a YAML dictionary")]), (None, [(None, "Registry root must be a YAML dictionary")]), ("5", [(None, "Registry root must be a YAML dictionary")]),
        ("{}", [(None, "Missing required 'registry_version'"), (None, "Registry must contain a non-empty 'sources' list")]),
        ('{"registry_version": "1", "sources": {}}', [(None, "Registry must contain a non-empty 'sources' list")]),
        ('{"sources": [%s]}' % GOOD, [(None, "Missing required 'registry_version'")]),
        ('{"registry_version": "1", "sources": [%s, {"source_id": "b", "display_name": "", "acquisition_method": "api", "permission_status": "APPROVED"}]}' % GOOD, [
            (1, "sources[1]: missing 'display_name'"), (1, "sources[1]: missing 'operator'"),
            (1, "sources[1] (b): invalid acquisition_method 'api', must be one of ['API', 'OFFLINE_FIXTURE', 'SIMULATED', 'WEB_SCRAPE']"),
            (1, "sources[1] (b): maximum_requests_per_day must be > 0"), (1, "sources[1] (b): contact information is required"),
        ]),
        ('{"registry_version": "1", "sources": [{"display_name": "A", "operator": "o", "acquisition_method": "API", "permission_status": "APPROVED", "maximum_requests_per_day": -1}]}', [
            (0, "sources[0]: missing 'source_id'"), (0, "sources[0] (None): maximum_requests_per_day cannot be negative"),
        ]),
        ('{"registry_version": "1", "sources": [{"source_id": "s", "display_name": "A", "operator": "o", "acquisition_method": "API", "permission_status": "PENDING"}]}', []),
    ],
)
def test_registry_rules(spark, text, expected):
    got = gov.registry_errors(spark.createDataFrame([("r", text)], "registry string, text string"), "text").collect()
    assert sorted(((x["at"], x.error) for x in got), key=repr) == sorted(expected, key=repr) and {x.registry for x in got} <= {"r"}


def test_limiter_says_when_to_come_back(spark):
    times = [0, 10, 20, 30.5, 100, 100.0, 104.2]
    rows = spark.createDataFrame([(i, 1, float(t)) for i, t in enumerate(times)], "event_id long, user_id long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t")
    of = lambda limit, seconds: [(x.admitted, x.retry_after) for x in sorted(ev.limited(rows, limit, seconds).collect(), key=lambda x: x.event_id)]
    assert of(2, 100) == [(True, 0), (True, 0), (False, 80), (False, 70), (True, 0), (False, 10), (False, 6)]
    assert of(0, 100) == of(2, 0) == [(False, 60)] * 7
