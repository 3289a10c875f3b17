"""Source resolution, labels and gates over registries made from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import governance as gov
from tidemark.sources.tables import read


def source_resolve(spark, d):
    n = read(spark, d, "nation")
    capabilities = n.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "live").otherwise("simulated").alias("source_type"), (F.col("n_regionkey") != 2).alias("enabled"))
    return gov.resolve(n.select(F.concat(F.lit(" "), F.upper("n_name")).alias("name")), capabilities, "live")


def provenance_labels(spark, d):
    e = read(spark, d, "events")
    kind = F.element_at(F.array(F.lit("live"), F.lit("simulated"), F.lit("offline"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    method = F.element_at(F.array(F.lit("api"), F.lit(None), F.lit("simulated")), (F.col("event_id") % 3 + 1).cast("int"))
    found, fits = gov.acquisition(kind, method)
    return e.select("event_id", found.alias("method"), fits.alias("allowed"), gov.label(kind, method, F.col("event_id") % 7 == 0).alias("label"))


def source_gates(spark, d):
    s = read(spark, d, "supplier")
    key = F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("APPROVED", "PENDING_FORMAL_REVIEW", "PENDING", "APPROVED", "NON_EMPIRICAL")]), (key % 5 + 1).cast("int"))
    paths = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("/a"), F.lit("/b")))
    path = F.concat(F.lit("/"), F.substring(F.lit("abc"), (key % 3 + 1).cast("int"), F.lit(1)))
    gate = gov.gates(status, paths, path, key % 7, F.when(key % 11 != 0, "mail"), F.date_add(F.lit("2024-01-01"), (key % 13).cast("int")), F.to_date(F.lit("2024-01-05")), True)
    return s.select("s_suppkey", gate.alias("failed_gate"), gate.isNull().alias("permitted"))


QUERIES = {f.__name__: f for f in (source_resolve, provenance_labels, source_gates)}
ORACLE = {
    "source_resolve": """SELECT lower(n_name) AS name, CASE WHEN n_nationkey >= 20 THEN 'unknown_source' WHEN n_nationkey % 2 = 1 THEN 'mode_mismatch' WHEN n_regionkey = 2 THEN 'source_disabled' ELSE 'usable' END AS outcome FROM nation""",
    "provenance_labels": """WITH e AS (SELECT event_id, ['live', 'simulated', 'offline', NULL][event_id % 4 + 1] AS kind, ['api', NULL, 'simulated'][event_id % 3 + 1] AS method FROM events),
  m AS (SELECT *, CASE kind WHEN 'live' THEN 'web_scrape' WHEN 'simulated' THEN 'simulated' WHEN 'offline' THEN 'offline_fixture' END AS own FROM e)
  SELECT event_id, coalesce(method, own) AS method, coalesce(CASE WHEN kind = 'live' THEN coalesce(method, own) IN ('web_scrape', 'api') ELSE coalesce(method, own) = own END, false) AS allowed,
    CASE WHEN event_id % 7 = 0 OR kind IS NULL THEN 'SOURCE UNAVAILABLE' ELSE upper(replace(coalesce(method, kind), '_', ' ')) END AS label FROM m""",
    "source_gates": """WITH s AS (SELECT s_suppkey AS k, ['APPROVED', 'PENDING_FORMAL_REVIEW', 'PENDING', 'APPROVED', 'NON_EMPIRICAL'][s_suppkey % 5 + 1] AS status FROM supplier),
  g AS (SELECT k, CASE WHEN status IN ('PENDING', 'NON_EMPIRICAL') OR (status = 'PENDING_FORMAL_REVIEW' AND (k % 7 <= 0 OR k % 3 = 0)) THEN 1
    WHEN k % 3 = 2 THEN 2 WHEN k % 7 <= 0 OR k % 11 = 0 THEN 4 WHEN k % 13 < 4 THEN 8 END AS failed_gate FROM s)
  SELECT k AS s_suppkey, failed_gate, failed_gate IS NULL AS permitted FROM g""",
}
