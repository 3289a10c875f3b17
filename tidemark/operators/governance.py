"""Which sources may run, and how their rows are labelled: column rules over small registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(requested: DataFrame, capabilities: DataFrame, mode: str | None) -> DataFrame:
    """requested (name) with `outcome`: usable, or why it is skipped. capabilities: name, source_type, enabled."""
    asked = requested.select(F.lower(F.trim("name")).alias("name")).filter("name <> ''")
    known = capabilities.select(F.lower("name").alias("_name"), "source_type", "enabled")
    joined = asked.join(known, asked.name == F.col("_name"), "left")
    outcome = F.when(F.col("_name").isNull(), "unknown_source")
    if mode is not None:
        outcome = outcome.when(F.col("source_type") != mode, "mode_mismatch")
    return joined.select("name", outcome.when(~F.col("enabled"), "source_disabled").otherwise("usable").alias("outcome"))


def acquisition(source_type: Column, method: Column) -> tuple[Column, Column]:
    """The method, inferred from the type where it is missing, and whether the pair is allowed."""
    own = F.when(source_type == "simulated", "simulated").when(source_type == "offline", "offline_fixture").when(source_type == "live", "web_scrape")
    found = F.coalesce(method, own)
    fits = F.when(source_type == "live", found.isin("web_scrape", "api")).otherwise(found == own)
    return found, F.coalesce(fits, F.lit(False))


def label(source_type: Column, method: Column, failed: Column) -> Column:
    """Failure before a missing type before the method before the type."""
    return F.when(failed, "SOURCE UNAVAILABLE").when(source_type.isNull(), "SOURCE UNAVAILABLE").otherwise(F.upper(F.replace(F.coalesce(method, source_type), F.lit("_"), F.lit(" "))))


def gates(status: Column, paths: Column, path: Column, per_day: Column, contact: Column, expires: Column, now: Column, research: bool) -> Column:
    """The first gate that stops a request: 1 permission, 2 path, 4 rate and contact, 8 review; null lets it pass."""
    told, approved = F.coalesce(F.nullif(contact, F.lit("")).isNotNull(), F.lit(False)), F.size(paths) > 0
    pending = status == "PENDING_FORMAL_REVIEW"
    review = ((per_day <= 0) | ~approved) if research else F.lit(True)
    return (
        F.when(status.isin("PROHIBITED_WITHOUT_PERMISSION", "PENDING", "NON_EMPIRICAL") | (pending & review), 1)
        .when(path.isNotNull() & approved & ~F.exists(paths, lambda p: F.startswith(path, p)), 2)
        .when((per_day <= 0) | ~told, 4)
        .when(expires < now, 8)
    )


def index_guard(quotes: DataFrame, base: int, type_col: str = "source_type", method_col: str = "method") -> DataFrame:
    """One row on the quotes that an index would use, those of its base and of later periods: `source_types`, `methods` and `refusal`.

    quotes: after the scope that was asked for, so a named type or method leaves one of it. An index is refused
    without quotes in its base, and over more than one type or method: which of them would
    count is never guessed from their numbers. No quotes at all are no reason: the index is empty.
    """
    used = quotes.filter(F.col("period") >= base)
    found = used.agg(
        F.count("*").alias("_n"), F.count_if(F.col("period") == base).alias("_base"),
        *[F.array_sort(F.collect_set(c)).alias(n) for c, n in ((type_col, "source_types"), (method_col, "methods"))],
    )
    refusal = F.when((F.col("_n") > 0) & (F.col("_base") == 0), "no_base_period_data").when(F.size("source_types") > 1, "mixed_provenance").when(F.size("methods") > 1, "MIXED_ACQUISITION_METHODS")
    return found.select(F.array_join("source_types", ",").alias("source_types"), F.array_join("methods", ",").alias("methods"), refusal.alias("refusal"))


def guarded(index: DataFrame, guard: DataFrame) -> DataFrame:
    """index beside its guard's row; where that refuses, one row without figures in its place. guard is one row, so the broadcast has one."""
    passed = index.join(F.broadcast(guard.filter("refusal is null")), F.lit(True))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema]
    return passed.unionByName(guard.filter("refusal is not null").select(*nothing, *guard.columns))


def provenance_guard(df: DataFrame, by: list[str], type_col: str, method_col: str) -> DataFrame:
    """Per group: its source types and methods, and why an index must not be made of it: more than one of either."""
    found = df.groupBy(*by).agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in (type_col, method_col)])
    mixed = F.when(F.contains(type_col, F.lit(",")), "mixed_provenance").when(F.contains(method_col, F.lit(",")), "MIXED_ACQUISITION_METHODS")
    return found.withColumn("refusal", mixed)


# How sources may be acquired and what permission they may have, in the order that messages name them; those that need a budget and a contact.
METHODS = ["API", "OFFLINE_FIXTURE", "SIMULATED", "WEB_SCRAPE"]
STATUSES = ["APPROVED", "AVAILABLE_AFTER_FREE_REGISTRATION", "EXPIRED", "NON_EMPIRICAL", "PENDING", "PENDING_FORMAL_REVIEW", "PROHIBITED_WITHOUT_PERMISSION"]
LIVE_STATUSES = ["APPROVED", "AVAILABLE_AFTER_FREE_REGISTRATION"]
REGISTRY = """struct<registry_version: string, sources: array<struct<source_id: string, display_name: string, operator: string, acquisition_method: string, permission_status: string,
  maximum_requests_per_day: double, contact: string>>>"""


def registry_errors(documents: DataFrame, text_col: str) -> DataFrame:
    """A row for each fault of each registry document (JSON): documents' other columns, `at` (the source's place, null for faults of the whole) and `error`.

    A document that is no object has that fault alone; one without sources has no faults of sources. A row of the
    registry is one source, so a document's sources are exploded, not held. Empty texts are missing ones, as nulls are.
    """
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    named = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    keys = [c for c in documents.columns if c != text_col]
    # what is no JSON object is no dictionary
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text_col)).startswith("OBJECT"), F.lit(False))
    doc = documents.select(*keys, is_object.alias("_object"), F.from_json(text_col, REGISTRY, {"mode": "PERMISSIVE"}).alias("_doc"))
    empty = F.coalesce(F.size("_doc.sources"), F.lit(0)) <= 0
    root = F.when(~F.col("_object"), F.array(F.lit("Registry root must be a YAML dictionary"))).otherwise(
        F.array_compact(F.array(F.when(none(F.col("_doc.registry_version")), "Missing required 'registry_version'"), F.when(empty, "Registry must contain a non-empty 'sources' list")))
    )
    of_root = doc.select(*keys, F.lit(None).cast("int").alias("at"), F.explode(root).alias("error"))
    each = doc.filter("_object").select(*keys, F.posexplode("_doc.sources").alias("at", "_s"))
    s = lambda c: F.col("_s")[c]
    prefix = F.concat(F.lit("sources["), F.col("at").cast("string"), F.lit("]"))
    own = lambda *parts: F.concat(prefix, F.lit(" ("), shown(s("source_id")), F.lit("): "), *parts)
    budget = F.coalesce(s("maximum_requests_per_day"), F.lit(0.0))
    live = (budget >= 0) & F.coalesce(s("permission_status").isin(LIVE_STATUSES), F.lit(False))
    wrong = lambda c, known: F.when(~F.coalesce(s(c).isin(known), F.lit(False)), own(F.lit(f"invalid {c} '"), shown(s(c)), F.lit(f"', must be one of {named(known)}")))
    faults = F.array_compact(F.array(
        *[F.when(none(s(c)), F.concat(prefix, F.lit(f": missing '{c}'"))) for c in ("source_id", "display_name", "operator")],
        wrong("acquisition_method", METHODS), wrong("permission_status", STATUSES),
        F.when(budget < 0, own(F.lit("maximum_requests_per_day cannot be negative"))),
        F.when(live & (budget <= 0), own(F.lit("maximum_requests_per_day must be > 0"))),
        F.when(live & none(s("contact")), own(F.lit("contact information is required"))),
    ))
    return of_root.unionByName(each.select(*keys, "at", F.explode(faults).alias("error")))


def run_status(attempts: DataFrame, by: list[str]) -> DataFrame:
    """A run's status from its attempts (mode, status, n_rows): attempts, failures, rows, status and the reasons of a run without rows.

    FAILED and UNAVAILABLE attempts are failures. Only a live run with rows and no failure is a
    SUCCESS; simulated and offline runs with rows carry their own names. A live run without rows
    whose failures are all for want of the source is UNAVAILABLE, other runs without rows FAILED.
    """
    failed = F.col("status").isin("FAILED", "UNAVAILABLE")
    got = attempts.groupBy(*by, "mode").agg(
        F.count("*").alias("n_attempts"), F.count_if(failed).alias("n_failures"), F.count_if(F.col("status") == "UNAVAILABLE").alias("_absent"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set(F.when(failed, F.coalesce("error", F.lit("unknown"))))), ",").alias("_reasons"),
    )
    live, none = F.col("mode") == "live", F.col("n_rows") == 0
    status = F.when(none & live & (F.col("n_failures") > 0) & (F.col("_absent") == F.col("n_failures")), "UNAVAILABLE").when(none, "FAILED")
    status = status.when(~live, F.upper("mode")).when(F.col("n_failures") > 0, "PARTIAL").otherwise("SUCCESS")
    return got.withColumn("status", status).withColumn("reasons", F.when(none, F.col("_reasons"))).drop("_absent", "_reasons")
