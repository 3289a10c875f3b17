"""The scalar functions of fares as SQL functions of a session, made from the same fixed tables: for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.functions.fares import AIRPORT_FEES, BANDS, DEFAULT_FEE, FLEX, GST, PREMIUM, SECURITY_FEE, STANDARD


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(xs: list[str]) -> str:
    return ", ".join(map(_text, xs))


def definitions() -> dict[str, str]:
    """Each function's name with its CREATE statement, in the order that they need each other."""
    fees = " ".join(f"WHEN {_text(k)} THEN {v}D" for k, v in AIRPORT_FEES.items())
    u = "trim(upper(coalesce(family, '')))"
    hour = "CAST(nullif(regexp_extract(upper(clock), r'(\\d{1,2}):(\\d{2})\\s*([AP]M)?', 1), '') AS INT)"
    half = "regexp_extract(upper(clock), r'(\\d{1,2}):(\\d{2})\\s*([AP]M)?', 3)"
    whole = f"total > airport_fee(origin) + {SECURITY_FEE}D + convenience + 500D"
    bodies = {
        "clock_hour(clock STRING) RETURNS INT": f"CASE WHEN {half} = 'PM' AND {hour} < 12 THEN {hour} + 12 WHEN {half} = 'AM' AND {hour} = 12 THEN 0 ELSE {hour} END",
        "time_band(clock STRING) RETURNS STRING": "CASE WHEN clock_hour(clock) IS NULL THEN 'UNSPECIFIED' " + " ".join(f"WHEN clock_hour(clock) <= {6 * i + 5} THEN {_text(b)}" for i, b in enumerate(BANDS[:-1])) + f" ELSE {_text(BANDS[-1])} END",
        "canonical_tier(family STRING) RETURNS STRING": f"CASE WHEN {u} = '' OR {u} IN ({_list(STANDARD)}) THEN 'STANDARD' WHEN {u} IN ({_list(FLEX)}) THEN 'FLEX' WHEN {u} IN ({_list(PREMIUM)}) THEN 'PREMIUM' ELSE {u} END",
        "airport_fee(origin STRING) RETURNS DOUBLE": f"CASE upper(trim(origin)) {fees} ELSE {DEFAULT_FEE}D END",
        "tariff_base(total DOUBLE, origin STRING, convenience DOUBLE DEFAULT 300D) RETURNS DOUBLE": f"CASE WHEN {whole} THEN round((total - {SECURITY_FEE}D - airport_fee(origin) - convenience) / {1 + GST}D, 2) ELSE round(total * 0.75D, 2) END",
        "tariff_taxes(total DOUBLE, origin STRING, convenience DOUBLE DEFAULT 300D) RETURNS DOUBLE": f"CASE WHEN {whole} THEN round(round(tariff_base(total, origin, convenience) * {GST}D, 2) + {SECURITY_FEE}D, 2) ELSE round(total * 0.15D, 2) END",
        "tariff_fee(total DOUBLE, origin STRING, convenience DOUBLE DEFAULT 300D) RETURNS DOUBLE": f"CASE WHEN {whole} THEN airport_fee(origin) ELSE round(total * 0.05D, 2) END",
        "tariff_convenience(total DOUBLE, origin STRING, convenience DOUBLE DEFAULT 300D) RETURNS DOUBLE": "round(total - tariff_base(total, origin, convenience) - tariff_taxes(total, origin, convenience) - tariff_fee(total, origin, convenience), 2)",
    }
    return {head.split("(")[0]: f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in bodies.items()}


def register(spark: SparkSession) -> None:
    """Creates or replaces the functions in this session. They are expanded where they are called, and cost what their columns cost."""
    for statement in definitions().values():
        spark.sql(statement)
