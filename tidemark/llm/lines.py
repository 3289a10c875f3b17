"""Line dedup: lines that occur in many documents are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, LOWER, UPPER, meet, nest, row_key, stage, text_of, unnest


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """docs with `n_lines`, `n_dropped` and `kept_text` added.

    A line's key counts once for each row that holds it; rows are documents, whether or
    not their ids repeat. Keys of `min_chars` code points or more in `min_docs` documents
    or more lose all their lines. Keys are compared as two 64-bit hashes. The frequency join
    moves only hashes and positions, and a line that many documents share is broadcast, not
    shuffled, so that no task gets it whole. Text moves once, to meet its dropped positions.

    Null or empty text: one empty line, kept. An empty table gives an empty table. Columns
    of docs named like the three added ones are replaced; all others are kept.
    """
    if min_chars < 1:
        raise ValueError("min_chars is 1 at least: empty lines hold the layout")
    k1, k2 = row_key(docs, id_col, text_col)
    keys = F.transform(F.split(text_of(docs, text_col), "\n", -1), line_key)
    hashed = [F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(7), F.col("_line")).alias("_g")]
    long_enough = F.char_length("_line") >= min_chars
    each = docs.select(F.explode(F.array_distinct(keys)).alias("_line")).filter(long_enough).select(*hashed)
    frequent = stage(each.groupBy("_h", "_g").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_docs), "frequent-lines")
    places = docs.select(k1, k2, F.posexplode(keys).alias("_pos", "_line")).filter(long_enough).select("_k1", "_k2", "_pos", *hashed)
    dropped = meet(places, frequent, ["_h", "_g"], "_n").groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_drop"))
    added = {"n_lines", "n_dropped", "kept_text"}
    keyed = nest(docs, k1, k2).join(dropped, ["_k1", "_k2"], "left")
    lines = F.split(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")), "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drop", F.array().cast("array<int>")))
    return (
        keyed.withColumn("_lines", lines)
        .withColumn("_keep", keep)
        .select(
            *unnest([c for c in docs.columns if c not in added]),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_keep")).cast("long").alias("n_dropped"),
            F.array_join(F.transform("_keep", lambda i: F.get(F.col("_lines"), i)), "\n").alias("kept_text"),
        )
    )


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(
        id_col, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


#: The digest as SQL over the table documents.
ORACLE_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT r, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS line FROM split
), keyed AS (
  SELECT r, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), flagged AS (
  SELECT keyed.*, common.key IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (key)
), per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM flagged GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM per JOIN split USING (r)
"""
