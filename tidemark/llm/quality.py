"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio against the trusted part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, nest, settled, text_of, unnest

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 14
#: Mean log ratio per n-gram, in nats, that a document must reach. Text of the corpus's own kind is near 0;
#: text of n-grams that the trusted part lacks is well below.
THRESHOLD = -0.05
#: Trusted ids are broadcast up to this count (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 4_000_000

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _indices(n: Column) -> Column:
    """0 .. n - 1; empty where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _buckets(hashes: str, buckets: int) -> Column:
    """Bucket numbers of the hashed words and of the pairs of neighbours."""
    pairs = F.transform(_indices(F.size(hashes) - 1), lambda i: F.pmod(F.xxhash64(_at(hashes, i), _at(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, smoothing: float) -> list[float]:
    """ln P(bucket | trusted) - ln P(bucket | corpus) for each bucket, both smoothed; one pass over all texts.

    Counts are combined map-side, so that at most `buckets` rows a task are shuffled and
    `buckets` numbers reach the driver, whatever the corpus.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).filter("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    few = ids.count() <= BROADCAST_IDS
    hashed = F.transform(words_of(text_of(docs, text_col)), lambda w: F.xxhash64(w))
    slim = docs.select(docs[id_col].alias("_id"), hashed.alias("_h"))
    if few:
        marked = slim.join(F.broadcast(ids), "_id", "left")
    else:  # rows without an id would meet in one task
        marked = slim.filter("_id is not null").join(ids, "_id", "left").unionByName(slim.filter("_id is null").withColumn("_trusted", F.lit(None).cast("int")))
    counts = (
        marked.select("_trusted", F.explode(_buckets("_h", buckets)).alias("_b"))
        .groupBy("_b")
        .agg(F.count("*").alias("n"), F.count("_trusted").alias("t"))
        .collect()
    )
    n, t = [0] * buckets, [0] * buckets
    for row in counts:
        n[row._b], t[row._b] = row.n, row.t
    if not sum(t):
        return [0.0] * buckets
    all_n, all_t = sum(n) + smoothing * buckets, sum(t) + smoothing * buckets
    return [round(math.log((t[b] + smoothing) / all_t) - math.log((n[b] + smoothing) / all_n), 4) for b in range(buckets)]


def score(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    buckets: int = BUCKETS,
    smoothing: float = 1.0,
) -> DataFrame:
    """docs with ADDED: counts of each text, `base_failed`, `llr` (per n-gram, null without words) and `kept`.

    trusted: ids of trusted documents in its first column; rows of docs with such an id make the
    target multinomial, all rows the corpus's. N-grams are words and pairs of neighbouring
    words, hashed to `buckets`. kept: not base_failed and llr >= threshold.

    n_repeat_words counts words inside a three-word window that the text holds twice or more;
    windows are compared by 64-bit hashes within one text. Null and empty texts have no words
    and fail. Without any trusted text every llr is 0. Repeated rows are scored one by one. An
    empty table gives an empty table. Columns of docs named like ADDED are replaced.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col, buckets, smoothing)
    table = F.from_json(F.lit("[" + ",".join(map(repr, ratios)) + "]"), "array<double>")
    text = text_of(docs, text_col)
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x09-\x0D ]"))
    base = nest(docs, text.alias("_text")).select(
        "*",
        F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h"),
        F.char_length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    windows = F.transform(_indices(F.size("_h") - 2), lambda i: F.xxhash64(_at("_h", i), _at("_h", i + 1), _at("_h", i + 2)))
    base = base.select(
        "*",
        F.size("_h").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_g"),
    )
    # windows with their places, in the order of their hashes: equal ones are neighbours
    paired = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    base = base.withColumn("_pairs", paired)
    twice = F.filter("_pairs", lambda x, j: (F.get("_pairs", j - 1)["g"].eqNullSafe(x["g"])) | (F.get("_pairs", j + 1)["g"].eqNullSafe(x["g"])))
    base = base.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covers = F.transform("_places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_places", j + 1) - p, F.lit(3))))
    summed = F.aggregate(F.transform(_buckets("_h", buckets), lambda b: F.get(table, b)), F.lit(0.0), lambda a, x: a + x)
    n_grams = 2 * F.col("n_words") - 1
    base = base.withColumn("n_repeat_words", F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = base.withColumn("base_failed", failed).withColumn("llr", F.when(F.col("n_words") > 0, summed / n_grams))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return settled(out.withColumn("kept", kept).select(*unnest([c for c in docs.columns if c not in ADDED]), *ADDED), ADDED)


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(id_col, *ADDED)
