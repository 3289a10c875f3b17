"""Benchmark decontamination: documents whose words lie inside benchmark windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import map_chunks, nest, row_key, stage, unnest, utf8

#: Byte classes and lower case: digits, a-z and every byte of a non-ASCII character make words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

BITMAP_BITS = 22


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; each word's start and end; the first word of each text (and the total)."""
    data = _LOWER[data]
    flags = _IS_WORD[data]
    starts, ends = hashing.runs(flags)
    # a run over a border between texts is two words
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(flags))]
    cut = np.unique(cut[flags[cut] & flags[cut - 1]]) if len(cut) else cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return data, starts, ends, np.searchsorted(starts, offsets)


class Windows:
    """The benchmark's windows: their hashes by length in words, and their items by exact words."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names: list[str] = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.exact: dict[bytes, list[int]] = defaultdict(list)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for name, window in items:
            if window not in self.exact:
                by_length[window.count(b" ") + 1].append(window)
            self.exact[window].append(number[name])
        self.exact = dict(self.exact)
        self.hashes: dict[int, np.ndarray] = {}
        self.bitmaps: dict[int, np.ndarray] = {}
        for n, windows in by_length.items():
            column = pa.array([w.decode() for w in windows])
            data, offsets = utf8(column)
            data, starts, ends, first = words_of(data, offsets)
            h = np.sort(gram_hashes(word_hashes(data, starts, ends), n)[first[:-1]])
            self.hashes[n] = h
            bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
            np.bitwise_or.at(bitmap, *_bit(h))
            self.bitmaps[n] = bitmap

    def maybe(self, n: int, h: np.ndarray) -> np.ndarray:
        """Positions in h that a window of n words may have."""
        byte, bit = _bit(h)
        at = np.flatnonzero(self.bitmaps[n][byte] & bit)
        if len(at):
            own = self.hashes[n]
            at = at[own[np.minimum(np.searchsorted(own, h[at]), len(own) - 1)] == h[at]]
        return at


def _bit(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = h >> np.uint64(64 - BITMAP_BITS)
    return (top >> np.uint64(3)).astype(np.int64), np.left_shift(1, (top & np.uint64(7)).astype(np.uint8)).astype(np.uint8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashing.ranges(hashing.prefix(hashing.TABLE[data]), starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, by its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(words) - n + 1)
    return hashing.ranges(hashing.prefix(words), starts, starts + n)


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n_words: int) -> DataFrame:
    """Distinct (item, window): n_words consecutive words, or all words of a shorter item."""
    folded = F.translate(benchmark[text_col], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    count = F.size("_w")
    starts = F.sequence(F.lit(1), F.greatest(count - n_words + 1, F.lit(1)))
    return (
        benchmark.select(benchmark[item_col].cast("string").alias("_item"), words.alias("_w"))
        .filter(count > 0)
        .select("_item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i, n_words), " "))).alias("_window"))
        .distinct()
    )


def _scan(held):
    """Per row: key, number of words, covered runs of words as starts and ends, items found. held: a broadcast of Windows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows = held.value
        data, offsets = utf8(batch.column("_text"))
        data, starts, ends, first = words_of(data, offsets)
        hashed = word_hashes(data, starts, ends)
        row = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
        covered = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for n in windows.hashes:
            grams = gram_hashes(hashed, n)
            if not len(grams):
                continue
            at = windows.maybe(n, grams)
            at = at[row[at] == row[at + n - 1]]
            for i in at.tolist():
                found = windows.exact.get(b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + n], ends[i : i + n])))
                if found is not None:
                    covered[i] += 1
                    covered[i + n] -= 1
                    items[int(row[i])].update(found)
        covered = np.cumsum(covered[:-1]) > 0
        lo, hi = hashing.runs(covered)
        cut = first[1:-1]
        cut = cut[(cut > 0) & (cut < len(covered))]
        cut = np.unique(cut[covered[cut] & covered[cut - 1]]) if len(cut) else cut
        lo, hi = np.sort(np.concatenate([lo, cut])), np.sort(np.concatenate([hi, cut]))
        spans = np.searchsorted(lo, first).astype(np.int32)
        owner = row[lo] if len(lo) else lo
        base = first[owner] if len(lo) else lo
        names = [[windows.names[k] for k in sorted(items.get(i, ()))] for i in range(batch.num_rows)]
        out = [pa.array(np.diff(first), pa.int64())]
        out += [pa.ListArray.from_arrays(pa.array(spans), pa.array(x - base, pa.int32())) for x in (lo, hi)]
        out.append(pa.array(names, pa.list_(pa.string())))
        kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + out,
            names=[batch.schema.names[i] for i in kept] + ["n_words", "span_starts", "span_ends", "items"],
        )

    return work


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n_words: int = 13,
    block_windows: int = 1_000_000,
) -> DataFrame:
    """Per document row: id, `_k1`, `_k2`, `n_words`, `n_hit`, `span_starts`, `span_ends` (word positions), `items`.

    The driver and each task hold one block of at most `block_windows` windows (about 100 bytes
    each) at a time. A larger benchmark is written in blocks first; all documents are read
    against each block, its hits are written, the block is released, and the spans of a row are
    merged. Hashes only select; every hit is compared word for word.

    Null texts and texts without words: no words, no hits. A null item id counts as the
    item ''. An empty benchmark hits nothing; an empty table gives an empty table. Rows that
    agree in id and text share one result (`_k1`, `_k2` identify them).
    """
    k1, k2 = row_key(docs, id_col, text_col)
    slim = docs.select(docs[id_col].alias("_id"), k1, k2, docs[text_col].cast("string").alias("_text"))
    schema = f"_id {dict(slim.dtypes)['_id']}, _k1 long, _k2 long, n_words long, span_starts array<int>, span_ends array<int>, items array<string>"
    windows = stage(benchmark_windows(benchmark, item_col, item_text_col, n_words), "benchmark-windows")
    n_blocks = max(1, -(-windows.count() // block_windows))

    def read(block: int) -> tuple[Broadcast, DataFrame]:
        own = windows.filter(F.pmod(F.xxhash64("_window"), F.lit(n_blocks)) == block) if n_blocks > 1 else windows
        held = docs.sparkSession.sparkContext.broadcast(Windows([(name or "", w.encode()) for name, w in own.toLocalIterator()]))
        return held, map_chunks(slim, "_text", schema, _scan(held))

    if n_blocks == 1:
        found = read(0)[1]
    else:
        parts = []
        for block in range(n_blocks):
            held, part = read(block)
            parts.append(stage(part.filter(F.size("items") > 0) if block else part, "benchmark-hits"))
            held.destroy()
            del held, part
        rows, found = parts[0], parts[0].filter(F.size("items") > 0)
        for part in parts[1:]:
            found = found.unionByName(part)
        # copies of a row give equal spans, so that their union is theirs
        found = found.groupBy("_k1", "_k2").agg(
            F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends"))).alias("_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        merged = F.aggregate(
            F.array_sort("_spans"),
            F.array().cast("array<struct<span_starts:int,span_ends:int>>"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["span_ends"] >= x["span_starts"]),
                F.concat(
                    F.slice(acc, F.lit(1), F.size(acc) - 1),
                    F.array(
                        F.struct(
                            F.element_at(acc, -1)["span_starts"].alias("span_starts"),
                            F.greatest(F.element_at(acc, -1)["span_ends"], x["span_ends"]).alias("span_ends"),
                        )
                    ),
                ),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        none = lambda kind: F.array().cast(f"array<{kind}>")
        merged = found.withColumn("_spans", merged).select("_k1", "_k2", "_spans.span_starts", "_spans.span_ends", "items")
        found = rows.select("_id", "_k1", "_k2", "n_words").join(merged, ["_k1", "_k2"], "left")
        found = found.withColumns({c: F.coalesce(c, none(k)) for c, k in (("span_starts", "int"), ("span_ends", "int"), ("items", "string"))})
    n_hit = F.aggregate(F.zip_with("span_ends", "span_starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", n_hit).withColumnRenamed("_id", id_col)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return hits.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without its contaminated rows; the others stay as they are, null texts included.

    Contaminated: at least one word in twenty lies inside benchmark windows. Only the keys of
    contaminated rows meet the documents again.
    """
    hits = find_hits(docs, benchmark, id_col, text_col, **options)
    bad = hits.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select("_k1", "_k2").distinct()
    return nest(docs, *row_key(docs, id_col, text_col)).join(bad, ["_k1", "_k2"], "left_anti").select(*unnest(docs.columns))


#: The digest as SQL over documents and benchmark, by exact words.
ORACLE_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), gram AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, gram.n, item FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n
), word AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""
