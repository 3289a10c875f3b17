"""Removal of byte windows that start anywhere else in the corpus too."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import map_chunks, meet, row_key, stage, text_of, utf8

#: The most bits of a filter that tasks hold, as a power of two.
FILTER_BITS = 27
_PLACE = np.uint64((1 << 30) - 1)
BLOCK = 16


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, in three passes: running minima of blocks from both ends."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = x
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Runs:
    """The windows of a stretch of texts, each under its leading place.

    A window's leading place is where its least-hashed gram starts, the leftmost of equals: the
    window's own bytes decide it, so that equal windows lead at equal offsets. Neighbouring
    windows with one leading place make a run; every window is in exactly one run.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
        self.prefix = hashing.prefix(hashing.TABLE[data])
        n = len(data)
        if n > _PLACE:
            raise ValueError("a text of more than 1 GiB")
        keep = np.zeros(0, np.int64)
        if n >= size:
            inverse = hashing.powers(hashing.STEP_INVERSE, n + 1)
            grams = hashing.mix((self.prefix[gram:] - self.prefix[:-gram]) * inverse[: n - gram + 1])
            lead = (slide_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), size - gram + 1) & _PLACE).astype(np.int64)
            edges = np.flatnonzero(lead[1:] != lead[:-1]) + 1
            last = np.maximum(offsets[1:] - size + 1, offsets[:-1])
            edges = np.unique(np.concatenate([[0], edges, offsets[:-1], last, [len(lead)]]))
            edges = edges[edges <= len(lead)]
            row = np.searchsorted(offsets, edges[:-1], side="right") - 1
            keep = np.flatnonzero(edges[:-1] + size <= offsets[row + 1])
        if len(keep):
            self.lo, self.end, self.row = edges[keep], edges[keep + 1], row[keep]
            self.lead = lead[self.lo]
            self.gram = grams[self.lead]
        else:
            self.lo = self.end = self.row = self.lead = keep
            self.gram = keep.astype(np.uint64)

    def whole(self, size: int) -> np.ndarray:
        """The hash of all bytes of a run's windows, and of where they lie around the leading place."""
        return hashing.mix(hashing.ranges(self.prefix, self.lo, self.end - 1 + size) + (self.lead - self.lo).astype(np.uint64))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


class Seen:
    """A bitmap of the lower bits of keys: it may pass a key that is not there, never lose one.

    It has 16 bits a key, 2**FILTER_BITS (16 MB) at most, so that what the driver and tasks hold is
    bounded: the driver gets the words that have a bit, 2**(FILTER_BITS - 6) at most, and folds them.
    A fuller bitmap passes more keys to the next step, which is exact. The upper bits of leading
    grams would not do: those grams are the least of many.
    """

    def __init__(self, keys: DataFrame, column: str):
        place = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        words = keys.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
        words = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # Arrow batches: 12 bytes a row, not an object
        self.bitmap = folded(words["w"].to_numpy(), words["bits"].to_numpy().view(np.uint64))
        self.mask = np.uint64(8 * len(self.bitmap) - 1)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        place = (keys & self.mask).astype(np.int64)
        return (self.bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def folded(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The bitmap of 64-bit words at distinct places, halved upon itself while it has more than 16 bits for each one set."""
    full = np.zeros(1 << (FILTER_BITS - 6), "<u8")
    full[places] = words
    bits = min(FILTER_BITS, max(10, (16 * int(np.bitwise_count(words).sum(dtype=np.int64))).bit_length()))
    while 64 * len(full) > 1 << bits:
        full = full[: len(full) // 2] | full[len(full) // 2 :]
    return full.view(np.uint8)


def _with_text(slim: DataFrame, per_doc: DataFrame) -> DataFrame:
    """The texts of the documents in per_doc, beside its columns. Other texts are left out before the shuffle, by a bitmap."""
    held = slim.sparkSession.sparkContext.broadcast(Seen(per_doc, "_k1"))

    def few(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value.passes(batch.column(0).to_numpy().view(np.uint64))))

    texts = map_chunks(slim, "_text", "_k1 long, _k2 long, _text string", few)
    return texts.join(per_doc, ["_k1", "_k2"])


def repeated_spans(slim: DataFrame, size: int, gram: int) -> DataFrame:
    """Starts of windows that occur again, as runs: `_k1`, `_k2`, `_lo`, `_n` (n starts from lo on)."""
    spark = slim.sparkSession

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = Runs(*utf8(batch.column(2)), size, gram)
        return pa.RecordBatch.from_arrays([_longs(runs.gram)], names=["_g"])

    # first digit: the leading gram. Runs of a gram that occurs once end here.
    shared = map_chunks(slim, "_text", "_g long", grams).groupBy("_g").count().filter("count > 1")
    open_grams = spark.sparkContext.broadcast(Seen(shared, "_g"))

    def open_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(2))
        runs = Runs(data, offsets, size, gram)
        on = np.flatnonzero(open_grams.value.passes(runs.gram))
        rows = pa.array(runs.row[on])
        lo = runs.lo[on] - offsets[runs.row[on]]
        columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lo.astype(np.int32)), pa.array((runs.end - runs.lo)[on].astype(np.int32))]
        columns += [pa.array((runs.lead - runs.lo)[on].astype(np.int32)), _longs(runs.gram[on]), _longs(runs.whole(size)[on])]
        return pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "_lo", "_n", "_j", "_g", "_u"])

    runs = stage(map_chunks(slim, "_text", "_k1 long, _k2 long, _lo int, _n int, _j int, _g long, _u long", open_runs), "window-runs")

    # second digit: all bytes of the run. Equal runs repeat as a whole; one of them stands for them from here on.
    handle = F.xxhash64("_k1", "_k2", "_lo")
    equal = runs.groupBy("_g", "_u").agg(F.count("*").alias("_c"), F.min(handle).alias("_first")).filter("_c > 1")
    judged = meet(runs, stage(equal, "window-equal"), ["_g", "_u"], "_c", "left")
    judged = judged.select("_k1", "_k2", "_lo", "_n", "_j", "_g", F.coalesce("_c", F.lit(1).cast("long")).alias("_c"), (F.col("_first").isNull() | (handle == F.col("_first"))).alias("_stands"))
    judged = stage(judged, "window-judged")
    mixed = spark.sparkContext.broadcast(Seen(judged.filter("_stands").groupBy("_g").count().filter("count > 1"), "_g"))

    def in_mixed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(mixed.value.passes(batch.column(5).to_numpy().view(np.uint64))))

    columns = "_k1 long, _k2 long, _lo int, _n int, _j int, _g long, _c long"

    def filter_mixed(batches):
        for batch in batches:
            yield in_mixed(batch)

    asked = judged.filter("_stands").select("_k1", "_k2", "_lo", "_n", "_j", "_g", "_c").mapInArrow(filter_mixed, columns)
    per_doc = asked.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_lo", "_n", "_j", F.least("_c", F.lit(2)).cast("int").alias("_c"))).alias("_runs"))
    per_doc = stage(per_doc, "window-asked")

    # third digit: the bytes that all windows of a block of BLOCK offsets around the leading place have in common.
    def cores(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _blocks(batch, size)

    kinds = "_k1 long, _k2 long, _lo int, _n int, _b int, _c int, _h long"
    blocks = stage(map_chunks(_with_text(slim, per_doc), "_text", kinds, cores), "window-blocks")
    again = blocks.groupBy("_b", "_h").agg(F.sum("_c").alias("_sum"), F.count("*").alias("_rows")).filter("_sum > 1").select("_b", "_h", "_rows")
    left = meet(blocks, stage(again, "window-again"), ["_b", "_h"], "_rows")
    per_doc = left.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_lo", "_n", "_b", "_c")).alias("_runs"))
    per_doc = stage(per_doc, "window-left")

    # last digit: the whole window.
    def singles(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _windows(batch, size)

    each = stage(map_chunks(_with_text(slim, per_doc), "_text", "_k1 long, _k2 long, _lo int, _c int, _h long, _h2 long", singles), "window-singles")
    twice = each.groupBy("_h", "_h2").agg(F.sum("_c").alias("_sum"), F.count("*").alias("_rows")).filter("_sum > 1").select("_h", "_h2", "_rows")
    found = meet(each.filter("_c = 1"), stage(twice, "window-twice"), ["_h", "_h2"], "_rows").select("_k1", "_k2", "_lo", F.lit(1).alias("_n"))
    return judged.filter("_c > 1").select("_k1", "_k2", "_lo", "_n").union(found)


def _flat(batch: pa.RecordBatch):
    """Runs of all texts of a batch: text number, and the struct's fields."""
    column = batch.column("_runs")
    rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    values = column.flatten()
    return rows, [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in values.flatten()]


def _blocks(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Each run in aligned blocks of offsets, with the hash of what the block's windows share."""
    data, offsets = utf8(batch.column("_text"))
    prefix = hashing.prefix(hashing.TABLE[data])
    rows, (lo, n, j, c) = _flat(batch)
    # a run's windows start at lo + t and have offset j - t, t below n: blocks from (j - n + 1) // BLOCK to j // BLOCK
    least = (j - n + 1) // BLOCK
    count = j // BLOCK - least + 1
    k = np.repeat(np.arange(len(lo)), count)
    b = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + least[k]
    first = np.maximum(lo[k], lo[k] + j[k] - (b * BLOCK + BLOCK - 1))
    last = np.minimum(lo[k] + n[k] - 1, lo[k] + j[k] - b * BLOCK)
    place = lo[k] + j[k] + offsets[rows[k]]
    start = place - b * BLOCK
    h = hashing.ranges(prefix, start, start + size - BLOCK + 1)
    at = pa.array(rows[k])
    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c[k].astype(np.int32)), _longs(h)]
    return pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "_lo", "_n", "_b", "_c", "_h"])


def _windows(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Every window of the blocks left, by two hashes of its bytes."""
    data, offsets = utf8(batch.column("_text"))
    prefix = hashing.prefix(hashing.TABLE[data])
    rows, (lo, n, _, c) = _flat(batch)
    k = np.repeat(np.arange(len(lo)), n)
    start = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    s = start + offsets[rows[k]]
    half = size // 2
    h, h2 = hashing.ranges(prefix, s, s + half), hashing.ranges(prefix, s + half, s + size)
    at = pa.array(rows[k])
    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(c[k].astype(np.int32)), _longs(h), _longs(h2)]
    return pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "_lo", "_c", "_h", "_h2"])


def _merge(starts: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the windows as separate spans of bytes."""
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], np.maximum.accumulate((starts + counts - 1 + size)[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[new], hi[np.concatenate([new[1:] - 1, [len(hi) - 1]])]


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, gram: int = 64, with_text: bool = True
) -> DataFrame:
    """Per document row: id, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and, with_text, `kept` (the bytes left).

    Each byte goes that a window of `size` bytes covers which also starts anywhere else, in the
    same document or another. Suffixes are told apart digit by digit, only as deep as `size`
    bytes, and groups of one are done after each digit; groups left at the end are the repeated
    windows. Two exact savings come first: windows whose leading gram occurs once, and runs of
    windows that repeat as a whole, are settled without a row for each window. Of the others,
    the suffixes at every BLOCK-th place from the leading one are grouped by their first
    size - BLOCK + 1 bytes, which all windows of the block hold, and the windows of the blocks left by
    their first and their second half.

    Windows are equal if their 64-bit hashes of each digit are. Texts are taken as UTF-8 bytes, up
    to 1 GiB each (places have 30 bits; a longer one is an error); null is empty. Rows that agree in id and text hold each other's windows, as copies do. An
    empty table gives an empty table.
    """
    if not 1 <= gram <= size - BLOCK:
        raise ValueError("gram must leave a block of offsets in a window")
    k1, k2 = row_key(docs, id_col, text_col)
    slim = docs.select(k1, k2, text_of(docs, text_col).alias("_text"))
    spans = repeated_spans(slim, size, gram)
    per_doc = spans.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_lo", "_n")).alias("_runs"))
    per_doc = stage(per_doc, "window-spans")
    kept_kind = ", kept binary" if with_text else ""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("_text"))
        raw, column, out = data.tobytes(), batch.column("_runs"), []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = column[i].values
            lo, n = (own.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("_lo", "_n"))
            s, e = _merge(lo, n, size)
            left = b"".join(raw[a + x : a + y] for x, y in zip([0, *e.tolist()], [*s.tolist(), b - a]))
            row = (int((e - s).sum()), len(s), hashlib.sha256(left).hexdigest())
            out.append((*row, left) if with_text else row)
        names = ["_removed", "_spans", "_sha"] + ["kept"] * with_text
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x) for x in zip(*out)]], names=["_k1", "_k2", *names])

    done = map_chunks(_with_text(slim, per_doc), "_text", f"_k1 long, _k2 long, _removed long, _spans long, _sha string{kept_kind}", cut)
    done = done.dropDuplicates(["_k1", "_k2"])
    text = text_of(docs, text_col)
    whole = [text.cast("binary").alias("_whole")] if with_text else []
    every = docs.select(docs[id_col].alias("_id"), k1, k2, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_own"), *whole)
    out = every.join(done, ["_k1", "_k2"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.coalesce("_removed", zero).alias("n_removed"),
        F.coalesce("_spans", zero).alias("n_spans"),
        F.coalesce("_sha", "_own").alias("kept_sha256"),
        *([F.coalesce("kept", "_whole").alias("kept")] if with_text else []),
    )
