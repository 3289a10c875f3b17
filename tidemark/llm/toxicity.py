"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import chunks, map_chunks, ship, utf8
from tidemark.llm.decontaminate import words_of

BITS = 18
PREFIX_BYTES = 5
#: Confirmed ids are broadcast up to this number; beyond it, the join is shuffled.
MOST_BROADCAST = 4_000_000


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature): hashed lower-case words, and the first bytes of longer words."""
    data, starts, ends, first = words_of(data, offsets)
    prefix = hashing.prefix(hashing.TABLE[data])
    row = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    long = ends - starts > PREFIX_BYTES
    whole = hashing.ranges(prefix, starts, ends) >> np.uint64(65 - BITS)
    stem = (hashing.ranges(prefix, starts[long], starts[long] + PREFIX_BYTES) >> np.uint64(65 - BITS)) | np.uint64(1 << (BITS - 1))
    keys = np.concatenate([whole, stem]).astype(np.int64) | (np.concatenate([row, row[long]]) << BITS)
    keys = np.unique(keys)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def choose(df_p: np.ndarray, n_p: int, df_u: np.ndarray, n_u: int, prior: float, least: float = 2.5, pure: float = 0.4) -> np.ndarray:
    """Features that are more frequent among positives than among unlabelled texts by `least` standard errors or
    more, and of which positives explain the share `pure` at least: chance features would be learnt by heart."""
    p, u = (df_p + 0.5) / (n_p + 1), (df_u + 0.5) / (n_u + 1)
    strength = (p - u) / np.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    return np.flatnonzero((strength >= least) & (prior * p >= pure * u))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two terms of the risk of the positives' and the unlabelled texts' logits, and the descent's gradients by them.

    Risk: prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]), with the logistic
    loss. Where the second term is negative, its descent is undone instead: the gradients are
    those of the term's negative alone (Kiryo et al., 2017).
    """
    plus = prior * np.logaddexp(0, -z_p).mean()
    minus = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    s_p, s_u = sigmoid(z_p) / len(z_p), sigmoid(z_u) / len(z_u)
    if minus >= 0:
        return plus, minus, prior * (s_p - 1 / len(z_p)) - prior * s_p, s_u
    return plus, minus, prior * s_p, -s_u


def fit(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float, size: int, steps: int = 150, rate: float = 0.05, l2: float = 3e-4):
    """Weights of `size` features and bias of a logistic score by descent of the non-negative risk. rows: each text's features."""

    def sparse(mask: np.ndarray):
        """The product of the masked rows with weights, and that of their transpose with a number a row."""
        held = [r for r, m in zip(rows, mask) if m]
        row, at = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate([np.zeros(0, np.int64), *held])
        return lambda w: np.bincount(row, weights=w[at], minlength=len(held)), lambda g: np.bincount(at, weights=g[row], minlength=size)

    (times_p, back_p), (times_u, back_u) = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        _, _, gp, gu = risk(times_p(w) + b, times_u(w) + b, prior)
        g = np.append(back_p(gp) + back_u(gu) + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    most_positive: int = 4_000,
    most_unlabelled: int = 12_000,
):
    """Weights and bias, or None without a confirmed example.

    Confirmed toxic documents outside the held-out fold are the positives; all documents outside
    it, whatever their labels, are the unlabelled. Features are chosen by their document
    frequencies in all of both. The gradient steps take a sample, the first `most_positive` and
    `most_unlabelled` ids by a hash, with one row an id and of its features the chosen ones: that
    many rows, however often an id repeats, are what the one training task gets. The prior is the
    toxic share of all labelled ids outside the fold unless given.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null and _label is not null")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).filter(F.col("_id").isNotNull())
    order = F.xxhash64(F.col("_id"), F.lit(9))
    p = known.filter("_label = 1").orderBy(order, "_id").limit(most_positive).select("_id", F.lit(1).alias("_p"))
    slim = slim.filter(~held_out(F.col("_id")))
    u = slim.select("_id").distinct().orderBy(order, "_id").limit(most_unlabelled).select("_id", F.lit(1).alias("_u"))
    if prior is None:
        share = known.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
        prior = min(0.5, max(0.005, share or 0.0))
    chosen = _chosen(slim, known.filter("_label = 1").select("_id"), prior)
    if chosen is None:
        return None
    held = docs.sparkSession.sparkContext.broadcast(chosen)
    picked = F.broadcast(p.join(u, "_id", "full"))
    sample = slim.join(picked, "_id")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = features(*utf8(batch.column(1)))
        column = np.full(1 << BITS, -1)
        column[held.value] = np.arange(len(held.value))
        on = column[found] >= 0
        rows, found = rows[on], column[found[on]]
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], names=["_id", "_p", "_u", "_f"])

    kind = dict(slim.dtypes)["_id"]
    counted = map_chunks(sample.select("_id", "_text", "_p", "_u"), "_text", f"_id {kind}, _p int, _u int, _f array<int>", count)
    counted = counted.groupBy("_id", "_p", "_u").agg(F.min("_f").alias("_f"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ps, us, rows = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            ps += batch.column(1).is_valid().to_pylist()
            us += batch.column(2).is_valid().to_pylist()
            rows += [x.values.to_numpy() for x in batch.column(3)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(rows[i]), rows[i].tobytes()))
        if any(ps) and any(us):
            flags = [np.array([x[i] for i in order], bool) for x in (ps, us)]
            weights = np.zeros(1 << BITS, np.float32)
            weights[held.value], bias = fit([rows[i].astype(np.int64) for i in order], *flags, prior, len(held.value))
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], names=["w", "b"])

    ship(docs.sparkSession)
    found = counted.repartition(1).mapInArrow(learn, "w binary, b double").first()
    return None if found is None else (np.frombuffer(bytes(found.w), "<f4"), found.b)


def _chosen(slim: DataFrame, positives: DataFrame, prior: float) -> np.ndarray | None:
    """The features that part the positives from all texts; None without a positive. A task holds two counts a feature."""
    few = positives.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    positives = positives.withColumn("_p", F.lit(1))
    marked = slim.join(F.broadcast(positives) if few else positives, "_id", "left").select("_text", "_p")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in chunks(batch, "_text"):
                rows, found = features(*utf8(part.column(0)))
                own = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                df[0] += np.bincount(found[own[rows]], minlength=1 << BITS)
                df[1] += np.bincount(found, minlength=1 << BITS)
                n += own.sum(), part.num_rows
        at = np.flatnonzero(df[1])
        columns = [np.append(at, -1), np.append(df[0][at], n[0]), np.append(df[1][at], n[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["at", "p", "u"])

    ship(slim.sparkSession)
    found = marked.mapInArrow(count, "at long, p long, u long").groupBy("at").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    df, (at, p, u) = np.zeros((2, (1 << BITS) + 1), np.int64), (found[x].to_numpy() for x in ("at", "p", "u"))
    df[0][at], df[1][at] = p, u  # the last place, -1, has the numbers of documents
    return choose(df[0][:-1], df[0][-1], df[1][:-1], df[1][-1], prior) if df[0][-1] else None


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **options
) -> DataFrame:
    """Per document row: id, `held_out`, `score` (0 to 1), `predicted` (1 if score >= threshold).

    Every whole text is scored from its distinct features alone: no label, id, language or
    source goes into a score. Null and empty texts have no features and get the score of the
    bias. Without a confirmed example every score is 0. Null ids are not held out. Repeated
    rows are scored one by one. An empty table gives an empty table. Options are those of train:
    `prior`, and the bounds `most_positive` and `most_unlabelled` of the training sample.
    """
    model = train(docs, labels, id_col, text_col, label_col, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if held.value is None:
            scores = np.zeros(batch.num_rows)
        else:
            weights, bias = held.value
            rows, found = features(*utf8(batch.column(1)))
            z = np.bincount(rows, weights=weights[found], minlength=batch.num_rows) + bias
            scores = sigmoid(z)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["_id", "score"])

    kind = dict(slim.dtypes)["_id"]
    return map_chunks(slim, "_text", f"_id {kind}, score double", work).select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
