"""Whitening of embeddings from a tall-skinny QR: no covariance matrix is formed."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stage

#: Numbers of a block of rows that a task factors or projects at once.
BLOCK = 1 << 20
#: Factors that one task merges.
FAN_IN = 8
#: A component whose singular value is at most this share of the first one's has no variance.
NO_VARIANCE = 1e-12


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, shift: int, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole-number vectors, a matrix for each length (or of length size only), without the rows that are dropped."""
    for batch in batches:
        ids, vectors = batch.column("id"), batch.column("vector")
        lengths = np.array(pc.list_value_length(vectors).fill_null(0))
        for d in np.unique(lengths) if size is None else [size]:
            if not d:
                continue
            rows = np.flatnonzero(lengths == d)
            for i in range(0, len(rows), max(1, BLOCK // d)):
                at = pa.array(rows[i : i + max(1, BLOCK // d)])
                values = vectors.take(at).flatten()
                x = np.floor(scale * values.fill_null(float("nan")).to_numpy(zero_copy_only=False)).reshape(-1, d)
                good = (np.abs(x) < 2.0**61).all(axis=1)  # false for NaN and infinity as well
                yield ids.take(at).filter(pa.array(good)), x[good].astype(np.int64) + shift


class _Centre:
    """n * x - sum, exactly: in 64 bits where they suffice, else as Python's numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole, self.rest = (np.array(y, np.int64) for y in zip(*(divmod(s, n) for s in sums)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x - self.whole
        if y.size and int(np.abs(y).max()) * self.n >= 1 << 62:
            y = y.astype(object)
        return self.n * y - self.rest

    def unit(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64)

    @staticmethod
    def squares(z: np.ndarray) -> pa.Array:
        """Row sums of squares; null from 10**38 on."""
        if z.dtype != object and (not z.size or int(np.abs(z).max()) ** 2 * z.shape[1] < 1 << 63):
            return pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
        totals = (z.astype(object) ** 2).sum(axis=1)
        return pa.array([Decimal(int(t)) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def exact_sums(slim: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Rows of the commonest vector length and their exact sums by dimension; (0, []) if there are none. The driver gets a number for each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for _, x in _blocks(batches, scale, shift):
            n, high, low = found.get(x.shape[1], (0, 0, 0))
            found[x.shape[1]] = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pylist([{"size": int(d), "n": n, "high": high.tolist(), "low": low.tolist()}])

    sums = stage(slim.mapInArrow(partial, "size long, n long, high array<long>, low array<long>"), "vector-sums")
    most = sums.groupBy("size").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    each = sums.filter(F.col("size") == most["size"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "of"))
    total = each.groupBy("at").agg(*[F.sum(F.col("of")[c].cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("at").collect()
    return most.n, [(int(r.high) << 32) + int(r.low) for r in total]


def _r(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.qr(matrix, mode="r")


_FACTOR = "node long, r binary"


def _factor(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])


def _merged(factors: DataFrame, d: int) -> DataFrame:
    """The R factor of all rows: FAN_IN factors at a time are stacked and factored again, until one is left."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, r = None, None
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("r")):
                more = np.frombuffer(raw.as_py()).reshape(-1, d)
                if node // FAN_IN != at and r is not None:
                    yield _factor(at, r)
                    r = None
                at = node // FAN_IN
                r = more if r is None else _r(np.vstack([r, more]))
        if r is not None:
            yield _factor(at, r)

    while (n := factors.agg(F.max("node")).first()[0]) is not None and n > 0:
        dealt = factors.repartition(n // FAN_IN + 1, F.floor(F.col("node") / FAN_IN)).sortWithinPartitions("node")
        factors = stage(dealt.mapInArrow(merge, _FACTOR), "r-factors")
    return factors


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Each vector's whitened coordinates: id_col, `n`, `deviation`, `whitened`, `explained` (arrays over the first components), `identity_error`.

    Entries c become floor(scale * c) + shift. Rows are centred with exact sums; each task
    factors its rows (A = QR) block by block, R factors are merged in a tree of FAN_IN, and the singular
    values and right vectors of the last R are the components: A'A is never formed. A task
    holds one block of rows and two factors of (length of a vector) squared; the driver gets the sums and
    the components. Nothing is dealt by key, so repeated vectors cost nothing.

    `deviation` is the exact sum of squares of n * x - sum as decimal(38,0), null from 10**38 on.
    `identity_error` is the largest absolute entry of the whitened coordinates' covariance minus the identity.

    Dropped are vectors that are null, empty, hold null or non-finite entries or such of 2**61 / scale or more,
    and those of another length than most (of equally frequent lengths the longer one counts). Null and repeated ids
    are kept, a row each; other columns are not carried. A component without variance (NO_VARIANCE) has
    null coordinates and counts in no identity_error, which is null if there is none other; `explained` is null if no
    dimension varies. An empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    slim = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vector"))
    id_type = slim.schema["id"].dataType.simpleString()
    n, sums = exact_sums(slim, scale, shift)
    schema = f"id {id_type}, deviation decimal(38,0), whitened array<double>"
    if not n:
        none = spark.createDataFrame([], schema)
        return none.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.col("whitened").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    d, centre = len(sums), _Centre(n, sums)
    kept = min(components, d)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for _, x in _blocks(batches, scale, shift, d):
            if len(x):
                a = centre.unit(centre(x))
                r = _r(a if r is None else np.vstack([r, a]))
        if r is not None:
            yield _factor(TaskContext.get().partitionId(), r)

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("r"):
                _, s, right = np.linalg.svd(np.frombuffer(raw.as_py()).reshape(-1, d), full_matrices=True)
                values = np.zeros(d)
                values[: len(s)] = s
                yield _factor(0, np.vstack([values, right[:kept]]))

    last = _merged(stage(slim.mapInArrow(factor, _FACTOR), "r-factors"), d)
    found = np.frombuffer(last.mapInArrow(spectrum, _FACTOR).first().r).reshape(-1, d)
    variances, right = found[0] ** 2 / n, found[1:]
    varies = found[0][:kept] > NO_VARIANCE * found[0][0]
    to_unit = np.where(varies, right.T / np.sqrt(np.where(varies, variances[:kept], 1)), np.nan)
    trace = float(variances.sum())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, scale, shift, d):
            z = centre(x)
            flat = (centre.unit(z) @ to_unit).reshape(-1)
            values = pa.array(flat, mask=np.isnan(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, kept), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([ids, centre.squares(z), lists], names=["id", "deviation", "whitened"])

    rows = stage(slim.mapInArrow(project, schema), "whitened")
    real = [i for i in range(kept) if varies[i]]
    pairs = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)) for i in real for j in real if i <= j]
    error = rows.agg(F.greatest(*pairs) if len(pairs) > 1 else pairs[0]).first()[0] if pairs else None
    explained = [float(v) / trace if trace else None for v in variances[:kept]]
    return rows.select(
        F.col("id").alias(id_col),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(x).cast("double") for x in explained]).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def digest(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component. deviation as a long: null where it takes more than 63 bits."""
    return whitened.select(
        id_col, "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_of")
    ).select(id_col, (F.col("_at") + 1).alias("component"), "n", "deviation", F.col("_of.whitened").alias("whitened"), F.col("_of.explained").alias("explained"), "identity_error")
