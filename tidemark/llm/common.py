"""Helpers that the corpus operators share: staging, row keys and Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that separate words: tab, line feed, vertical tab, form feed, return, space.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a Python task works on at once.
CHUNK_BYTES = 1 << 20
#: Keys with more than one in HOT_KEYS of all rows are hot; there are fewer than HOT_KEYS of them.
HOT_KEYS = 2000
#: Bytes that a task of a range-dealt step gets, about.
RANGE_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver knows its folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors reach. Unset, it is set to a local folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later steps start there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has staged. Results that read it must have been written or collected."""
    folder = shared_dir(spark, "x").rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_ranges(df: DataFrame, size: Column, each: int | None = None) -> int:
    """Ranges to deal df in, so that a task gets about `each` bytes (RANGE_BYTES) however large df is; the session's partition count at least."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (each or RANGE_BYTES)))


def meet(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row a key and in `weight` about how many of rows have it.

    The fewer than HOT_KEYS keys that hold more than one in HOT_KEYS of all weights are
    broadcast, so that no task of the shuffled join gets more of one key than that share. table is
    read three times: it should be staged.
    """
    line = (table.agg(F.sum(weight)).first()[0] or 0) / HOT_KEYS
    hot, rest = F.broadcast(table.filter(F.col(weight) > line)), table.filter(F.col(weight) <= line)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how))


def row_key(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of id and text. Rows that agree in both columns share the key, and every result."""
    return [
        F.xxhash64(df[id_col], df[text_col]).alias("_k1"),
        F.xxhash64(df[text_col], df[id_col], F.lit(7)).alias("_k2"),
    ]


def text_of(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def nest(df: DataFrame, *extra: Column) -> DataFrame:
    """df's row as one column `_row`, beside extra: no column of df can clash with a step's own names."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *extra)


def unnest(columns: list[str]) -> list[Column]:
    return [F.col("_row")[c].alias(c) for c in columns]


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns last, each computed once: filters on them are not moved into their expressions.

    Without it, a filter on a result that is built step by step is rewritten with every step's
    expression in place of its name, and grows with each of them.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, total + most, side="right")))
        yield batch.slice(start, stop - start)
        total, start = int(ends[stop - 1]), stop


def map_chunks(df: DataFrame, text_col: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Applies work to slices of about CHUNK_BYTES of text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hands memory that a task no longer holds back to the system: its worker lives on, and others need room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and the offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
