"""Packing: documents in the order of a space-filling curve, cut into sequences without gaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, n_ranges, row_key, ship, stage
from tidemark.llm.tokens import doubtful, encoder

DIMENSIONS, ORDER = 4, 12
#: Ids of a piece that is dealt and sorted as one row: long documents weigh by their length.
PIECE_IDS = 4096


def hilbert_key(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The index along the Hilbert curve of points with integer coordinates below 2**order, one row each.

    Skilling's transform ("Programming the Hilbert curve", 2004), for all rows at once.
    """
    x = points.T.astype(np.int64).copy()
    n, top = len(x), 1 << (order - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _directions(size: int) -> np.ndarray:
    """For each token bucket, DIMENSIONS random bits in lanes of 16 bits of one integer."""
    bits = np.random.default_rng(71).integers(0, 2, (size, DIMENSIONS), np.uint64)
    return (bits << (np.arange(DIMENSIONS, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64)


def curve_point(ids: np.ndarray, directions: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A document's grid point: its token counts, projected on random signs, by the share of its length.

    The number of directions is a power of two.
    """
    if not len(ids):
        return np.full(DIMENSIONS, 1 << (order - 1))
    lanes, ups = directions[ids & np.uint32(len(directions) - 1)], np.zeros(DIMENSIONS, np.int64)
    for i in range(0, len(lanes), 65_535):  # as many bits as a lane can count
        ups += lanes[i : i + 65_535].sum(keepdims=True).view("<u2")
    spread = (2 * ups - len(ids)) / len(ids)
    return np.clip((np.tanh(4 * spread) + 1) / 2 * (1 << order), 0, (1 << order) - 1).astype(np.int64)


def _narrow(ids: bytes) -> bytes:
    """Ids of 32 bits as 16 bits each if all fit; else as they are behind one byte, so that their length is odd."""
    wide = np.frombuffer(ids, "<u2")
    return b"\0" + ids if wide[1::2].any() else wide[::2].tobytes()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`).

    Every text is encoded and followed by end_id. Documents are dealt by ranges of their key on
    the Hilbert curve (ties by id and content, so that a group of copies spreads over ranges) in
    rows of PIECE_IDS ids at most, so that a range has about RANGE_BYTES whatever its documents'
    lengths, sorted, and laid end to end; a new sequence starts every `length` ids. Only the last
    sequence of a range is short, one in thousands. sequence_id is the range's number times
    2**32 plus the sequence's number there.

    Null and empty texts are the end id alone. Repeated rows are packed once each. An empty
    table gives no pieces.
    """
    k1, k2 = row_key(docs, id_col, text_col)
    slim = docs.select(docs[id_col].alias("_id"), k1, k2, docs[text_col].cast("string").alias("_text"))
    kind, odd = dict(slim.dtypes)["_id"], doubtful(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, directions = encoder(tokenizer_path, odd), np.array([end_id], "<u4").tobytes(), _directions(1 << 14)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "_text"):
                found = [enc.encode(text or "") for text in part.column(3).to_pylist()]
                keys = hilbert_key(np.array([curve_point(np.frombuffer(x, "<u4"), directions) for x in found]))
                whole = [x + end for x in found]
                counts = [-(-len(x) // (4 * PIECE_IDS)) for x in whole]
                rows = np.repeat(np.arange(len(whole)), counts)
                starts = np.concatenate([np.arange(n) * PIECE_IDS for n in counts])
                packed = [_narrow(whole[k][4 * s : 4 * (s + PIECE_IDS)]) for k, s in zip(rows.tolist(), starts.tolist())]
                at, sizes = pa.array(rows), np.array([len(x) // 4 for x in whole])
                columns = [*(part.column(i).take(at) for i in range(3)), pa.array(keys[rows]), pa.array(number + rows), pa.array(starts), pa.array(sizes[rows]), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_k1", "_k2", "_key", "_row", "_start", "_size", "_ids"])
                number += len(whole)

    ship(docs.sparkSession)
    encoded = stage(slim.mapInArrow(encode, f"_id {kind}, _k1 long, _k2 long, _key long, _row long, _start long, _size long, _ids binary"), "encoded")
    order = ["_key", "_id", "_k1", "_k2", "_row", "_start"]  # _row parts repeated rows
    n = n_ranges(encoded, F.octet_length("_ids"))
    dealt = encoded.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_id", "_start", "_size", "_ids")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows, keys = [], []
            for k, (first, size, raw) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                ids = np.frombuffer(raw[1:], "<u4") if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - at % length)
                    piece = ids[start : start + n].tobytes()
                    row = (first + start, n, zlib.crc32(piece), size, base + at // length, at % length)
                    rows.append((*row, piece) if with_ids else row)
                    keys.append(k)
                    start, at = start + n, at + n
            columns = [pa.array(x) for x in zip(*rows)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *columns], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names[1:])
    return dealt.mapInArrow(cut, schema)
