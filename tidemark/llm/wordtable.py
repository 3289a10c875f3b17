"""BPE by distinct words: texts become positions in a word table, each word of the table is encoded once, ids come back by position."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import BLANKS, chunks, give_back, n_ranges, shared_dir, ship, text_of, utf8
from tidemark.llm.tokens import _open

#: Bytes of text that share one list of distinct words. A longer text has its own.
CHUNK_BYTES = 8 << 20
#: Bytes of text for each bucket of words. The distinct words of a bucket are held by one task at a time.
BUCKET_BYTES = 32 << 20
#: Words and ids that a task encodes or joins at once.
STEP = 1 << 11

_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS.encode(), np.uint8))


def split_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of bytes other than the six ASCII blanks, all texts' in order, and each text's first place among them."""
    data, offsets = utf8(column)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    firsts = np.searchsorted(starts, offsets)
    spelled = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=spelled[1:])
    del starts, ends, edge
    words = pa.LargeStringArray.from_buffers(len(spelled) - 1, pa.py_buffer(spelled), pa.py_buffer(data[solid]))
    return words.dictionary_encode(), firsts


def _buckets(words: pa.Array, n: int) -> np.ndarray:
    out = np.empty(len(words), np.int32)
    for i in range(0, len(words), 8 * STEP):
        data, offsets = utf8(words.slice(i, 8 * STEP))
        out[i : i + 8 * STEP] = hashing.ranges(hashing.prefix(hashing.TABLE[data]), offsets[:-1], offsets[1:]) % np.uint64(n)
    return out


def _deal(words: pa.DictionaryArray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words in order of bucket and spelling, their buckets, the words as ranks by frequency, and each rank's place in that order."""
    distinct, codes = words.dictionary, words.indices.to_numpy()
    bucket = _buckets(distinct, n)
    order = pc.sort_indices(pa.table({"b": bucket, "w": distinct}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
    by_count = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    rank, place = np.empty(len(distinct), np.int32), np.empty(len(distinct), np.int32)
    rank[by_count], place[order] = np.arange(len(distinct)), np.arange(len(distinct))
    return distinct.take(pa.array(order)), bucket[order], rank[codes], place[by_count]


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, pa.int32()))


_POSITIONS = ["id", "ranks"]
_libraries: dict[str, object] = {}


def _library(path: str):
    """The worker's tokenizer for a file: without threads of its own, whose memory would stay with each of them."""
    if path not in _libraries:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _libraries[path] = Tokenizer.from_file(path)
        _libraries[path].no_truncation()
        _libraries[path].no_padding()
    return _libraries[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs its id column and `ids`: binary, the ids as little-endian unsigned 32-bit integers, without special tokens.

    with_text: and `decoded`, as decode() has it; the tasks that put ids together join them with their pieces as well.

    Ids are those of the tokenizers library for the whole text. That holds for tokenizers
    whose pieces hold no blank, as when white space is dropped; others are refused.

    1. Texts are split at the six ASCII blanks. Texts of about CHUNK_BYTES share one list of
       distinct words; the texts themselves are written to the shared folder as positions in it.
    2. Lists are dealt by bucket of word. The task of a bucket gets each word of it once a chunk,
       and encodes it once.
    3. Ids go back to their chunk and are joined with the positions.

    A word is in a chunk's list once, so the commonest word is no larger a share of the rows than the chunk's
    list is long. A task holds one chunk, or the distinct words of one bucket.

    Null and empty texts have no ids. Null and repeated ids are kept as they are, a row each; rows
    have no order. Other columns are not carried. An empty table gives an empty one.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    if any(tokenizer.encode(f"a{b}b{b}", add_special_tokens=False).ids != sum((tokenizer.encode(x, add_special_tokens=False).ids for x in "ab"), []) for b in (*BLANKS, BLANKS)):
        raise ValueError("this tokenizer does not drop white space: its words can't be encoded apart")
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    n = n_ranges(slim, F.octet_length("text"), BUCKET_BYTES)
    to = shared_dir(spark, "word-positions")
    wide = tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
    kind = "<u4" if wide else "<u2"
    sent = _send_pieces(spark, tokenizer_path) if with_text else None

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, group = f"{to}/{uuid.uuid4().hex}.parquet", None, 0
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                words, firsts = split_words(part.column("text"))
                spelled, bucket, ranks, places = _deal(words, n)
                # the first row holds each rank's place, the others the texts' words as ranks
                ids = pa.concat_arrays([pa.nulls(1, part.column("id").type), part.column("id")])
                table = pa.table([ids, _lists(np.concatenate([[0], firsts + len(places)]), np.concatenate([places, ranks]))], _POSITIONS)
                if out is None:
                    stream = _open(path, "w")
                    out = pq.ParquetWriter(stream, table.schema, compression="zstd", use_dictionary=False, use_byte_stream_split=["ranks.list.element"], write_statistics=False)
                out.write_table(table, row_group_size=table.num_rows)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                rows = [(int(bucket[a]), "\n".join(spelled.slice(a, b - a).to_pylist())) for a, b in zip(edges, edges[1:]) if a < b] or [(0, "")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), pa.array([group] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows])],
                    names=["path", "part", "bucket", "words"],
                )
                group += 1
                del words, firsts, spelled, bucket, ranks, places, ids, table, rows
                give_back()
        if out is not None:
            out.close()
            stream.close()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at, known = _library(tokenizer_path), None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                path, part, bucket, words = (batch.column(x)[row].as_py() for x in ("path", "part", "bucket", "words"))
                if bucket != at:
                    at, known = bucket, {}
                    give_back()
                words = words.split("\n") if words else []
                new = [x for x in words if x not in known]
                for i in range(0, len(new), STEP):
                    step = new[i : i + STEP]
                    known.update(zip(step, (np.array(x.ids, kind).tobytes() for x in tokenizer.encode_batch(step, add_special_tokens=False))))
                ids = [known[x] for x in words]
                sizes = np.fromiter(map(len, ids), "<u4", len(ids)) // np.dtype(kind).itemsize
                short = not len(sizes) or sizes.max() < 256
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([part], pa.int32()), pa.array([bucket], pa.int32()), pa.array([short]), pa.array([sizes.astype("<u1" if short else "<u4").tobytes()], pa.binary()), pa.array([b"".join(ids)], pa.binary())],
                    names=["path", "part", "bucket", "short", "sizes", "ids"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column("path")[row].as_py(), batch.column("part")[row].as_py()
                if key != at and held:
                    yield from _texts(at, held)
                    held = []
                at = key
                sizes = np.frombuffer(batch.column("sizes")[row].as_py(), "<u1" if batch.column("short")[row].as_py() else "<u4")
                held.append((sizes.astype(np.int64), batch.column("ids")[row].as_py()))
        if held:
            yield from _texts(at, held)

    def _texts(key: tuple[str, int], held: list[tuple[np.ndarray, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([x[0] for x in held])
        ids = np.frombuffer(b"".join(x[1] for x in held), kind).astype("<u4")
        starts = np.cumsum(sizes) - sizes
        with _open(key[0], "r") as file:
            table = pq.ParquetFile(file).read_row_group(key[1], _POSITIONS).combine_chunks()
        lists = table.column("ranks").chunk(0)
        ends, ranks = lists.offsets.to_numpy(), lists.values.to_numpy()
        places = ranks[ends[0] : ends[1]]
        row = 1
        while row < table.num_rows:  # texts of about STEP words at once; a longer one comes alone
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + 64 * STEP, side="right")) - 1)
            at = places[ranks[ends[row] : ends[to]]]
            n_ids = np.concatenate([[0], np.cumsum(sizes[at])])
            found = ids[np.repeat(starts[at] - n_ids[:-1], sizes[at]) + np.arange(n_ids[-1])]
            cuts = n_ids[ends[row : to + 1] - ends[row]]
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - row, [None, pa.py_buffer(4 * cuts), pa.py_buffer(found)])
            columns = [table.column("id").chunk(0).slice(row, to - row), values.cast(pa.binary())]
            if with_text:
                columns.append(_spelled(_pieces(sent, tokenizer_path), found, cuts))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])
            row = to
        give_back()

    ship(spark)
    id_type = slim.schema["id"].dataType.simpleString()
    lists = slim.mapInArrow(positions, "path string, part int, bucket int, words string").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")
    known = lists.mapInArrow(encoded, "path string, part int, bucket int, short boolean, sizes binary, ids binary")
    back = known.repartition(n, "path", "part").sortWithinPartitions("path", "part", "bucket")
    return back.mapInArrow(joined, f"id {id_type}, ids binary" + ", decoded string" * with_text).withColumnRenamed("id", id_col)


def _send_pieces(spark: SparkSession, tokenizer_path: str) -> Broadcast:
    """The piece table for every task, as long as the vocabulary. The last piece stands for ids beyond it."""
    with open(tokenizer_path, encoding="utf-8") as file:
        if json.load(file).get("decoder"):
            raise ValueError("this tokenizer's file names a decoder; only plain pieces are joined")
    return spark.sparkContext.broadcast([*pieces(tokenizer_path), None])


_tables: dict[str, pa.Array] = {}


def _pieces(sent: Broadcast, tokenizer_path: str) -> pa.Array:
    """The pieces as bytes with a blank behind each; those of no id are empty."""
    if tokenizer_path not in _tables:
        _tables[tokenizer_path] = pa.array([b"" if x is None else x.encode() + b" " for x in sent.value], pa.large_binary())
    return _tables[tokenizer_path]


def _spelled(table: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Texts of ids[cuts[i]:cuts[i + 1]]: each id's piece, joined by blanks."""
    found = table.take(pa.array(np.minimum(ids, len(table) - 1).astype(np.int64)))
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
    data = memoryview(found.buffers()[2]) if len(found) and found.buffers()[2] is not None else b""
    edges = ends[cuts].tolist()
    return pa.array([str(data[a : b - 1], "utf-8") if b > a else "" for a, b in zip(edges, edges[1:])], pa.string())


def pieces(tokenizer_path: str) -> list[str | None]:
    """The piece of each id, by id; None where an id is not used."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    found = [None] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        found[i] = piece
    return found


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """encoded's columns, and in to_col the text of ids_col (binary, as encode() writes it): each id joined with its piece, pieces in order.

    The piece table, as long as the vocabulary, is sent to every task; no row moves. Texts are
    those of the library's decode() for tokenizers without a decoder of their own, which puts a
    blank between pieces; others are refused. Ids that the vocabulary lacks are left out, as the library
    does. Null ids give an empty text. A column of the name to_col is replaced.
    """
    sent = _send_pieces(encoded.sparkSession, tokenizer_path)
    names = [c for c in encoded.columns if c != to_col]
    schema = encoded.select(*names).schema.add(to_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, ids_col):
                column = part.column(ids_col).cast(pa.large_binary()).fill_null(b"")
                cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
                ids = np.frombuffer(column.buffers()[2], "<u4")[cuts[0] : cuts[-1]] if cuts[-1] > cuts[0] else np.zeros(0, "<u4")
                texts = _spelled(_pieces(sent, tokenizer_path), ids, cuts - cuts[0])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], texts], names=[*names, to_col])

    ship(encoded.sparkSession)
    return encoded.mapInArrow(run, schema)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of encode() and decode() together."""
    return decoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
