"""Token ids: a word-caching encoder, a bit-packed file format, and its writer and reader."""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, n_ranges, shared_dir, ship, stage, text_of

#: Entries of the young half of a worker's word cache; at most twice as many are held (about 250 bytes each).
CACHE_WORDS = 400_000

_BLANK_RUNS = re.compile(r"(\s\s+)")

# Fixed values of byte-level tokenizers: the pattern of their pieces, and the characters that stand for bytes.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_INS = dict(zip(_PLAIN, _PLAIN)) | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


def _by_word(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not spec.get("normalizer")


@functools.lru_cache(maxsize=8)
def doubtful(path: str) -> str:
    """The characters that a byte-level tokenizers file takes for another class than the patterns here do, as ranges of a character class.

    Letters, numbers, blanks and the rest: the library's tables are of another version of Unicode than Python's and the regex
    module's, and which characters differ changes with what is installed. So the library itself is asked, about all of
    them, once: those that the patterns take for one class stand in one text, which the library splits where it disagrees.
    Takes about three seconds; done on the driver and sent to the tasks.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        if not _by_word(json.load(file)):
            return ""
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    alone = lambda text: len(split(text)) == 1
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    blanks = {c for pattern in (re.compile(r"\s"), regex.compile(r"\s")) for c in pattern.findall(every)}
    odd = {c for c in blanks if not re.match(r"\s", c) or not regex.match(r"\s", c) or any(alone(x + c) for x in "a1!") or not alone(c + c)}
    rest = every.translate(dict.fromkeys(map(ord, blanks)))
    for pattern, known in ((r"\p{L}+", "a"), (r"\p{N}+", "1"), (r"[^\p{L}\p{N}]+", "!")):
        own = "".join(regex.findall(pattern, rest))
        for _, (start, end) in split(own):
            if not alone(known + own[start]):
                odd.update(own[start:end])
    odd.update(c for c in rest if c.isalpha() and not regex.match(r"\p{L}", c))
    codes = np.array(sorted(map(ord, odd)), np.int64)
    first = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
    last = np.append(first[1:] - 1, len(codes) - 1)
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip(first, last)) if len(codes) else ""


class _Words:
    """Ids of words as little-endian 32-bit bytes. Full, it becomes the old half and a new one starts."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead, self.young, self.old = encode, lead, {}, {}

    def one(self, word: str) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.encode(self.lead + word)
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def all(self, words: list[str]) -> list[bytes]:
        found = list(map(self.young.get, words))
        if None in found:
            one = self.one
            for i, x in enumerate(found):
                if x is None:
                    found[i] = one(words[i])
        return found


class Encoder:
    """Encodes whole texts with a tokenizers file, each different word once.

    A byte-level tokenizer splits before a space that a non-blank follows and around a line
    feed between non-blanks; of a longer run of blanks it splits off the last one, and that
    joins the next word if it is a space. So words and runs can be split into pieces by
    themselves, and the tokenizer's model encodes each new piece. Texts with an added token's
    string or a character of `odd` (see doubtful) are encoded in one call; so are all texts for tokenizers of another kind.
    """

    def __init__(self, path: str, odd: str | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _by_word(spec)
        odd = doubtful(path) if odd is None else odd
        self.odd = re.compile(f"[{odd}]") if odd else re.compile(r"(?!)")
        self.odd_ones = frozenset(chr(c) for x, y in re.findall(r"\\U(.{8})-\\U(.{8})", odd) for c in range(int(x, 16), int(y, 16) + 1))
        # two ranges are quick to look for, and most texts have nothing in them
        low, high = "".join(sorted(c for c in self.odd_ones if c < "\x80")), min((c for c in self.odd_ones if c >= "\x80"), default="")
        self.may_be_odd = re.compile("[" + re.escape(low) + (f"{high}-\U0010ffff" if high else "") + "]") if odd else self.odd
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.first, self.later = _Words(self._word, ""), _Words(self._word, " ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.removeprefix(" ").isalnum()
        spelled = piece.replace(" ", "\u0120") if plain else piece.encode().decode("latin-1").translate(_STAND_INS)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.removeprefix(" ").isalpha():
            return self._piece(word)
        pieces = _PIECES.findall(word)
        if len(pieces) == 1:
            return self._piece(word)
        # a word and its comma: the word may be known without it
        return b"".join([self.later.one(x[1:]) if x[0] == " " and len(x) > 1 else self.first.one(x) for x in pieces])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_word or not self.odd_ones.isdisjoint(self.may_be_odd.findall(text)) or any(x in text for x in self.added):
            return self.whole(text)
        first, out, lead = self.first.one, [], False
        parts = _BLANK_RUNS.split(text)
        for i in range(0, len(parts), 2):
            if parts[i]:
                self._body(parts[i], lead, out)
            if i + 1 < len(parts):
                run, rest = parts[i + 1], parts[i + 2]
                if not rest:  # the text ends in blanks
                    out.append(first(run))
                    break
                out.append(first(run[:-1]))
                lead = run[-1] == " "
                if not lead:
                    out.append(first(run[-1]))
        return b"".join(out)

    def _body(self, body: str, lead: bool, out: list[bytes]) -> None:
        """Text without two blanks in a row; lead: a space stands before it."""
        later, feed = self.later.all, self.first.one("\n")
        for i, line in enumerate(body.split("\n")):
            if i:
                out.append(feed)
            head, *rest = line.split(" ")
            if head:
                out.append((self.later if lead and not i else self.first).one(head))
            out += later(rest)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, odd: str) -> Encoder:
    """The worker's encoder for a file; its words stay for the next tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, odd)
    return _encoders[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = raw
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


MAGIC = b"TMIDS001"
BLOCK_IDS = 4096


class ShardWriter:
    """Blocks of BLOCK_IDS packed ids; then the documents' ids and starts and the blocks' offsets; then a footer."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.at = stream, bits, len(MAGIC)
        self.offsets, self.docs, self.starts = [], [], [0]
        self.held, self.n_held = [], 0
        stream.write(MAGIC)

    def add(self, doc_id: int | str | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            data = pack(ids[i : min(i + BLOCK_IDS, whole)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        known = np.array([x is not None for x in self.docs], np.uint8)
        text = any(isinstance(x, str) for x in self.docs)
        if text:  # ends of the ids as UTF-8, then their bytes
            raw = [(x or "").encode() for x in self.docs]
            docs = np.cumsum([len(x) for x in raw], dtype="<i8").tobytes() + b"".join(raw)
        else:
            docs = np.array([x or 0 for x in self.docs], "<i8").tobytes()
        tail = known.tobytes() + np.array(self.starts, "<u8").tobytes() + np.array([*self.offsets, self.at], "<u8").tobytes() + docs
        foot = json.dumps({"bits": self.bits, "block": BLOCK_IDS, "docs": len(self.docs), "text": text, "ids": self.starts[-1], "blocks": len(self.offsets), "tail": self.at}).encode()
        self.stream.write(tail + foot + len(foot).to_bytes(4, "little") + MAGIC)


class ShardReader:
    """Reads any range of ids of a shard; only the blocks that hold it are read."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        end = file.read_at(12, size - 12)
        if end[4:] != MAGIC:
            raise ValueError("not a shard of token ids, or cut short")
        n = int.from_bytes(end[:4], "little")
        foot = json.loads(file.read_at(n, size - 12 - n))
        self.bits, self.block, self.n_ids = foot["bits"], foot["block"], foot["ids"]
        tail = file.read_at(size - 12 - n - foot["tail"], foot["tail"])
        d = foot["docs"]
        known = np.frombuffer(tail, np.uint8, d)
        self.starts = np.frombuffer(tail, "<u8", d + 1, d).astype(np.int64)
        self.offsets = np.frombuffer(tail, "<u8", foot["blocks"] + 1, d + 8 * (d + 1)).astype(np.int64)
        at = d + 8 * (d + 1) + 8 * (foot["blocks"] + 1)
        docs = np.frombuffer(tail, "<i8", d, at).tolist()
        if foot["text"]:
            docs = [tail[at + 8 * d + a : at + 8 * d + b].decode() for a, b in zip([0, *docs], docs)]
        self.docs = [x if k else None for x, k in zip(docs, known.tolist())]

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        lo, hi = start // self.block, -(-end // self.block)
        data = self.file.read_at(int(self.offsets[hi] - self.offsets[lo]), int(self.offsets[lo]))
        out = []
        for b in range(lo, hi):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(data[self.offsets[b] - self.offsets[lo] : self.offsets[b + 1] - self.offsets[lo]], self.bits, n))
        return np.concatenate(out)[start - lo * self.block : end - lo * self.block]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | str | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, in order; ids_at_once bounds what a step holds besides one document."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids_at_once, side="right")) - 1)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield self.docs[k], int(self.starts[k]), ids[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j


def _open(path: str, how: str):
    fs, at = pafs.FileSystem.from_uri(path)
    if how == "r":
        return fs.open_input_file(at)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(at)


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> DataFrame:
    """Encodes every text, appends end_id, and writes shards in ascending id order. Returns their manifest.

    Texts are dealt by id range and sorted, and each task encodes and writes its range as one
    file with a name of its own in `to` (by default a new folder below spark.checkpoint.dir):
    a task that runs again writes another file, and only the file of the attempt that counts
    is in the manifest (`shard`, `path`, `id_type`, `n_docs`, `n_ids`). No text passes the driver.

    Ids of whole numbers are kept as such, others as strings, in the order of strings. Null ids come first; null and empty texts are the end id alone; equal ids are ordered by
    text. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    to = to or shared_dir(spark, "token-ids")
    bits = max(1, int(max(vocabulary_size(tokenizer_path) - 1, end_id)).bit_length())
    kind = "long" if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else "string"
    slim = docs.select(docs[id_col].cast(kind).alias("_id"), text_of(docs, text_col).alias("_text"))
    odd = doubtful(tokenizer_path)
    # rows of one id are dealt by the text's first characters, which keep the order of texts
    dealt = slim.repartitionByRange(n_ranges(slim, F.octet_length("_text")), "_id", F.substring("_text", 1, 64)).sortWithinPartitions("_id", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, out = TaskContext.get().partitionId(), encoder(tokenizer_path, odd), None
        path = f"{to}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.ids"
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in chunks(batch, "_text"):
                if out is None:
                    stream = _open(path, "w")
                    out = ShardWriter(stream, bits)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    out.add(doc_id, np.concatenate([np.frombuffer(enc.encode(text), "<u4"), end]))
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "id_type": kind, "n_docs": len(out.docs), "n_ids": out.starts[-1]}])

    ship(spark)
    return stage(dealt.mapInArrow(write, "shard long, path string, id_type string, n_docs long, n_ids long"), "token-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`."""
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.cast("long").alias("base"))
    first = manifest.select("id_type").first()
    kind = first.id_type if first else "long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with _open(path, "r") as file:
                    for doc_id, start, ids in ShardReader(file).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if kind == "string" else pa.int64(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(spark)
    n = max(1, manifest.count())
    return placed.repartition(n).mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
