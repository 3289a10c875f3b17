"""SimHash near-dedup: fingerprints, exact tiled comparison, and groups of linked documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_chunks, meet, nest, row_key, ship, stage, unnest, utf8

TILE = 8192
BLOCK = 256
#: Bytes of fingerprints in a super-block of tiles, at most.
GROUP_BYTES = 32 << 20


def fingerprint(text: bytes, n_words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles (words: runs of bytes other than ASCII blanks)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - n_words, 0)
    digest = xxhash.xxh64_intdigest
    hashed = [digest(joined[s:e], seed) for s, e in zip(starts[: last + 1].tolist(), ends[min(n_words, len(words)) - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashed)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n_words: int = 4, seed: int = 42) -> DataFrame:
    """Per row: id, `_k1`, `_k2` and `_fp`, the fingerprint's bits as a long."""
    k1, k2 = row_key(docs, id_col, text_col)
    slim = docs.select(docs[id_col].alias("_id"), k1, k2, docs[text_col].cast("string").alias("_text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("_text"))
        raw = data.tobytes()
        found = [fingerprint(raw[s:e], n_words, seed) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        values = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], values], names=["_id", "_k1", "_k2", "_fp"])

    return map_chunks(slim, "_text", f"_id {dict(slim.dtypes)['_id']}, _k1 long, _k2 long, _fp long", work)


def _quarters(fps: np.ndarray) -> np.ndarray:
    """The population counts of the four 16-bit quarters, one row each."""
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """A lower bound of the distance between boxes of population counts, a's by b's.

    Population counts of any part differ by at most the part's distance, so that the sum over
    disjoint parts bounds the whole distance from below.
    """
    return np.maximum(0, np.maximum(lo_b[None] - hi_a[:, None], lo_a[:, None] - hi_b[None])).sum(axis=2)


def tiles(distinct: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints, ordered by population counts, as tiles of at most `tile`: id, box, packed bits."""
    count = lambda lo, width: F.bit_count(F.shiftrightunsigned("_fp", lo).bitwiseAND(F.lit((1 << width) - 1)))
    keyed = distinct.select("_fp", F.bit_count("_fp").alias("_all"), *[count(s, w).alias(f"_c{s}_{w}") for s, w in ((0, 32), (0, 16), (32, 16))])
    order = ["_all", "_c0_32", "_c0_16", "_c32_16", "_fp"]
    dealt = keyed.repartitionByRange(max(1, -(-n // tile)), *order).sortWithinPartitions(*order).select("_fp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def out(fps: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            q = _quarters(fps)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([q.min(0).astype("<i2").tobytes() + q.max(0).astype("<i2").tobytes()]), pa.array([fps.tobytes()])],
                names=["_tile", "_box", "_packed"],
            )

        for batch in batches:
            held.append(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
            while sum(map(len, held)) >= tile:
                fps = np.concatenate(held)
                yield out(fps[:tile])
                held = [fps[tile:]]
        if sum(map(len, held)):
            yield out(np.concatenate(held))

    ship(distinct.sparkSession)
    return dealt.mapInArrow(pack, "_tile long, _box binary, _packed binary")


def _boxes(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    box = np.frombuffer(b"".join(packed), "<i2").reshape(-1, 8).astype(np.int16)
    return box[:, :4], box[:, 4:]


def _near_in(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles (or in one): at most as many pairs as fingerprints.

    Every pair of blocks whose boxes are within the radius is compared bit by bit. A link
    whose ends are joined already adds nothing to the groups and is left out.
    """
    fps = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = np.arange(len(fps))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, edges = _quarters(x), np.arange(0, len(x), BLOCK)
        return np.minimum.reduceat(q, edges, axis=0), np.maximum.reduceat(q, edges, axis=0)

    out: list[tuple[int, int]] = []
    pairs = np.argwhere(_apart(*blocks(a), *blocks(b)) <= radius)
    for i, j in pairs.tolist():
        if same and j < i:
            continue
        x, y = a[i * BLOCK : (i + 1) * BLOCK], b[j * BLOCK : (j + 1) * BLOCK]
        u, v = np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= radius)
        u, v = u + i * BLOCK, v + j * BLOCK + shift
        new = parent[u] != parent[v]
        if not new.any():
            continue
        for s, t in zip(u[new].tolist(), v[new].tolist()):
            p, q = find(s), find(t)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((s, t))
        while True:  # each points at its root again
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return [(int(fps[s]), int(fps[t])) for s, t in out]


def _group_size(n_tiles: int, parallelism: int) -> int:
    """Tiles of a super-block: few enough for GROUP_BYTES, and for several pairs of super-blocks a core."""
    n_groups = max(math.isqrt(32 * parallelism), -(-n_tiles * TILE * 8 // GROUP_BYTES))
    return max(1, -(-n_tiles // n_groups))


def near_links(distinct: DataFrame, n: int, radius: int = 4, tile: int = TILE, group: int | None = None) -> DataFrame:
    """Links (`_u`, `_v`) between distinct fingerprints that join all that are `radius` bits apart or less.

    Tiles are dealt as super-blocks of `group` neighbours in the order of population counts. A
    tile goes once to each pair of super-blocks where a tile is near enough to be compared with
    it, and a task compares the near tiles of one pair of super-blocks: tiles are copied as often
    as there are super-blocks, not as often as there are tiles, and a task holds two super-blocks.
    What the driver and each task hold for all tiles is 24 bytes a tile, 3 bytes a thousand
    fingerprints.
    """
    spark = distinct.sparkSession
    made = stage(tiles(distinct, n, tile), "simhash-tiles")
    meta = made.select("_tile", "_box").orderBy("_tile").toPandas()
    ids = meta["_tile"].to_numpy(np.int64)
    lo, hi = _boxes(meta["_box"].map(bytes).tolist()) if len(ids) else (np.zeros((0, 4), np.int16),) * 2
    size = group or _group_size(len(ids), spark.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, mine in enumerate(batch.column(0).to_pylist()):
                k = int(np.searchsorted(ids, mine))
                others = np.unique(np.flatnonzero(_apart(lo[k : k + 1], hi[k : k + 1], lo, hi)[0] <= radius) // size)
                own = np.full(len(others), k // size)
                packed = batch.column(1).take(pa.array(np.full(len(others), i)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(own, others)), pa.array(np.maximum(own, others)), pa.array(np.full(len(others), k)), packed], names=["_i", "_j", "_k", "_packed"]
                )

    def compared(i: int, j: int, held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        left, right = ([k for k in held if k // size == x] for x in (i, j))
        for k in left:
            near = [x for x in right if x >= k]
            for x in np.array(near, np.int64)[_apart(lo[k : k + 1], hi[k : k + 1], lo[near], hi[near])[0] <= radius].tolist() if near else ():
                found = _near_in(held[k], held[x], k == x, radius)
                if found:
                    u, v = np.array(found, np.uint64).view(np.int64).reshape(-1, 2).T
                    yield pa.RecordBatch.from_arrays([pa.array(u.copy()), pa.array(v.copy())], names=["_u", "_v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for i, j, k, packed in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (i, j) != now:
                    if held:
                        yield from compared(*now, held)
                    now, held = (i, j), {}
                held[k] = np.frombuffer(packed, np.uint64)
        if held:
            yield from compared(*now, held)

    ship(spark)
    dealt = made.select("_tile", "_packed").mapInArrow(deal, "_i long, _j long, _k long, _packed binary")
    n_groups = -(-len(ids) // size)
    width = min(10_000, max(2 * spark.sparkContext.defaultParallelism, n_groups * (n_groups + 1)))
    return dealt.repartition(width, "_i", "_j").sortWithinPartitions("_i", "_j", "_k").mapInArrow(compare, "_u long, _v long")


def components(links: DataFrame) -> DataFrame:
    """Groups of linked nodes: `_node`, `_root`, for every node that has a link.

    Each round hooks every node to its neighbour of the least hashed name, halves the paths,
    renames the ends of the links and drops those inside a group, so that links and nodes shrink
    together; a node of many links is reduced map-side, and looked up by broadcast where many links or nodes
    name it. Hashed names are in no order along any
    path, so that each round leaves a fraction of the nodes, whatever their names: rounds follow
    the logarithm of the longest path.
    """
    edges = stage(links.filter("_u <> _v").select("_u", "_v"), "links")
    hashed = lambda a: F.struct(F.xxhash64(a).alias("h"), F.col(a).alias("x"))
    names = None
    while not edges.isEmpty():
        both = edges.select("_u", "_v").union(edges.select("_v", "_u"))
        hook = both.groupBy("_u").agg(F.min(hashed("_v")).alias("_v"), F.count("*").alias("_links"))
        hook = stage(hook.select(F.col("_u").alias("_n"), F.least(hashed("_u"), F.col("_v"))["x"].alias("_p"), "_links"), "hooks")
        pointed = hook.groupBy("_p").agg(F.count("*").alias("_w"))
        up = stage(hook.select(F.col("_n").alias("_p"), F.col("_p").alias("_pp")).join(pointed, "_p"), "hook-ends")
        hook = stage(meet(hook, up, ["_p"], "_w").select("_n", F.col("_pp").alias("_p"), "_links"), "hooks")
        to = lambda a: hook.select(F.col("_n").alias(a), F.col("_p").alias(f"{a}p"), "_links")
        if names is None:
            names = hook.select(F.col("_n").alias("_node"), F.col("_p").alias("_root"))
        else:
            used = stage(to("_root").drop("_links").join(names.groupBy("_root").agg(F.count("*").alias("_w")), "_root"), "roots")
            names = meet(names, used, ["_root"], "_w", "left").select("_node", F.coalesce("_rootp", "_root").alias("_root"))
        names = stage(names, "groups")
        edges = meet(meet(edges, to("_u"), ["_u"], "_links").drop("_links"), to("_v"), ["_v"], "_links").filter("_up <> _vp")
        edges = stage(edges.select(F.least("_up", "_vp").alias("_u"), F.greatest("_up", "_vp").alias("_v")).distinct(), "links")
    return edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_root")) if names is None else names


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """Per document row: id, `_k1`, `_k2`, `fingerprint` (16 hex digits), `_group`, `component_id`.

    `_group` names the group by one of its fingerprints. `component_id` is the smallest id of the documents reachable over links of `radius`
    differing bits or less (null only if all their ids are null). Equal fingerprints are one
    node, so that a group of copies, however large, is compared once.

    Null, empty and blank texts have fingerprint zero and link like any other. Texts of fewer
    than n_words words have one shingle, of all their words. Repeated rows share a result each.
    An empty table gives an empty table.
    """
    prints = stage(fingerprints(docs, id_col, text_col, n_words, seed), "fingerprints")
    smallest = stage(prints.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_copies")), "distinct")
    n = smallest.count()
    groups = components(near_links(smallest.select("_fp"), n, radius, tile))
    rooted = smallest.join(groups.withColumnRenamed("_node", "_fp"), "_fp", "left").select(
        "_fp", "_least", "_copies", F.coalesce("_root", "_fp").alias("_root")
    )
    rooted = stage(rooted, "rooted")
    least = stage(rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_members")), "least")
    named = stage(meet(rooted, least, ["_root"], "_members").select("_fp", "_root", "component_id", "_copies"), "named")
    # copies, empty texts among them, share a fingerprint; members of a large group its root
    return meet(prints, named, ["_fp"], "_copies").select(
        F.col("_id").alias(id_col), "_k1", "_k2", _hex("_fp").alias("fingerprint"), F.col("_root").alias("_group"), "component_id"
    )


def _hex(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id, then of the smallest key.

    Rows that agree in id and text are copies of each other: one stays. A group whose ids are
    all null keeps the row of the smallest key. Kept rows are unchanged.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    first = F.struct(F.col(id_col).isNull(), F.col(id_col), "_k1", "_k2")
    stay = found.groupBy("_group").agg(F.min(first).alias("_first")).select("_first._k1", "_first._k2")
    keyed = nest(docs, *row_key(docs, id_col, text_col)).join(stay.distinct(), ["_k1", "_k2"], "left_semi")
    return keyed.dropDuplicates(["_k1", "_k2"]).select(*unnest(docs.columns))
