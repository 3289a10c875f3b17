"""The prefix trie of conversations: nodes keyed by digests, subtree sums by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, meet, n_ranges, ship, stage

#: Turns of one conversation whose digests are chained in one task.
BLOCK_TURNS = 1024
#: Conversation ids of a piece of a node's list.
PIECE_IDS = 256
#: A rebuilt conversation takes the first of these turns from that with the next lower multiple of FAMILY as its id.
FAMILY = 20
MOST_SHARED = 3

NODE = ["_g1", "_g2"]
PARENT = ["_p1", "_p2"]


def _root() -> list[Column]:
    return [F.lit(0).cast("long").alias(c) for c in NODE]


def place_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row a turn: `conv_id`, `at` (its place from 1 in its conversation), `_t1`, `_t2` (hashes of role and text) and `words`.

    Turns are dealt by range of all their columns, so that a conversation of any length spreads over
    tasks; a turn's place is its rank in its range and the turns of its conversation in the ranges before. Only
    a range's first conversation has any of those, so that table has a row a range at most.
    """
    text, role = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (text_col, role_col))
    words = F.size(F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), ""))
    slim = stage(
        conversations.filter(conversations[conv_col].isNotNull()).select(
            conversations[conv_col].cast("long").alias("conv_id"), conversations[turn_col].alias("_turn"), role.alias("_role"),
            F.xxhash64(role, text).alias("_t1"), F.xxhash64(text, role, F.lit(11)).alias("_t2"), words.cast("long").alias("words"), F.monotonically_increasing_id().alias("_row"),
        ),
        "turns",
    )
    order = [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_t1"), F.col("_t2"), F.col("_row")]
    dealt = slim.repartitionByRange(n_ranges(slim, F.lit(64)), *order).sortWithinPartitions(*order)
    rows = stage(dealt.select("conv_id", "_t1", "_t2", "words", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_line")), "turns-in-order")
    part = rows.groupBy("_range", "conv_id").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begun = part.select("_range", "conv_id", F.coalesce(earlier, F.lit(0)).alias("_before"), "_first")
    # a (range, conversation) is at most a range's rows
    return rows.join(begun, ["_range", "conv_id"]).select("conv_id", (F.col("_line") - F.col("_first") + F.col("_before") + 1).alias("at"), "_t1", "_t2", "words")


def _shared(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (`conv_id`, `depth`, `_t1`, `_t2`, `words`, `last`), and the ids of all conversations with their rebuilt length.

    turns: place_turns' rows, staged. The first h turns of conversation c - c % FAMILY stand before c's own from h + 1
    on, h being the checksum of c's digits modulo MOST_SHARED + 1.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.filter((F.col("at") <= MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "_base")
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).withColumns({"_h": _shared(F.col("conv_id")), "_base": base})
    lent = heads.groupBy("_base").agg(F.count("*").alias("_has"))
    borrowed = F.least(F.coalesce("_has", F.lit(0)), F.col("_h"))  # FAMILY conversations to a base
    convs = stage(counted.join(lent, "_base", "left").select("conv_id", "_base", "_n", "_h", borrowed.alias("_borrowed")).withColumn("length", F.col("_borrowed") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))), "conversations")
    columns = ["conv_id", "depth", "_t1", "_t2", "words", (F.col("depth") == F.col("length")).alias("last")]
    front = convs.join(heads, "_base").filter("at <= _borrowed").withColumn("depth", F.col("at")).select(*columns)
    own = meet(turns, convs.select("conv_id", "_n", "_h", "_borrowed", "length"), ["conv_id"], "_n").filter("at > _h")
    return front.unionByName(own.withColumn("depth", F.col("at") - F.col("_h") + F.col("_borrowed")).select(*columns)), convs.select("conv_id", "length")


def digests(rebuilt: DataFrame) -> DataFrame:
    """rebuilt with the digest of the turns up to each (NODE) and of those before it (PARENT); the root's digest is 0, 0.

    A turn's hash has its depth in it, and a digest is the exclusive or of its turns' hashes: chained
    block by block, and then over a conversation's blocks.
    """
    hashed = rebuilt.select("conv_id", "depth", "words", "last", F.xxhash64("depth", "_t1", "_t2").alias("_h1"), F.xxhash64("_t2", "depth", "_t1", F.lit(3)).alias("_h2"), F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("_block"))
    hashed = stage(hashed, "rebuilt-turns")
    upto = Window.partitionBy("conv_id", "_block").orderBy("depth")
    inside = hashed.withColumns({"_b1": F.bit_xor("_h1").over(upto), "_b2": F.bit_xor("_h2").over(upto)})
    blocks = hashed.filter(F.col("depth") > 0).groupBy("conv_id", "_block").agg(F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "_block", F.bit_xor("_x1").over(before).alias("_c1"), F.bit_xor("_x2").over(before).alias("_c2")).filter("_block > 0")
    zero = F.lit(0).cast("long")
    found = inside.join(carried, ["conv_id", "_block"], "left").select(
        "conv_id", "depth", "words", "last", "_h1", "_h2", F.col("_b1").bitwiseXOR(F.coalesce("_c1", zero)).alias("_g1"), F.col("_b2").bitwiseXOR(F.coalesce("_c2", zero)).alias("_g2")
    )
    return found.select("conv_id", "depth", "words", "last", *NODE, F.col("_g1").bitwiseXOR(F.col("_h1")).alias("_p1"), F.col("_g2").bitwiseXOR(F.col("_h2")).alias("_p2"))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """NODE and values summed over each node's subtree, itself included.

    nodes: staged, with NODE, PARENT (null at roots), `depth` and values. After round k every
    node has the sum of its descendants nearer than 2**(k+1) and a pointer to its ancestor at that distance: in
    a round a node sends its sum along its pointer, and takes its target's pointer as its new one. Nodes
    without a target are done and leave; what reaches them later is added at the end. A tree of depth d takes log2(d)
    rounds. Sums are combined before they are shuffled, and pointers of often-named targets are broadcast.
    """
    stride, done = 1, []
    active = nodes.select(*NODE, *PARENT, "depth", *values)
    done.append(active.filter("depth < 1").select(*NODE, *values))
    active = active.filter("depth >= 1")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while stride <= deepest:
        sent = stage(active.groupBy(*[F.col(p).alias(g) for p, g in zip(PARENT, NODE)]).agg(F.first("depth").alias("_from"), F.count("*").alias("_senders"), *[F.sum(v).alias(f"_{v}") for v in values]), "sent")
        # a target less than a stride deep has left before this round
        done.append(sent.filter(F.col("_from") < 2 * stride).select(*NODE, *[F.col(f"_{v}").alias(v) for v in values]))
        arrived = sent.filter(F.col("_from") >= 2 * stride)
        grown = [(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values]
        now = stage(active.join(arrived, NODE, "left").select(*NODE, *PARENT, "depth", *grown, F.coalesce("_senders", F.lit(0)).alias("_senders")), "received")
        done.append(now.filter(F.col("depth") < 2 * stride).select(*NODE, *values))
        stride *= 2
        if stride <= deepest:
            targets = stage(now.filter("_senders > 0").select(F.col("_g1").alias("_p1"), F.col("_g2").alias("_p2"), F.col("_p1").alias("_to1"), F.col("_p2").alias("_to2"), "_senders"), "targets")
            jumped = meet(now.filter(F.col("depth") >= stride).drop("_senders"), targets, PARENT, "_senders")
            active = stage(jumped.select(*NODE, F.col("_to1").alias("_p1"), F.col("_to2").alias("_p2"), "depth", *values), "active")
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    return total.groupBy(*NODE).agg(*[F.sum(v).alias(v) for v in values])


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def end_hashes(ends: DataFrame) -> DataFrame:
    """NODE and `ends_sha256`: SHA-256 of the ascending ids of the conversations that end at a node, comma-joined.

    ends (NODE, conv_id) are dealt by range of node and id, so a node's ids spread over tasks, and each task
    joins its ids to pieces of PIECE_IDS. A node of one piece is hashed there. The pieces of a longer list
    stream through one hash in order: SHA-256 is serial, the task holds one batch.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def piece() -> dict:
            return {"_g1": at[0], "_g2": at[1], "_from": ids[0], "_piece": _joined(ids)}

        for batch in batches:
            rows = []
            for g1, g2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((g1, g2) != at or len(ids) == PIECE_IDS):
                    rows.append(piece())
                    ids = []
                at = g1, g2
                ids.append(conv)
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
        if ids:
            yield pa.RecordBatch.from_pylist([piece()])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            rows = []
            for g1, g2, text in zip(*(batch.column(c).to_pylist() for c in ("_g1", "_g2", "_piece"))):
                if (g1, g2) != at:
                    if state:
                        rows.append({"_g1": at[0], "_g2": at[1], "ends_sha256": state.hexdigest()})
                    at, state = (g1, g2), hashlib.sha256()
                    state.update(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
        if state:
            yield pa.RecordBatch.from_pylist([{"_g1": at[0], "_g2": at[1], "ends_sha256": state.hexdigest()}])

    ship(ends.sparkSession)
    order = [*NODE, "conv_id"]
    dealt = ends.select(*order).repartitionByRange(n_ranges(ends, F.lit(24)), *order).sortWithinPartitions(*order)
    pieces = stage(dealt.mapInArrow(cut, "_g1 long, _g2 long, _from long, _piece string"), "end-lists")
    counts = pieces.groupBy(*NODE).agg(F.count("*").alias("_n"))
    one = pieces.groupBy(*NODE).agg(F.count("*").alias("_n"), F.first("_piece").alias("_piece")).filter("_n = 1").select(*NODE, F.sha2(F.col("_piece").cast("binary"), 256).alias("ends_sha256"))
    many = counts.filter("_n > 1").select(*NODE)  # at most one node for each PIECE_IDS conversations and each range
    chained = pieces.join(many, NODE).repartition(*NODE).sortWithinPartitions(*NODE, "_from")
    return one.unionByName(chained.mapInArrow(chain, "_g1 long, _g2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of rebuilt conversations, a row a node: each distinct sequence of first turns (role and text), and the root.

    Columns: `conv_id` (smallest member), `depth`, `parent_conv_id` (null at the root), `n_convs`, `n_children`,
    `n_leaves`, `saved_tokens` and `ends_sha256`. saved_tokens are the words that sharing a node's last turn
    saves, (n_convs - 1) times its words, summed over the subtree. rebuild() says how conversations are
    rebuilt; one left without turns belongs to the root alone.

    Null roles and texts are empty. Null turn numbers come first. Turns of equal numbers are ordered by role, then by hashes
    of role and text; repeated rows are turns of their own. Rows without a conversation id belong to none and
    are left out. Other columns are ignored. An empty table gives no node, not even a root. Sequences are equal
    if two 64-bit hashes of them are.

    No group is held: turns are dealt by range, members and children are combined before they are
    shuffled, and tables that name a node often are met by broadcasting it.
    """
    turns = stage(place_turns(conversations, conv_col, turn_col, role_col, text_col), "placed-turns")
    rebuilt, convs = rebuild(turns)
    lines = stage(digests(rebuilt), "digests")
    top = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nothing = F.lit(None).cast("long")
    root = top.select(*_root(), nothing.alias("_p1"), nothing.alias("_p2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    below = lines.groupBy(*NODE).agg(
        *[F.min(c).alias(c) for c in (*PARENT, "conv_id", "depth")], F.count("*").alias("n_convs"), F.min("words").alias("words")
    )
    found = stage(below.select(*root.columns).unionByName(root), "nodes")
    children = stage(found.filter("depth > 0").groupBy(*[F.col(p).alias(g) for p, g in zip(PARENT, NODE)]).agg(F.count("*").alias("n_children")), "children")
    nodes = stage(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    own = nodes.select(*NODE, *PARENT, "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(stage(own, "own-values"), ["n_leaves", "saved_tokens"])
    ends = lines.filter("last").select(*NODE, "conv_id").unionByName(convs.filter("length = 0").select(*_root(), "conv_id"))
    hashes = end_hashes(stage(ends, "ends"))
    parents = stage(nodes.filter("n_children > 0").select(F.col("_g1").alias("_p1"), F.col("_g2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    named = meet(nodes.filter("depth > 0").drop("n_children").join(children, NODE, "left"), parents.withColumnRenamed("n_children", "_weight"), PARENT, "_weight")
    topmost = nodes.filter("depth = 0").withColumn("parent_conv_id", nothing)
    columns = [*NODE, "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children")]
    whole = named.select(*columns).unionByName(topmost.select(*columns)).join(sums, NODE).join(hashes, NODE, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


#: The same rows in DuckDB's SQL: the checksum byte by byte over its table, prefixes as hashes of all turns so far, subtrees by joining each node with the prefixes of its smallest member.
ORACLE_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), counted AS (SELECT conv_id, count(*) AS n, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS codes FROM turns GROUP BY conv_id),
summed AS (SELECT conv_id, n, xor(list_reduce(list_concat([4294967295::BIGINT], codes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h FROM counted, tab),
convs AS (SELECT c.conv_id, c.n, c.h, least(c.h, coalesce(b.n, 0)) AS borrowed FROM summed c LEFT JOIN counted b ON b.conv_id = c.conv_id - c.conv_id % 20),
rebuilt AS (
  SELECT c.conv_id, t.place AS d, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place <= c.borrowed
  UNION ALL SELECT c.conv_id, t.place - c.h + c.borrowed, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), keyed AS (
  SELECT conv_id, d, sha256(string_agg(sha256(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
), lines AS (
  SELECT conv_id, d, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS parent, words FROM keyed UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs
), nodes AS (SELECT key, min(conv_id) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(parent) AS parent, max(words) AS words FROM lines GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (key)),
sums AS (
  SELECT l.key, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words)::BIGINT AS saved_tokens FROM whole w JOIN lines l ON l.conv_id = w.conv_id AND l.d <= w.depth GROUP BY l.key
), ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(key, d) AS key FROM lines GROUP BY conv_id) GROUP BY key
)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM whole w JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON p.key = w.parent AND w.depth > 0
"""
