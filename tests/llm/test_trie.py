"""The prefix trie against a plain version, node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import same, words

from tidemark.llm import common, trie


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * len(words(node[-1][1])) if node else 0
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(rebuilt[c]) == len(node))
        yield min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()


SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = [None, "", "hi", "hi there", "a b\tc\x0bd", "x y", "naïve 字 z"]


def make(seed, n, deep=0, hot=0):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(n * 2), n):
        turns = r.randint(1, 6)
        rows += [(c, None if t == 0 and c % 3 == 0 else t, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(TEXTS)) for t in range(turns)]
    for c in (0, 20, 40, 41):  # deep ones, two of them alike
        rows = [x for x in rows if x[0] != c] + [(c, t, "u", f"t{t // 2}" if c > 20 else f"d{c}") for t in range(deep)]
    rows = [x for x in rows if not 1000 <= x[0] < 1000 + hot]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(hot) for t in range(4)]
    r.shuffle(rows)
    return rows


def found(spark, rows, parts=5):
    return [tuple(x) for x in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]


@pytest.mark.parametrize("seed, n, deep, hot, blocks, pieces", [(1, 60, 5, 0, 1024, 256), (2, 90, 37, 120, 4, 7)])
def test_nodes(spark, monkeypatch, seed, n, deep, hot, blocks, pieces):
    monkeypatch.setattr(trie, "BLOCK_TURNS", blocks)
    monkeypatch.setattr(trie, "PIECE_IDS", pieces)
    if hot:
        monkeypatch.setattr(common, "HOT_KEYS", 12)
        monkeypatch.setattr(common, "RANGE_BYTES", 2000)
    rows = make(seed, n, deep, hot)
    same(found(spark, rows), list(plain(rows)))


def test_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE_BYTES", 3000)
    monkeypatch.setattr(trie, "BLOCK_TURNS", 16)
    rows = [(5, t, "u", "w " * (t % 3)) for t in range(400)] + [(c, t, "u", "w") for c in range(40) for t in range(2) if c != 5]
    same(found(spark, rows), list(plain(rows)))
    turns = trie.place_turns(spark.createDataFrame(rows, SCHEMA), *SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    assert sorted(x.at for x in turns.filter("conv_id = 5").collect()) == list(range(1, 401))


def test_empty_tables_null_ids_ties_and_clashing_columns(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []
    rows = [(7, 1, "u", "same")] * 5 + [(None, None, None, None), (27, None, None, None), (27, None, "u", "x")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("at", "words", "depth", "n_convs", "_g1", "_t1", "_turn")})
    same([tuple(x) for x in trie.prefix_trie(table).collect()], list(plain(rows)))


def test_conversations_without_turns_belong_to_the_root(spark):
    short = [c for c in range(400) if c % 20 and zlib.crc32(str(c).encode()) % 4][:6]
    rows = [(c, 0, "u", f"only {c}") for c in short]
    got = found(spark, rows)
    same(got, list(plain(rows)))
    assert any(x[1] == 0 and x[7] == hashlib.sha256(",".join(map(str, short)).encode()).hexdigest() for x in got)
