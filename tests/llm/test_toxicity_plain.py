"""The toxicity score against a plain version of its features, their choice, the descent and the score."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import common, toxicity


def parts(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return {("whole", w.encode()) for w in found} | {("stem", w.encode()[:5]) for w in found if len(w.encode()) > 5}


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain(rows, labels):
    known = {}
    for i, v in labels:
        if i is not None and v is not None and not out(i):
            known[i] = max(known.get(i, 0), v)
    prior = min(0.5, max(0.005, sum(v == 1 for v in known.values()) / len(known)))
    inside = [(i, parts(t)) for i, t in rows if i is not None and not out(i)]
    toxic = [f for i, f in inside if known.get(i) == 1]
    df_p, df_u = Counter(x for f in toxic for x in f), Counter(x for _, f in inside for x in f)
    chosen = []
    for x in df_u:
        p, u = (df_p[x] + 0.5) / (len(toxic) + 1), (df_u[x] + 0.5) / (len(inside) + 1)
        if (p - u) / math.sqrt(p * (1 - p) / len(toxic) + u * (1 - u) / len(inside)) >= 2.5 and prior * p >= 0.4 * u:
            chosen.append(x)
    place = {x: k for k, x in enumerate(chosen)}
    by_id = {}
    for i, f in inside:
        by_id.setdefault(i, [place[x] for x in f if x in place])
    marked = [f for i, f in by_id.items() if known.get(i) == 1]
    every = list(by_id.values())
    n = len(chosen)
    w, m, v = [0.0] * n + [math.log(prior / (1 - prior))], [0.0] * (n + 1), [0.0] * (n + 1)
    sig = lambda z: 1 / (1 + math.exp(-z))
    for step in range(1, 151):
        z_p, z_u = ([sum(w[k] for k in f) + w[n] for f in group] for group in (marked, every))
        minus = sum(math.log1p(math.exp(z)) for z in z_u) / len(z_u) - prior * sum(math.log1p(math.exp(z)) for z in z_p) / len(z_p)
        g = [3e-4 * x for x in w[:n]] + [0.0]
        for group, z, of in ((marked, z_p, "p"), (every, z_u, "u")):
            for f, one in zip(group, z):
                s = sig(one) / len(group)
                d = (-prior / len(marked) if minus >= 0 else prior * s) if of == "p" else (s if minus >= 0 else -s)
                for k in [*f, n]:
                    g[k] += d
        for k in range(n + 1):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= 0.05 * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return [(i, out(i), sig(sum(w[place[x]] for x in parts(t) if x in place) + w[n])) for i, t in rows], chosen


def made(seed, n):
    r = random.Random(seed)
    plainly = [f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        words = [r.choice(plainly) for _ in range(25)] + [r.choice(["Vile", "scumbags", "IDIOTIC", "idiotically"]) for _ in range(2 * toxic)]
        r.shuffle(words)
        rows.append((i, " ".join(words) + r.choice([".", " né", "!"])))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows + [(None, "vile text"), (None, None), (n, ""), (n + 1, None), (0, rows[0][1])], labels + [(None, 1), (1, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_scores(spark, seed):
    rows, labels = made(seed, 500)
    expected, chosen = plain(rows, labels)
    assert {x for _, x in chosen} >= {b"vile", b"idiot"}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [(x.doc_id, x.held_out, x.score) for x in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()]
    key = lambda x: (repr(x[0]), round(x[2], 3))
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-4)


def test_texts_above_a_chunk(spark, monkeypatch):
    """A text of three megabytes has the features, and the score, of its distinct words."""
    rows, labels = made(1, 400)
    words = sorted({w for _, t in rows[:40] for w in (t or "").split()})
    long = " ".join(random.Random(5).choice(words) for _ in range(800_000)) + " vile"
    short = " ".join(sorted(set(long.split())))
    df = spark.createDataFrame([*rows, (9001, long), (9002, short)], "doc_id long, text string")
    assert len(long) > 3 * common.CHUNK_BYTES - 10**6
    got = {x.doc_id: x.score for x in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[9001] == pytest.approx(got[9002], abs=1e-12)


def test_staged_rows_are_removed(spark):
    kept = common.stage(spark.range(3), "to-remove")
    assert kept.count() == 3
    common.clear(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|does not exist"):
        spark.read.parquet(*kept.inputFiles()).count()
