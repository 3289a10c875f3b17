"""Whitening against eigenvectors of the exact covariance."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening

NAN, INF = float("nan"), float("inf")


def plain(vectors):
    """n, exact deviations, eigenvalues and eigenvectors by falling eigenvalue."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    dev = [sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for v in x]
    a = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for v in x])
    e, vectors = np.linalg.eigh(a.T @ a / n)
    return n, dev, a, e[::-1], vectors[:, ::-1]


def make(n=400, d=12, seed=1):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * (0.5 ** np.arange(d))
    return (r.normal(size=(n, d)) @ mix + 3).astype(np.float32).tolist()


@pytest.mark.parametrize("block", [whitening.BLOCK, 40])
def test_whitening(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    vectors = make()
    bad = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [NAN], [INF] + [1.0] * 11, [1.0] * 5, [1e30] + [0.0] * 11]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(10_000 + i, v) for i, v in enumerate(bad)] + [(None, vectors[3])] * 2
    used = [*vectors, vectors[3], vectors[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(11).withColumns({c: F.lit("clash") for c in ("id", "vector", "n", "whitened", "component")})
    found = whitening.digest(whitening.whiten(df)).collect()
    n, dev, a, e, v = plain(used)
    assert len(found) == 8 * n and {x.n for x in found} == {n}
    assert len({x.identity_error for x in found}) == 1 and found[0].identity_error < 1e-9
    by = {}
    for x in found:
        by.setdefault(x.vec_id, {}).setdefault(x.component, []).append(x)
        assert x.explained == pytest.approx(e[x.component - 1] / e.sum(), rel=1e-9)
    assert all(x.deviation == dev[400] for xs in by[None].values() for x in xs) and len(by[None][1]) == 2
    for c in range(1, 9):
        got = np.array([by[i][c][0].whitened for i in range(400)])
        want = (a @ v[:, c - 1] / np.sqrt(e[c - 1]))[:400]
        assert np.allclose(got * np.sign(got @ want), want, atol=1e-7)
    assert [by[i][1][0].deviation for i in range(400)] == dev[:400]


def test_degenerate_tables(spark):
    of = lambda rows: whitening.digest(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert of([]) == [] and of([(1, None), (2, [NAN])]) == []
    assert [(x.component, x.deviation, x.whitened, x.explained, x.identity_error) for x in of([(1, [1.0, 2.0])] * 3)] == [(c, 0, None, None, None) for c in (1, 2)] * 3
    line = of([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    assert {(x.component, x.whitened is None) for x in line} == {(1, False), (2, True), (3, True)}
    assert [x.explained for x in line[:3]] == pytest.approx([1, 0, 0], abs=1e-12) and line[0].identity_error < 1e-12


def test_sums_beyond_64_bits(spark):
    r = random.Random(3)
    vectors = [[r.uniform(-1e15, 1e15), r.uniform(-5, 5)] for _ in range(300)]
    found = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)).collect()
    n, dev, *_ = plain(vectors)
    assert {x.vec_id: None if x.deviation is None else int(x.deviation) for x in found} == {i: t if t < 10**38 else None for i, t in enumerate(dev)}
    assert whitening.digest(spark.createDataFrame(found, whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).schema)).filter("deviation is null").count() == 600
