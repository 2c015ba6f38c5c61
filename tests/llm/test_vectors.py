"""Neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from corpusmith.llm import vectors
from corpusmith.llm.vectors import Codes, nearest, search_queries

SCHEMA = "vec_id long, model string, dim int, vector array<float>"


def brute(rows, k, floor=-1.0, only=None):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[3] for r in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        if only is None or only(ids[i]):
            s = (x @ x[i]).round(9)
            best = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
            out[int(ids[i])] = {int(j) for v, j in best if -v >= floor}
    return out


def data(n=1500, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 5, dim))
    x = np.repeat(centres, 5, axis=0) + 0.15 * r.normal(size=(n, dim))
    x *= r.uniform(0.1, 9, size=(n, 1))
    return [(i, "m", dim, [float(v) for v in row]) for i, row in enumerate(x)]


def found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.vec_id, set()).add(r.neighbour)
    return out


def recall(got, want):
    return sum(len(got.get(i, set()) & w) for i, w in want.items()) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("cell", [64, 10_000])
def test_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    rows = data()
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), 4, 0.8))
    want = brute(rows, 4, 0.8)
    assert recall(got, want) > 0.98
    assert all(len(n) <= 4 and i not in n for i, n in got.items())


def test_query_set(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    rows = data(seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(search_queries(df, df.where("vec_id % 20 = 0"), 5))
    want = brute(rows, 5, only=lambda i: i % 20 == 0)
    assert set(got) == set(want) and recall(got, want) > 0.95


def test_large_cells_are_parted(monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 16)
    rows = data(600)
    ids, x = np.array([r[0] for r in rows]), np.array([r[3] for r in rows], dtype=np.float32)
    got: dict = {}
    for a, b, _ in vectors._cell(ids, x, None, 4, 0.8):
        got.setdefault(a, set()).add(b)
    assert recall(got, brute(rows, 4, 0.8)) > 0.97


def test_unusable_copies_and_ties(spark):
    good = [1.0, 2.0]
    rows = [(i, "m", 2, good) for i in range(12)] + [(3, "m", 2, good), (20, "m", 2, [2.0, 4.0]), (21, "other", 2, good), (22, "m", 3, [1.0, 2.0, 3.0])]
    rows += [(30, None, 2, good), (31, "m", None, good), (32, "m", 2, None), (33, "m", 2, [0.0, 0.0]), (34, "m", 2, [float("nan"), 1.0]), (35, "m", 2, [1.0]), (36, "m", 2, [None, 1.0]), (None, "m", 2, good), (37, "m", 2, [float("inf"), 1.0])]
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), 5, 0.5))
    assert got == {i: set([j for j in range(12) if j != i][:5]) for i in range(12)} | {20: {0, 1, 2, 3, 4}}
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(nearest(spark.createDataFrame([(1, "m", 2, good)], SCHEMA))) == {}


def test_codes_weigh_the_error_along():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = Codes.fit(x)
    plain = Codes(codes.words, 1.0)
    decode = lambda c: np.stack([codes.words[p][c[:, p]] for p in range(c.shape[1])], axis=1).reshape(len(c), -1)
    along = lambda c: np.abs(1 - (decode(c) * x).sum(axis=1)).mean()
    assert along(codes.encode(x)) <= along(plain.encode(x))
    q = x[:20]
    approx = Codes.scan(codes.tables(q), codes.pairs(codes.encode(x)))
    assert np.abs(approx - q @ decode(codes.encode(x)).T).max() < 1e-4 and np.corrcoef(approx.ravel(), (q @ x.T).ravel())[0, 1] > 0.9


def test_dense_groups_and_scaled_copies(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=16) + 0.05 * r.normal(size=(900, 16))
    x = np.concatenate([x, r.normal(size=(600, 16))])
    rows = [(i, "m", 16, [float(v) for v in row]) for i, row in enumerate(x)]
    want = brute(rows, 5, 0.88)
    monkeypatch.setattr(vectors, "CELL", 10_000)
    unit = vectors._unit(np.array([v[3] for v in rows], dtype=np.float32))
    got: dict = {}
    every = np.arange(len(rows))
    for a, b, _ in vectors._best(every, unit, every, every, Codes.fit(unit.astype(np.float32)), 5, 0.88):
        got.setdefault(a, set()).add(b)
    assert recall(got, want) > 0.99
    scaled = [(i, "m", 4, [float(v) for v in np.array([1.0, 2.0, -3.0, 0.5]) * 2.0 ** (i % 9)]) for i in range(60)]
    keys = vectors.directions(spark.createDataFrame(scaled, SCHEMA)).select("copy").distinct().count()
    assert keys == 1
    assert found(nearest(spark.createDataFrame(scaled, SCHEMA), 5, 0.5)) == {i: set([j for j in range(60) if j != i][:5]) for i in range(60)}


@pytest.mark.parametrize("most", [1, 4, 12])
def test_cells_are_parted_beyond_the_bound_on_centres(spark, monkeypatch, most):
    """Far more vectors than the centres that are broadcast have room for: cells get centres of their own."""
    monkeypatch.setattr(vectors, "CELL", 32)
    monkeypatch.setattr(vectors, "CENTRES", max(2, most))
    rows = data(n=3000, seed=most)
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), 4, 0.8))
    assert recall(got, brute(rows, 4, 0.8)) > 0.97
