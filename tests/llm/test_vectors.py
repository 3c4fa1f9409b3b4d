"""Exact top-k against all products."""

import random

import numpy as np
import pytest

from textwarden.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, id string, v string"


def brute(rows, k):
    whole = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            whole.setdefault(i, []).append([int(np.floor(256 * float(np.float32(c)))) for c in x])
    out = {}
    for q in whole:
        if q % 50 == 0:
            ask = min(whole[q])
            scores = [(-sum(a * b for a, b in zip(ask, v)), i) for i, vs in whole.items() if i != q for v in vs]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def asked(spark, rows, k=5):
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows], SCHEMA)
    df = df.selectExpr("vec_id AS id", "embedding").select("id", V.quantised("embedding").alias("v"))
    out = {}
    for r in V.top_k(df, df.filter("id % 50 = 0"), k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in out:
        out[q].sort()
        assert [r for r, _, _ in out[q]] == list(range(1, len(out[q]) + 1))
    return {q: [(i, s) for _, i, s in x] for q, x in out.items()}


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_equals_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=6) * np.exp(spread * r.normal())).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(120)]  # one very common vector
    assert asked(spark, rows) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, [-1.0, 3.0, 9.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]),
            (4, [None, 1.0]), (None, [5.0, 5.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, []), (150, None), (7, [-0.001, 0.001])]
    assert asked(spark, rows) == brute(rows, 5)
    assert asked(spark, rows[:1]) == {}
    assert asked(spark, []) == {}


def test_large_numbers_stay_exact():
    a = np.array([[2**40 + 1, 2**30, -3], [1, 1, 1]], np.int64)
    q = np.array([2**20 + 1, 7, 5], np.int64)
    assert V.products(a, q).tolist() == [sum(int(x) * int(y) for x, y in zip(row, q)) for row in a]
    assert V.products(np.array([[2**62]]), np.array([2**10])).tolist() == [2**63 - 1]


def test_candidates_keep_all_that_reach_the_bound():
    r = np.random.default_rng(1)
    for _ in range(300):
        rows = r.integers(-40, 40, (60, 4)) * r.integers(1, 9, (60, 1))
        lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        rows, lengths = rows[order], lengths[order]
        q = r.integers(-40, 40, 4)
        scores = rows @ q
        bound = float(np.sort(scores)[-random.Random(int(q[0])).randrange(1, 20)])
        keep = np.zeros(60, bool)
        keep[V.candidates(lengths, rows / np.maximum(lengths, 1e-300)[:, None], q, bound)] = True
        assert keep[scores >= bound].all()
