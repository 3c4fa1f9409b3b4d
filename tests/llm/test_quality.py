"""Weights against a plain implementation; accuracy on texts not learnt from."""

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from textwarden.llm import quality as Q
from textwarden.llm.words import Hasher

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, y string"


def plain_ftrl(rows, epochs):
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if abs(zi) <= Q.L1:
            return 0.0
        return -(zi - math.copysign(Q.L1, zi)) / ((Q.BETA + math.sqrt(ni)) / Q.ALPHA + Q.L2)

    for _ in range(epochs):
        for y, at, x in rows:
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i, xi, wi in zip(at, x, w):
                g = (p - y) * xi
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / Q.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_updates_equal_plain_ones():
    r = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        at = np.sort(r.choice(20, 5, replace=False))
        rows.append((int(at[0] % 2), at, r.random(5)))
    want = plain_ftrl([(y, at.tolist(), x.tolist()) for y, at, x in rows], 3)
    got = Q.learn(rows, 3)
    assert max(abs(got[i] - w) for i, w in want.items()) < 1e-9


def test_features_do_not_depend_on_neighbours():
    texts = ["One two, two three!", None, "", "x", "THE!! END!!", "a b c d e f g", "12 34 Ab9 é"]
    together = [b.tolist() for b in Q.feature_rows(pa.array(texts), Hasher())]
    alone = [next(Q.feature_rows(pa.array([t], pa.string()), Hasher())).tolist() for t in texts]
    assert together == alone
    assert [len(x) for x in together][1:4] == [0, 0, 2]
    words = 7  # n-grams of the reading and the shapes, and one mark per neighbouring pair
    assert len(together[5]) == words + (words - 1) + words + (words - 1) + (words - 2) + (words - 1)


def test_learns_and_scores(spark):
    rows = [(i, ("good clean words here " if i % 2 else "BAD!! LOUD!! WORDS!! ") * (1 + i % 5), "", "") for i in range(200)]
    rows += [(900, None, "", ""), (901, "", "", ""), (None, "good clean words", "", ""), (902, "x " * 100_000, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, i % 2, "t") for i in range(160)] + [(5, None, "t"), (None, 1, "t"), (7, 1, "t"), (9999, 0, "t")]
    weights = Q.train(docs, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, quality int, text string"), "doc_id", "quality")
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, {"doc_id": "doc_id"}, "text", weights).collect()}
    assert len(got) == 204 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(160, 200))
    assert got[900] == got[901]


def test_shards_without_rows_do_not_shrink_the_weights(spark):
    """Two labelled rows fill two shards at most: the mean is over those that learnt."""
    docs = spark.createDataFrame([(1, "good clean words", "", ""), (2, "BAD!! LOUD!!", "", "")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    weights = Q.train(docs, "doc_id", "text", labels, "doc_id", "quality")
    # all fall into one shard or into two: learn each way by hand
    rows = [(y, *next(Q.features(pa.array([t]), Hasher()))) for y, t in ((1, "good clean words"), (0, "BAD!! LOUD!!"))]
    ways = [Q.learn(rows), Q.learn(rows[::-1]), (Q.learn(rows[:1]) + Q.learn(rows[1:])) / 2]
    assert any(np.allclose(weights, w) for w in ways)


def test_score_is_a_plain_dot_product(spark):
    r = np.random.default_rng(3)
    weights = np.where(r.random(Q.SPACE + 1) < 0.5, r.normal(size=Q.SPACE + 1), 0.0)
    texts = ["One two, two three!", None, "", "x", "THE!! END!! the end", "a b c d e f g " * 300, "12 34 Ab9 é"]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, {"doc_id": "doc_id"}, "text", weights).collect()}
    for i, t in enumerate(texts):
        buckets = next(Q.feature_rows(pa.array([t], pa.string()), Hasher())).tolist()
        dot = sum(weights[b] * Q.SCALE / len(buckets) for b in buckets) + weights[Q.SPACE]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-35.0, min(35.0, dot))))) < 1e-9


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = Q.train(docs, "doc_id", "text", none, "doc_id", "quality")
    assert Q.score(docs, {"doc_id": "doc_id"}, "text", weights).first()["score"] == 0.5
    assert Q.score(docs.limit(0), {"doc_id": "doc_id"}, "text", weights).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 10)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert Q.sample(labels, "doc_id", "quality").count() == 10


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_accuracy_on_held_out_texts(spark):
    got = entry.queries()["op8_quality_score"](spark, SF).filter("held_out")
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = (np.array([r["score"] for r in rows if r["quality"] == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
