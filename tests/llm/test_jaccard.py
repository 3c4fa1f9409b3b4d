"""Components against all pairs in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_words import shingles
from textwarden.llm import jaccard as J
from textwarden.llm.components import components

SCHEMA = "doc_id long, text string, n string, token string, component string"


def brute(rows, width, percent):
    """component per row position; rows: (id, text)."""
    sets = [shingles(t, width) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    at[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return [(d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows)]


def joined(spark, rows, width, percent):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return [tuple(r) for r in J.jaccard_join(df, "doc_id", "text", width, percent).collect()]


def near_copies(r, n, words):
    """Originals with copies that differ by a few words, and copies of copies."""
    texts = []
    for _ in range(n):
        w = [f"w{r.randrange(words)}" for _ in range(r.randrange(1, 120))]
        texts.append(w)
        for _ in range(r.randrange(4)):
            c = list(r.choice(texts[-3:]))
            for _ in range(r.randrange(1, 4)):
                c[r.randrange(len(c))] = f"w{r.randrange(words)}"
            texts.append(c)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("width,percent,words", [(3, 90, 3000), (5, 80, 3000), (1, 70, 12), (2, 50, 40)])
def test_equals_all_pairs(spark, width, percent, words):
    r = random.Random(width * percent)
    texts = near_copies(r, 40, words)
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert sorted(joined(spark, rows, width, percent)) == sorted(brute(rows, width, percent))


def test_one_large_group_and_shared_passages(spark):
    r = random.Random(9)
    passage = " ".join(f"licence{i}" for i in range(60))
    first = [f"a{i}" for i in range(80)]
    texts = []
    for i in range(120):  # near copies of one text, far from each other
        c = list(first)
        for _ in range(2):
            c[r.randrange(80)] = f"new{i}x{r.randrange(9)}"
        texts.append(" ".join(c))
    texts += [" ".join(first)] * 30
    texts += [passage + " " + " ".join(f"own{i}y{j}" for j in range(1 + i % 20)) for i in range(60)]
    texts += [passage] * 5
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert sorted(joined(spark, rows, 3, 90)) == sorted(brute(rows, 3, 90))


def test_odd_rows(spark):
    rows = [(7, None), (3, ""), (9, " \t\n"), (5, "a b"), (4, "A  b"), (6, "b a"), (8, "x " * 30_000), (2, "x " * 20_000),
            (5, "a b"), (1, "one two three four"), (11, "one two three four")]
    want = {(7, 0, 7), (3, 0, 3), (9, 0, 9), (5, 1, 4), (4, 1, 4), (6, 1, 6), (8, 1, 2), (2, 1, 2), (1, 2, 1), (11, 2, 1)}
    got = joined(spark, [*rows, (None, "a b"), (None, "nobody else says this")], 3, 90)
    assert len(got) == len(rows) + 2
    assert set(got) == want | {(None, 1, 4), (None, 2, None)}
    assert joined(spark, [], 3, 90) == []
    assert joined(spark, [(1, None)], 3, 90) == [(1, 0, 1)]


def test_last_round_finds_all_that_hubs_miss(spark, monkeypatch):
    texts = near_copies(random.Random(5), 40, 3000)
    monkeypatch.setattr(J, "_hub_pairs", lambda rows, percent: rows.selectExpr("id AS a", "id AS b").limit(0))
    rows = list(enumerate(texts))
    assert sorted(joined(spark, rows, 3, 90)) == sorted(brute(rows, 3, 90))


def test_parities_bound_the_difference():
    r = random.Random(8)
    for _ in range(200):
        x = {r.getrandbits(64) - (1 << 63) for _ in range(r.randrange(1, 400))}
        y = {t for t in x if r.random() < 0.8} | {r.getrandbits(64) - (1 << 63) for _ in range(r.randrange(300))}
        p, q = (J.parity(np.array(sorted(s), np.int64)) for s in (x, y))
        assert J.apart(p, q) == J.apart(q, p) <= len(x ^ y)
        assert J.apart(p, p) == 0


def test_prefix_holds_a_shared_shingle():
    for percent in (50, 80, 90, 100):
        for n in range(1, 60):
            least = (n * percent + 99) // 100  # of n that a linking set must share
            assert J.prefix_length(n, percent) == n - least + 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict((r[0], r[1]) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width,percent,words", [(3, 90, 3000), (1, 70, 12)])
def test_all_pairs_and_their_counts(spark, width, percent, words):
    r = random.Random(width + percent)
    texts = near_copies(r, 25, words)
    base = [f"g{i}" for i in range(60)]
    texts += [" ".join([*base[:i], f"other{i}", *base[i + 1 :]]) for i in range(12)]  # one component of many pairs
    texts += [texts[-1], texts[0], texts[0], "", " "]
    rows = list(enumerate(texts))
    sets = [shingles(t, width) for t in texts]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.add((j, i))
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows] + [(None, texts[0], "x", "y", "z")], SCHEMA)
    got = [tuple(x) for x in J.jaccard_pairs(df, "doc_id", "text", width, percent).collect()]
    leader = [next(j for j in range(len(sets)) if sets[j] == s) for s in sets]
    copies = {(leader[i], i) for i in range(len(sets)) if sets[i] and leader[i] != i}
    links = {(i, j) for i, j in want if leader[i] == i and leader[j] == j and sets[i] != sets[j]}
    assert len(got) == len(set(got)) and set(got) == {(*x, "link") for x in links} | {(*x, "copy") for x in copies}
    degree = [sum(i in x for x in want) for i in range(len(sets))]
    counts = [tuple(x) for x in J.link_counts(df, "doc_id", "text", width, percent).collect()]
    expected = [(i, len(s), degree[i]) for i, s in enumerate(sets)] + [(None, len(sets[0]), degree[0] + 1)]
    assert sorted(counts, key=str) == sorted(expected, key=str)


def test_a_pair_meets_about_once_and_none_is_lost(spark):
    """Near copies below the threshold: a group of texts that differ from one text in a passage each."""
    r = random.Random(2)
    base, texts = [f"b{i}" for i in range(120)], []
    for i in range(60):
        size = r.randrange(3, 6)
        at = r.randrange(120 - size)
        texts.append(" ".join([*base[:at], *[f"own{i}x{j}" for j in range(size)], *base[at + size :]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, _, leaders = J.classed(df, "doc_id", "text", 5, 80)
    named = leaders.selectExpr("doc_id AS id", "n", *J.SKETCH, "posexplode(prefix) AS (pos, token)")
    every = named.selectExpr("*", "id AS component", "0.0 AS central", "CAST(array() AS array<long>) AS early")
    kept = J.shared_tokens(leaders).withColumn("component", F.col("id"))
    before, after = (J._meetings(x, 80) for x in (every, kept))
    assert sorted(before.distinct().collect()) == sorted(after.distinct().collect())
    pairs = after.distinct().count()
    assert pairs > 200 and after.count() <= 1.5 * pairs and 3 * pairs < before.count()
    rows = list(enumerate(texts))
    assert sorted(joined(spark, rows, 5, 80)) == sorted(brute(rows, 5, 80))


def test_lists_of_the_same_shingles(spark):
    """One shingle per list of documents stays: the first in the order, in all of them."""
    at = {1: "abcd", 2: "abcd", 3: "bd", 4: "xd", 5: "x", 6: "y"}
    rows = [(i, 10, p, ord(t)) for i, ts in at.items() for p, t in enumerate(ts)]
    got = J.posting_lists(spark.createDataFrame(rows, "id long, n long, pos int, token long")).collect()
    assert {(chr(r["token"]), r["met"], r["many"]) for r in got} == {("a", 2, 2), ("b", 3, 1), ("d", 4, 1), ("x", 2, 1)}
