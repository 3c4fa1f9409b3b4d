"""Leaks against plain containment."""

import random

import pytest

from tests.llm.test_words import shingles
from textwarden.llm import decontaminate as D

DOCS = "doc_id long, text string, tokens string, n string, item_id string"
ITEMS = "item_id long, text string, n string"


def brute(docs, items, width, percent):
    out = []
    sets = [(i, shingles(t, width)) for i, t in items]
    for d, t in docs:
        have = shingles(t, width)
        out += [(d, i, len(have & s), len(s)) for i, s in sets if s and 100 * len(have & s) >= percent * len(s)]
    return sorted(out, key=str)


def found(spark, docs, items, width=5, percent=80):
    d = spark.createDataFrame([(*x, "a", "b", "c") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "a") for x in items], ITEMS)
    got = D.leaks(d, "doc_id", "text", i, "item_id", "text", width, percent).collect()
    return sorted((tuple(r) for r in got), key=str)


def world(seed):
    """Items of very different sizes; documents hold whole items, cut ones, many or none."""
    r = random.Random(seed)
    text = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    items = [text(r.choice([1, 3, 5, 6, 12, 40, 150])) for _ in range(60)]
    items += [items[3], items[7][:-1] + ["z"]]
    docs = []
    for _ in range(80):
        d = text(r.randrange(60))
        for _ in range(r.choice([0, 1, 1, 2])):
            item = r.choice(items)
            cut = r.randrange(len(item)) if r.random() < 0.5 else len(item)
            d += item[:cut] + text(r.randrange(5))
        docs.append(d)
    docs.append([w for item in items for w in [*item, "x"]])  # everything at once
    docs.append([w for item in items for w in [*item[: len(item) * 9 // 10], "y"]])
    say = lambda rows: [(i, " ".join(w)) for i, w in enumerate(rows)]
    return say(docs), say(items)


@pytest.mark.parametrize("width,percent", [(5, 80), (3, 50), (1, 100)])
def test_equals_plain_containment(spark, width, percent):
    docs, items = world(width)
    assert found(spark, docs, items, width, percent) == brute(docs, items, width, percent)


def test_odd_rows(spark):
    say = " ".join(f"q{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, say), (3, say), (None, "x " + say.upper() + " y"), (4, "a b"), (5, "z " * 50_000 + say)]
    items = [(1, None), (2, ""), (3, say), (4, "a b"), (None, say), (3, say)]
    assert found(spark, docs, items) == brute(docs, items, 5, 80)
    assert found(spark, docs, []) == [] and found(spark, [], items) == []


def test_clean_drops_what_leaks(spark):
    docs, items = world(8)
    d = spark.createDataFrame([(*x, "a", "b", "c") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "a") for x in items], ITEMS)
    kept = D.clean(d, "doc_id", "text", i, "item_id", "text")
    gone = {x[0] for x in brute(docs, items, 5, 80)}
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [x for x, _ in docs if x not in gone]


def test_bands_miss_almost_nothing():
    for upper, n in ((1, 1), (64, 40), (256, 64)):
        b = D.bands(upper, n, 80)
        s = min(1.0, 0.8 / (upper / n + 0.2))
        assert (1 - s) ** b <= D.MISS * 1.0001
