"""Runs with a period against a plain search over all stretches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textwarden.llm import periodic as P
from textwarden.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(words, least=12):
    """All stretches that are runs, straight from the definition."""
    n, out = len(words), []
    for s in range(n):
        for e in range(s + least, n + 1):
            q = smallest_period(words[s:e])
            if e - s < 2 * q:
                continue
            if s > 0 and words[s - 1] == words[s - 1 + q]:
                continue
            if e < n and words[e] == words[e - q]:
                continue
            out.append((s, e - s, q))
    return out


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone), len(gone)


def word_lists(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < 8 or r.random() < 0.75 and len(words) < 45:
            p = [r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(1, 9))]
            k = r.randrange(1, 20)
            words += (p * k)[: r.randrange(1, len(p) * k + 1)][:30]
        yield words


def as_hashes(words):
    return W.Hasher(fold=False).words(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))


@pytest.mark.parametrize("block, long", [(1 << 20, 1 << 12), (40, 15)])
def test_runs_equal_the_definition(block, long, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "LONG", long)
    some = 0
    for words in word_lists(250, 1):
        h, begin = as_hashes(words)
        want = brute(words)
        some += len(want) > 1
        assert P.plain_runs(h) == want
        assert P.runs_of_texts(h, begin).get(0, []) == want
        assert not want or P.runs_of(h) == want
    assert some > 40


def test_other_least_length():
    for words in word_lists(60, 5):
        h, begin = as_hashes(words)
        assert P.runs_of_texts(h, begin, 5).get(0, []) == brute(words, 5)


def test_splitting_leaves_only_segments_of_repeated_words():
    words = "x a b a b a b a b a b a b y c c1 c c2 d d1 d d2 e e1 e e2 a a a a a a a a a a a a z".split()
    h, begin = as_hashes(words)
    left = [[words[i] for i in at] for at in P.split(h, np.zeros(len(h), int))]
    assert left == [["a", "b"] * 6, ["a"] * 12]
    assert P.runs_of_texts(h, begin)[0] == [(1, 12, 2), (26, 12, 1)]


def test_case_counts_and_runs_do_not_cross_texts():
    texts = ["a " * 11 + "A", "a " * 11, "a", "a " * 12, None, "", " \n"]
    (first, data, cuts), = W.pieces(pa.array(texts, pa.string()))
    words, begin = W.Hasher(fold=False).words(data, cuts)
    assert P.runs_of_texts(words, begin) == {3: [(0, 12, 1)]}


def test_windows_that_share_a_hash_do_no_harm(monkeypatch):
    """With hashes of few bits windows look alike that are not: the words decide."""

    class Weak(P.Windows):
        def same(self, a, lag, size):
            return super().same(a, lag, size) | ((a + lag) % 7 == 0)

    monkeypatch.setattr(P, "Windows", Weak)
    for words in word_lists(60, 3):
        h, _ = as_hashes(words)
        assert P.runs_of(h) == brute(words)


def test_long_texts_take_no_square_of_their_length():
    r = np.random.default_rng(1)
    n = 300_000
    one = np.zeros(n, np.uint64)
    assert P.runs_of(one) == [(0, n, 1)]
    half = r.integers(0, 1 << 60, n // 2).astype(np.uint64)
    assert P.runs_of(np.r_[half, half]) == [(0, n, n // 2)]
    prose = r.integers(0, 40, n).astype(np.uint64)
    prose[1000:1040], prose[999], prose[1040] = np.tile([1, 2, 3, 4], 10), 50, 51
    assert P.runs_of(prose) == [(1000, 40, 4)]


def odd_texts():
    r = random.Random(9)
    out = [" ".join(w) + r.choice(["", "\n", "  "]) for w in word_lists(60, 4)]
    out += [None, "", "\n", "a", "é ß " * 8, "\U0001f600 " * 13, "ab\tab\x0bab\x0cab\rab\nab " * 3, "x\x00 " * 12, "no run here"]
    return [*out, "w" * 100_000, "lorem ipsum " * 4000, *out[:5]]


@pytest.mark.parametrize("piece", [64, 1 << 19])
def test_table(spark, piece, monkeypatch):
    monkeypatch.setattr(W, "PIECE", piece)
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "runs long, text string, collapsed int")
    out = P.periodic_runs(docs.coalesce(1), "runs", "text").collect()
    for (key, text, _), got in zip(rows, out, strict=True):
        words = WORD.findall(text or "")
        want = brute(words) if len(words) < 200 else [(0, 8000, 2)]
        kept, gone = collapse(words, want)
        assert got["doc_id"] == key
        assert (got["n_words"], [tuple(x) for x in got["runs"]], got["n_dropped"], got["collapsed"]) == (len(words), want, gone, kept)


def test_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []


def test_query_follows_its_definition(spark):
    """op12 over the smallest tables, from the definition of its columns; runs by comparing all words at all lags."""
    import hashlib
    import zlib

    from textwarden.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = WORD.findall(d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        runs = P.plain_runs(np.array([numbers[w] for w in words], np.int64))
        r = got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        kept, gone = collapse(words, runs)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert (r["n_words"], r["n_dropped"]) == (n, gone)
    assert planted > 10
