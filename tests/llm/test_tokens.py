"""Token counts against plain greedy longest match."""

import random
from pathlib import Path

import pytest

from textwarden.llm import tokens as T
from textwarden.llm.queries import PIECES


def greedy(word, initial, continuing):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at, pieces = n + 1, end, continuing
    return n


def test_equals_greedy_matching():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    for _ in range(60):
        initial = {"_" + word(r.randrange(4)) for _ in range(6)} | ({"_"} if r.random() < 0.5 else set())
        continuing = {word(r.randrange(1, 5)) for _ in range(8)} | (set("abc") if r.random() < 0.5 else set())
        trie = T.matcher(sorted(initial), sorted(continuing))
        for _ in range(60):
            w = "_" + word(r.randrange(1, 14))
            assert T.word_length(w, *trie) == greedy(w, initial, continuing), (w, initial, continuing)


def test_linear_in_the_word():
    trie = T.matcher(["_", "_" + "a" * 200], ["a", "a" * 100 + "b"])
    assert T.word_length("_" + "a" * 50_000, *trie) == 1 + 50_000 - 200


@pytest.mark.skipif(not Path(PIECES).exists(), reason="no vocabulary here")
def test_counts_of_a_table(spark):
    initial, continuing = T.read_pieces(PIECES)
    texts = [None, "", " \n", "The house", "the  the\tthe", "\U0001f600\U0001f680", "xyzzy" * 2000, "Straße naïve"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the", "x"), (3, "The house", "")],
                                 "doc_id long, text string, n_tokens string")
    got = T.token_counts(docs, "doc_id", "text", initial, continuing).collect()
    assert len(got) == 10
    first, rest = set(initial), set(continuing)
    by_id = dict(enumerate(texts)) | {None: "the"}
    for r in got:
        parts = (by_id[r["doc_id"]] or "").split()
        assert r["n_words"] == len(parts)
        if len(by_id[r["doc_id"]] or "") < 100:
            assert r["n_tokens"] == sum(greedy("▁" + w, first, rest) for w in parts)
    assert T.token_counts(docs.limit(0), "doc_id", "text", initial, continuing).count() == 0


def test_long_words_are_counted_and_not_kept(spark, monkeypatch):
    """Words of any length, met again, with a memory of few short words."""
    monkeypatch.setattr(T, "KNOWN_WORDS", 3)
    monkeypatch.setattr(T, "KNOWN_SIZE", 4)
    initial, continuing = ["▁a", "▁ab", "▁"], ["a", "b", "ab", "abab"]
    texts = ["ab" * 5000 + " " + "ab" * 5000, "a b ab " * 200, "abab\u00a0abab\u2003x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in T.token_counts(docs, "doc_id", "text", initial, continuing).collect()}
    trie = T.matcher(initial, continuing)
    for i, t in enumerate(texts):
        assert got[i] == (len(t.split()), sum(T.word_length("▁" + w, *trie) for w in t.split()))
