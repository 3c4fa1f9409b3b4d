"""Word and shingle hashes against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from textwarden.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(text, width):
    """Distinct shingles of a text, as tuples."""
    w = WORD.findall(lowered(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def random_texts(n, seed, alphabet="abAB é\t\n\x0b\x0c\r.,ß \U0001f600"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


def test_shingles_equal_plain_ones():
    texts = [*random_texts(400, 1), None, "", " \t", "a", "A  b", "a b c", "x" * 5000, "Ä ä", "a b", "b a"]
    for width in (1, 3, 5):
        hashes = {}
        for t, row in zip(texts, W.shingle_rows(pa.array(texts, pa.string()), width, W.Hasher())):
            assert len(W.distinct(row)) == len(shingles(t, width))
            w = WORD.findall(lowered(t or ""))
            parts = [tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
            assert len(parts) == len(row)
            for x, h in zip(parts, row.tolist()):
                assert hashes.setdefault(x, h) == h
        assert len(set(hashes.values())) == len(hashes)


def test_pieces_and_slices_give_the_same(monkeypatch):
    texts = pa.array([*random_texts(200, 2), None, "", "q" * 300])
    whole = [h.tolist() for h in W.shingle_rows(texts, 3, W.Hasher())]
    monkeypatch.setattr(W, "PIECE", 64)
    assert [h.tolist() for h in W.shingle_rows(texts, 3, W.Hasher())] == whole
    assert [h.tolist() for h in W.shingle_rows(texts.slice(50, 60), 3, W.Hasher())] == whole[50:110]
    assert list(W.shingle_rows(texts.slice(0, 0), 3, W.Hasher())) == []


def test_distinct():
    assert W.distinct(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3]
    assert W.distinct(np.array([], np.int64)).tolist() == []
