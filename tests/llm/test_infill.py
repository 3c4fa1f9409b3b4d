"""Fill-in-middle against plain Python, and the way back."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textwarden.llm import infill as I
from textwarden.llm import words as W


def plain_form(key, text, seed=7, fim=100, spm=50):
    """(n, form, prefix, middle, output) by string operations."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y", "<S>", "<M>\n", "<P", "S>\n<", "a<\nP>", "<<\n>>\n<", "<P\n>",
    "é\nß\n\U0001f600\n", "\r\n\r\n", "<X>", "word " * 30_000, "line\n" * 20_000, "<P\n" * 50, ">\n<" * 50, "\x00\n\x00",
]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("ab<>PSM\n\né\U0001f600") for _ in range(r.randrange(60))) for _ in range(n)]


def check(rows, **draw):
    for r in rows:
        want = plain_form(r["doc_id"], r["text"], **draw)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["restored"] == (r["text"] or "")


@pytest.mark.parametrize("piece", [40, 1 << 19])
def test_pieces_equal_string_operations(piece, monkeypatch):
    monkeypatch.setattr(W, "PIECE", piece)
    given = [*texts(400, 1), *ODD]
    for first, data, cuts in W.pieces(pa.array(given, pa.string())):
        keys = list(range(first, first + len(cuts) - 1))
        out, out_cuts, forms, n, borders = I.scatter(data, cuts, I.drawn(keys, 7), 100, 50)
        chars = I.code_points(data, borders)
        outputs = I.strings(out, out_cuts).to_pylist()
        back = I.strings(*I.gather(out, out_cuts, forms)).to_pylist()
        for k, key in enumerate(keys):
            want = plain_form(key, given[key])
            assert (n[k], I.FORMS[forms[k]], outputs[k]) == (want[0], want[1], want[4])
            assert want[2] is None or tuple(chars[k][:2]) == want[2:4]
            assert back[k] == (given[key] or "")


def test_table_with_odd_rows_and_clashing_names(spark):
    rows = [(i, t, "psm", 3) for i, t in enumerate([*texts(200, 2), *ODD])]
    rows += [(None, "a\nb\nc\n", "x", 1), (5, "again\nand\n", "x", 1), (5, "again\nand\n", "x", 1)]
    docs = spark.createDataFrame(rows, "output long, doc_id string, form string, n int")
    out = I.restored(I.fill_in_middle(docs, "output", "doc_id")).collect()
    assert len(out) == len(rows)
    by_row = {}
    for key, text, *_ in rows:
        by_row.setdefault(key, []).append(text)
    for r in out:
        assert r["restored"] in [t or "" for t in by_row[r["doc_id"]]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_form(r["doc_id"], r["restored"])


@pytest.mark.parametrize("fim, spm", [(0, 50), (40, 0), (70, 100)])
def test_rates(spark, fim, spm):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(150, 3))], "id long, text string")
    out = I.restored(I.fill_in_middle(docs, "id", "text", seed=11, fim=fim, spm=spm)).collect()
    given = dict(enumerate(texts(150, 3)))
    check([{**r.asDict(), "text": given[r["doc_id"]]} for r in out], seed=11, fim=fim, spm=spm)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert I.restored(I.fill_in_middle(docs, "id", "text")).collect() == []


def test_output_without_its_marks_is_refused():
    data = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError):
        I.gather(data, np.array([0, len(data)]), np.array([I.PSM]))
