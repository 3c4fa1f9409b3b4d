"""Token files: ids against the library, order, places, and that readers skip what they can."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from textwarden.llm import token_orc as T
from textwarden.llm import words as W
from textwarden.session import fresh_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = [
    None, "", " ", "\n\n \n", "a", "don't we'll I'M it's 'tis", "  two  spaces ", "tab\t\ttab", "\r\nline\r\n\r\n", "12 345,678.90%",
    "<|endoftext|> x<|endoftext|>", "é à ß ÿ Ā ɏ", "日本語 text", "\U0001f600\U0001f600 x", "\x00\x1c\x1d \x85", "a b ­ ª º ² ½",
    "w" * 30_000, "go on " * 5000, "<P> | !! @", "  　 ​",
]


def random_texts(n, seed):
    r = random.Random(seed)
    marks = ["'s", "'ll", " ", "  ", "\n", "\t", "!", "--", "1", "23", "A", "bc", "def", "é", "ª", "×", " ", "日"]
    return ["".join(r.choice(marks) for _ in range(r.randrange(80))) for _ in range(n)]


def pieces_ids(encoder, texts):
    given = pa.array(texts, pa.string())
    return [row.tolist() for _, data, cuts in W.pieces(given) for row in encoder.piece(data, cuts)]


@pytest.mark.parametrize("piece, known", [(1 << 19, T.KNOWN), (64, 20), (1 << 12, 300)])
def test_words_give_the_tokens_of_the_library(library, monkeypatch, piece, known):
    monkeypatch.setattr(W, "PIECE", piece)
    monkeypatch.setattr(T, "KNOWN", known)
    texts = [*random_texts(500, 1), *ODD]
    encoder = T.Encoder(VOCABULARY, 2)
    assert pieces_ids(encoder, texts) == [[*library(t), 2] for t in texts]
    assert len(encoder.key) <= known and len(encoder.ids) < 8 * known + 200_000


def test_every_plain_character_is_cut_as_the_library_cuts_it(library):
    plain = [*"\t\n\r", *map(chr, range(0x20, 0x7F)), *map(chr, range(0xA1, 0x250))]
    near = [*map(chr, range(0x20)), *map(chr, range(0x7F, 0xA1)), *map(chr, range(0x250, 0x2C0))]
    texts = [f"a{c}b {c} 1{c}2 {c}{c}!{c}  {c}\n{c}-{c}" for c in [*plain, *near]] + [*plain, *near]
    assert pieces_ids(T.Encoder(VOCABULARY, 2), texts) == [[*library(t), 2] for t in texts]
    cut = {t: W.pieces(pa.array([t])) for t in texts}
    assert sum(T.words_of(data, cuts)[1].all() for p in cut.values() for _, data, cuts in p) == 2 * (len(plain) - 1)


def test_spans_are_told_apart_by_their_bytes(monkeypatch):
    spans = ["a", "ab", "b", "a", "x" * 32, "x" * 31, "x" * 33, "x" * 33, "ab", "y" * 8, "y" * 9, "y" * 8, "x" * 32]
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    sizes = np.array([len(s) for s in spans])
    starts = np.cumsum(sizes) - sizes
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(T, "mixed", lambda h: h * np.uint64(0))
        words, which = T.contents(data, starts, sizes)
        named = ["".join(spans)[a : a + n] for a, n in zip(words.starts, words.sizes)]
        assert [named[k] for k in which] == spans
        assert weak or len(named) == len(set(spans)) + 1


def rows_of(n, seed):
    r = random.Random(seed)
    texts = [*random_texts(n, seed), *ODD]
    keys = r.sample(range(-50, 10 * n), len(texts))
    rows = [(k, t, "x", 0) for k, t in zip(keys, texts)]
    return [*rows, (None, "no id", "x", 0), (7_000_000, "twice", "x", 0), (7_000_000, "twice", "x", 0), (7_000_000, "and not", "x", 0)]


def write(spark, rows, **options):
    docs = spark.createDataFrame(rows, "before long, doc_id string, ids string, n_tokens int")
    path = fresh_path(spark, "test-token-orc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows, yet several files
    try:
        T.write_tokens(docs.repartition(5), path, "before", "doc_id", VOCABULARY, **options)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


def test_index_of_the_files(spark, library):
    rows = rows_of(300, 2)
    path = write(spark, rows)
    got = T.document_index(T.read_tokens(spark, path)).orderBy("start").collect()
    assert T.read_tokens(spark, path).select("file").distinct().count() > 1
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    at = 0
    left = {}
    for k, t, *_ in rows:
        left.setdefault(k, []).append([*library(t), 2])
    for r in got:
        ids = next(x for x in left[r["doc_id"]] if len(x) == r["n_tokens"] and zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        left[r["doc_id"]].remove(ids)
        assert r["start"] == at
        at += r["n_tokens"]
    assert not any(left.values())


def test_files_have_stripes_and_are_read_by_name(spark, library):
    rows = [(i, f"row {i} " * 60, "x", 0) for i in range(8000)]
    docs = spark.createDataFrame(rows, "id long, text string, a string, b int").coalesce(1)
    path = fresh_path(spark, "test-token-orc")
    T.write_tokens(docs, path, "id", "text", VOCABULARY, stripe=100_000, rows=1000)
    files = [f["p"] for f in spark.read.format("binaryFile").load(path).selectExpr("path AS p").collect()]
    opened = [orc.ORCFile(f.removeprefix("file:")) for f in files]
    assert sum(f.nstripes for f in opened) > len(opened)
    assert {f.row_index_stride for f in opened} == {1000}
    assert sum(f.nrows for f in opened) == 8000
    found = T.read_tokens(spark, path, ids=[4321])
    (row,) = found.collect()
    assert row["ids"] == [*library("row 4321 " * 60), 2]
    # an id between two others of a group of rows is ruled out by the Bloom filter alone
    gaps = fresh_path(spark, "test-token-orc")
    T.write_tokens(docs.selectExpr("id * 2 AS id", "text"), gaps, "id", "text", VOCABULARY)
    for ids, most in (([4000], 1000), ([4001], 0), ([4000, 9002, -3], 2000)):
        assert read_rows(T.read_tokens(spark, gaps, ids=ids)) <= most
    assert read_rows(T.read_tokens(spark, gaps)) == 8000


def read_rows(df):
    """Rows that the scan of a table gave to the plan above it."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    scans = [plan]
    while scans:
        node = scans.pop()
        if "Scan" in node.nodeName():
            return node.metrics().apply("numOutputRows").value()
        kids = node.children()
        scans.extend(kids.apply(i) for i in range(kids.length()))
    raise AssertionError("no scan")


def test_empty_table(spark):
    path = write(spark, [])
    assert T.document_index(T.read_tokens(spark, path)).collect() == []


def test_query_follows_its_definition(spark, library):
    """op13 over the smallest tables against the library, one whole text after the other."""
    from textwarden.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_token_orc"](spark, sf).collect()}
    start = 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array([*library(d["text"]), 2], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
