"""Literal tables for the text rules, and Python's own string functions as a second opinion."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from textwarden.functions import features as FE
from textwarden.functions import text as T

CLEAN = [
    ("see http://a.example/x?y=1 now", "see now"),
    ("see https://a.example now", "see now"),
    ("www.a.example/path and more", "and more"),
    ("write to a.b@c.example please", "write to please"),
    ("wait.... what", "wait... what"),
    ("two.. dots", "two.. dots"),
    ("hey!!!! you?????", "hey!! you??"),
    ("one! two?", "one! two?"),
    ("a  b\t\nc", "a b c"),
    (" x　", "x"),
    ("fish &amp; chips &lt;now&gt;", "fish & chips <now>"),
    ("go http&#58;//a.example/x end", "go end"),
    ("&amp;copy; stays", "&copy; stays"),
    ("&nbsp;", ""),
    ("http://only.example", ""),
    ("me@here.example", ""),
    ("@a a@ @b@ @@ x@y", "@a a@ @b@ @@"),
    ("", ""),
    ("   ", ""),
    (None, ""),
    ("héllo wörld 😀", "héllo wörld 😀"),
]


def rows(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")


def apply(spark, values, column):
    out = rows(spark, values).select("i", column.alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_clean_cases(spark):
    got = apply(spark, [raw for raw, _ in CLEAN], T.clean_text("t"))
    assert got == [want for _, want in CLEAN]


def _python_clean(text):
    text = html.unescape(text)
    text = re.sub(r"https?://[!$-_a-z]+", "", text)
    text = re.sub(r"www\.[!$-_a-z]+", "", text)
    text = re.sub(r"\S+@\S+", "", text)
    text = re.sub(r"\.{3,}", "...", text)
    text = re.sub(r"!{2,}", "!!", text)
    text = re.sub(r"\?{2,}", "??", text)
    return " ".join(text.split())


def _random_texts(n, seed):
    r = random.Random(seed)
    bits = list("ab@@..!!??  \t\n \x1c\x85 é&;/:wW_9-") + [
        "http://", "https://", "www.", "&amp;", "&lt", "&#64;", "...", "!!!", "x@y",
    ]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_clean_equals_python(spark):
    texts = _random_texts(4000, 7)
    assert apply(spark, texts, T.clean_text("t")) == [_python_clean(t) for t in texts]


def test_long_runs_stay_fast(spark):
    texts = ["http://a.example/" + "x" * 40_000, "y" * 200_000, "z" * 50_000 + "@" + "z" * 50_000,
             " " * 200_000 + "end"]
    got = apply(spark, texts, T.clean_text("t"))
    assert got == ["", "y" * 200_000, "", "end"]


def test_strip_equals_python(spark):
    texts = _random_texts(500, 3)
    assert apply(spark, texts, T.strip_space("t")) == [t.strip() for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_python(spark, seed):
    texts = [_python_clean(t) for t in _random_texts(800, seed)] + ["ABC", "AB", "aaaa", "aaa", "", "١٢"]
    got = rows(spark, texts).select("i", FE.text_features("t").alias("f")).select("i", "f.*")
    for r, t in zip(got.orderBy("i").collect(), texts):
        words = t.split()
        assert r["length"] == len(t)
        assert r["word_count"] == len(words)
        assert r["has_caps"] == bool(re.search("[A-Z]{3,}", t))
        assert r["has_repeated_chars"] == bool(re.search(r"(.)\1{3,}", t))
        assert r["exclamation_count"] == t.count("!")
        assert r["question_count"] == t.count("?")
        assert r["has_numbers"] == bool(re.search(r"\d", t))
        assert r["avg_word_length"] == sum(map(len, words)) / max(len(words), 1)


def test_flags(spark):
    texts = ["ABCd", "ABcd", "!!!???", "!!!??", "xaaaay", "xAAAAy", " short ", "x" * 1001]
    got = rows(spark, texts).select("i", FE.risk_flags("t").alias("f")).select("i", "f.*")
    f = [r.asDict() for r in got.orderBy("i").collect()]
    assert [r["excessive_caps"] for r in f] == [True, False, False, False, False, True, False, False]
    assert [r["excessive_punctuation"] for r in f][2:4] == [True, False]
    assert [r["repeated_chars"] for r in f][4:6] == [True, False]
    assert [r["very_short"] for r in f][6:] == [True, False]
    assert [r["very_long"] for r in f][6:] == [False, True]


def test_listed_words(spark):
    texts = ["I hate it", "HATE!", "hated", "die", "dieé", "die_x", "(idiot)", "skill"]
    assert apply(spark, texts, T.has_listed_word("t")) == [
        True, True, False, True, False, False, True, False,
    ]


def test_risk_record(spark):
    texts = ["x" * 1001, "abc", "STOP aaaa !!!! you stupid", "calm words"]
    f = rows(spark, texts).select("i", FE.risk_of_text("t").alias("r")).select("i", "r.*").orderBy("i")
    got = [(r["risk_score"], list(r["indicators"]), r["needs_human_review"]) for r in f.collect()]
    assert got == [
        (2, ["very_long_text", "repeated_characters"], False),
        (1, ["very_short_text"], False),
        (
            7,
            ["excessive_caps", "repeated_characters", "excessive_exclamations",
             "potential_offensive_language"],
            True,
        ),
        (0, [], False),
    ]


def test_fences_and_previews(spark):
    texts = ['```json\n{"a": 1}\n```', "```\nx\n```", " plain ", "```", "```json"]
    assert apply(spark, texts, T.strip_fence("t")) == ['\n{"a": 1}\n', "\nx\n", "plain", "", ""]
    texts = ["a" * 100, "a" * 101]
    assert apply(spark, texts, T.preview("t", 100, "if_longer")) == ["a" * 100, "a" * 100 + "..."]
    assert apply(spark, texts, T.preview("t", 100, "always"))[0] == "a" * 100 + "..."


def test_tokens_and_ngrams(spark):
    t = F.col("t")
    got = apply(spark, ["The big Dog, a cat_9 é!", "", "one"], T.ngrams(T.tokens(t), (1, 2)))
    assert got == [["big", "dog", "cat_9", "big dog", "dog cat_9"], [], ["one"]]
    got = apply(spark, ["x1 x2 x3 x4"], T.ngrams(T.tokens(t), (3, 4)))
    assert got == [["x1 x2 x3", "x2 x3 x4", "x1 x2 x3 x4"]]
