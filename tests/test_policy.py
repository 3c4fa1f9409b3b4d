"""Boundary tables for every policy, golden blends and answer parsing."""

import pytest
from pyspark.sql import functions as F

from textwarden.functions import payload as PL
from textwarden.functions import policy as P
from textwarden.functions import scores as S
from textwarden.functions.verdicts import model_only_verdict, parse_verdicts
from textwarden.operators import decisions as D

SCORES = [0.0, 0.19, 0.2, 0.3, 0.31, 0.5, 0.51, 0.6, 0.61, 0.7, 0.71, 0.8, 0.81, 1.0, None]


def ladder(block, bc, review, rc, ac):
    def run(s):
        if s is None:
            return ("review", "medium")
        return ("block", bc) if s > block else ("review", rc) if s > review else ("allow", ac)

    return run


def fallback(s):
    if s is None:
        return ("review", "medium")
    if s > 0.8:
        return ("block", "high")
    if s > 0.5:
        return ("review", "medium")
    return ("allow", "high" if s < 0.2 else "medium")


RULES = {
    "demo": ladder(0.7, "high", 0.5, "medium", "high"),
    "ml_only": ladder(0.7, "high", 0.5, "medium", "high"),
    "reviewer_unavailable": ladder(0.8, "medium", 0.6, "low", "medium"),
    "online_fallback": fallback,
}


@pytest.mark.parametrize("policy", RULES)
def test_boundaries(spark, policy):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SCORES)], "i INT, s DOUBLE")
    got = df.select("i", P.decide("s", policy).alias("d")).select("i", "d.*").orderBy("i").collect()
    assert [(r["action"], r["confidence"]) for r in got] == [RULES[policy](s) for s in SCORES]


def test_adjusted_threshold(spark):
    flags = F.struct(
        F.lit(True).alias("excessive_caps"),
        F.lit(True).alias("excessive_punctuation"),
        F.lit(True).alias("repeated_chars"),
    )
    df = spark.createDataFrame([(0.3,), (0.31,), (0.5,)], "s DOUBLE").withColumn("f", flags)
    got = [r[0] for r in df.select(P.decide("s", "online_fallback", "f", True)["action"]).collect()]
    assert got == ["allow", "review", "review"]
    got = [r[0] for r in df.select(P.decide("s", "online_fallback", "f", False)["action"]).collect()]
    assert got == ["allow", "allow", "allow"]


def test_unknown_policy():
    with pytest.raises(ValueError):
        P.decide("s", "nothing")


# fixed values: model score, verdict score (None: not asked), final score, action
GOLDEN = [
    (0.7640125, 0.05, 0.3356, "allow"),
    (0.4876518, 0.05, 0.2251, "allow"),
    (0.6998300, 0.10, 0.3399, "allow"),
    (0.8709143, None, 0.8709, "block"),
    (0.9290252, None, 0.9290, "block"),
    (0.1561865, None, 0.1562, "allow"),
    (0.0782038, None, 0.0782, "allow"),
]


def _scored(spark, scores, caps=False, punct=False):
    rows = [(i, s, caps, punct) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "doc_id INT, score DOUBLE, c BOOLEAN, p BOOLEAN")
    flags = F.struct(
        F.col("c").alias("excessive_caps"),
        F.col("p").alias("excessive_punctuation"),
        F.lit(False).alias("repeated_chars"),
    )
    return df.select("doc_id", "score", flags.alias("flags"))


def test_golden_blends(spark):
    scored = _scored(spark, [g[0] for g in GOLDEN])
    raw = '{"contextual_toxicity_score": %s, "recommended_action": "allow", "confidence": "high"}'
    answers = spark.createDataFrame(
        [(i, raw % (g[1] if g[1] is not None else 0.0)) for i, g in enumerate(GOLDEN)],
        "doc_id INT, raw STRING",
    )
    out = D.decide_combined(D.attach_verdicts(scored, answers)).orderBy("doc_id").collect()
    assert [(r["final_score"], r["action"]) for r in out] == [(g[2], g[3]) for g in GOLDEN]
    assert [r["enhanced"] for r in out] == [g[1] is not None for g in GOLDEN]


def test_bumps_are_not_clamped(spark):
    scored = _scored(spark, [1.0, 0.79], caps=True, punct=True)
    scored = scored.withColumn("verdict", model_only_verdict("score"))
    out = D.decide_combined(scored).orderBy("doc_id").collect()
    assert [r["final_score"] for r in out] == [1.08, 0.87]


def test_borderline_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.3, 0.31, 0.8, 0.81)], "s DOUBLE")
    got = df.select(S.borderline("s"), S.borderline("s", hi_closed=True)).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True), (False, True), (False, False)]


VERDICTS = [
    ('{"contextual_toxicity_score": 0.4, "recommended_action": "allow"}', 0.4, "allow", True),
    ('```json\n{"contextual_toxicity_score": 0.4}\n```', 0.4, "review", True),
    ('```\n{"contextual_toxicity_score": 0.4}\n```', 0.4, "review", True),
    ('{"contextual_toxicity_score": "0.4"}', 0.65, "review", True),
    ('{"contextual_toxicity_score": 1.7, "recommended_action": "ban"}', 1.0, "review", True),
    ('{"contextual_toxicity_score": -0.2, "recommended_action": "block"}', 0.0, "block", True),
    ('{"recommended_action": "block"}', 0.5, "block", True),
    ('{"contextual_toxicity_score": 0.4,', 0.65, "review", False),
    ('{"contextual_toxicity_score": 0.4} and more', 0.65, "review", False),
    ('{"contextual_toxicity_score": 0.4} {"a": 1}', 0.65, "review", False),
    ("[1, 2]", 0.65, "review", False),
    ("5", 0.65, "review", False),
    ("", 0.65, "review", False),
    (None, 0.65, "review", False),
]


def test_parse_verdicts(spark):
    df = spark.createDataFrame([(i, v[0], 0.65) for i, v in enumerate(VERDICTS)], "i INT, raw STRING, score DOUBLE")
    got = parse_verdicts(df).orderBy("i").select("verdict.*").collect()
    assert [(r["score"], r["action"], r["enhanced"]) for r in got] == [v[1:] for v in VERDICTS]
    assert [r["error"] is None for r in got] == [v[3] for v in VERDICTS]


def test_false_positive_allows(spark):
    raw = '{"contextual_toxicity_score": 0.9, "recommended_action": "block", "is_false_positive": true}'
    scored = _scored(spark, [0.7])
    answers = spark.createDataFrame([(0, raw)], "doc_id INT, raw STRING")
    r = D.decide_combined(D.attach_verdicts(scored, answers)).first()
    assert (r["action"], r["confidence"]) == ("allow", "high")


def test_missing_answer_and_missing_score(spark):
    scored = _scored(spark, [0.7, None])
    none = spark.createDataFrame([], "doc_id INT, raw STRING")
    got = D.decide_combined(D.attach_verdicts(scored, none)).orderBy("doc_id").collect()
    assert [(r["routed"], r["enhanced"], r["action"]) for r in got] == [
        (True, False, "review"),
        (False, False, "review"),
    ]


def test_route(spark):
    rows = [(0.9, None), (0.8, "block"), (0.8, None), (0.5, "review"), (0.5, "allow"), (0.3, None), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, s DOUBLE, v STRING")
    got = df.select("i", P.route("s", "v").alias("r")).select("i", "r.*").orderBy("i").collect()
    assert [(r["final_decision"], r["action"], r["fallback_used"]) for r in got] == [
        ("BLOCKED", "block", False),
        ("BLOCKED", "block", False),
        (None, "review", True),
        ("REVIEW", "review", False),
        ("ALLOWED", "allow", False),
        ("ALLOWED", "allow", False),
        (None, "review", True),
    ]


def test_reasons(spark):
    rows = [
        ("review", ["a", "b"], "why"), ("review", ["unknown"], "why"), ("review", [], None),
        ("block", ["a"], "x" * 120), ("block", ["a"], ""), ("allow", ["a"], "why"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, a STRING, c ARRAY<STRING>, w STRING")
    got = [r[0] for r in df.orderBy("i").select(P.decision_reason("a", "c", "w")).collect()]
    base, block = P.K.REVIEW_REASON, P.K.BLOCK_REASON
    assert got == [
        f"{base} (Potential concerns: a, b)", base, base,
        f"{block} (Analysis: {'x' * 100}...)", block, None,
    ]


def test_payload_shapes(spark):
    rows = [
        ("  one ", "text/csv"), ('{"text": "two"}', "application/json"), ('{"x": 1}', "application/json"),
        ('["a", "b"]', "application/json"), ("l1\n\n l2 ", "text/csv"), (" raw ", "text/plain"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, b STRING, c STRING").orderBy("i")
    single = [r[0] for r in df.select(PL.payload_texts("b", "c")).collect()]
    lines = [r[0] for r in df.select(PL.payload_texts("b", "c", "lines")).collect()]
    assert single == [["one"], ["two"], [""], ["a", "b"], ["l1\n\n l2"], [" raw "]]
    assert lines == [["one"], ["two"], ['{"x":1}'], ["a", "b"], ["l1", "l2"], ["raw"]]


def test_score_shapes(spark):
    df = spark.createDataFrame([("[0.9]",), ('{"predictions": [0.8]}',), (" 0.7\n",), ("no",), (None,)], "r STRING")
    assert [r[0] for r in df.select(PL.parse_score_response("r")).collect()] == [0.9, 0.8, 0.7, None, None]


@pytest.mark.parametrize("policy", [*P.LADDERS, "online_fallback", "binary"])
@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), float("-inf")])
def test_what_is_no_number_goes_to_review(spark, policy, value):
    df = spark.createDataFrame([(value,)], "s DOUBLE")
    d = df.select(P.decide("s", policy).alias("d")).first()["d"]
    assert d["action"] == "review" and d["is_toxic"] is None
    r = df.select(P.route("s", F.lit("block")).alias("r")).first()["r"]
    assert r["action"] == "review" and r["fallback_used"]


def test_no_number_in_a_verdict_becomes_the_model_score(spark):
    from textwarden.functions.verdicts import parse_verdicts

    rows = [(i, f'{{"contextual_toxicity_score": "{x}"}}', 0.4) for i, x in enumerate(["NaN", "Infinity", "-Infinity", "0.9"])]
    got = parse_verdicts(spark.createDataFrame(rows, "i INT, raw STRING, score DOUBLE")).collect()
    assert [r["verdict"]["score"] for r in got[:3]] == [0.4] * 3
    flags = F.struct(F.lit(False).alias("excessive_caps"), F.lit(False).alias("excessive_punctuation"))
    nan = spark.createDataFrame([(float("nan"),)], "s DOUBLE").select(
        F.col("s"), flags.alias("f"),
        F.struct(F.lit(0.9).alias("score"), F.lit("allow").alias("action"), F.lit("low").alias("confidence"),
                 F.lit(False).alias("enhanced"), F.lit(False).alias("is_false_positive")).alias("v"),
    )
    c = nan.select(P.combine_scores("s", "v", "f").alias("c")).first()["c"]
    assert (c["score"], c["action"]) == (None, "review")


def test_text_of_a_request_is_a_string(spark):
    from textwarden.functions.payload import parse_score_response, request_text

    raws = ['{"text": 5}', '{"text": "5"}', '{"body": "{\\"text\\": [1]}"}', '{"text": null}', "{}", "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i INT, raw STRING")
    assert [r[0] for r in df.orderBy("i").select(request_text("raw")).collect()] == ["", "5", "", "", "", ""]
    answers = spark.createDataFrame([("NaN",), ("[Infinity]",), ('{"predictions": ["-Infinity"]}',), ("[0.25]",)], "a STRING")
    assert [r[0] for r in answers.select(parse_score_response("a")).collect()] == [None, None, None, 0.25]


def test_listed_words_are_taken_literally(spark):
    from textwarden.functions.text import has_listed_word

    df = spark.createDataFrame([("a.b",), ("axb",), ("say f*** now",), ("fff",)], "t STRING")
    assert [r[0] for r in df.select(has_listed_word("t", ["a.b", "f***"])).collect()] == [True, False, True, False]
