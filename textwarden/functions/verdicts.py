"""Second opinions: the request sent out and the answer that comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import col, dbl
from textwarden.functions.policy import decide
from textwarden.functions.scores import clamp, number
from textwarden.functions.text import strip_fence, strip_space

FLAG_NAMES = (
    "excessive_caps", "excessive_punctuation", "repeated_chars", "very_short", "very_long",
)


def flags_json(flags: Column | str) -> Column:
    """The five flags as JSON indented by two blanks."""
    f = col(flags)
    lines = [F.concat(F.lit(f'  "{n}": '), f[n].cast("string")) for n in FLAG_NAMES]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def review_prompt(text: Column | str, score: Column | str, flags: Column | str) -> Column:
    """The request that asks a reviewer for a verdict on one text."""
    return F.concat(
        F.lit("Judge whether the text below is harmful in its context.\n\nText: \""),
        col(text),
        F.lit('"\n\nModel score: '),
        F.format_string("%.3f", col(score)),
        F.lit(" (0.0 = safe, 1.0 = toxic)\nRisk flags: "),
        flags_json(flags),
        F.lit(
            "\n\nWeigh intent, real-world harm, irony, cultural context, audience and the chance"
            " of a false alarm. Answer with one JSON object with the fields: "
            + ", ".join(part.split()[0] for part in K.VERDICT_SCHEMA.split(", "))
            + "."
        ),
    )


def parse_verdicts(
    df: DataFrame, raw: str = "raw", ml_score: str = "score", name: str = "verdict"
) -> DataFrame:
    """Add the checked verdict of each answer as a struct.

    Missing fields get their fallback, a score that is no number becomes the
    model score, an unknown action becomes review.  An answer that is no JSON
    object gives the verdict of the reviewer_unavailable policy and an error.
    The steps are columns of their own, so that each is computed once.
    """
    body = df.withColumn("__body", strip_space(raw)).withColumn("__body", strip_fence("__body"))
    # one whole object and nothing behind it: the readers stop after the first object
    alone = F.json_array_length(F.concat(F.lit("["), F.col("__body"), F.lit("]"))) == 1
    closed = strip_space("__body").endswith("}")
    read = body.select(
        "*",
        F.json_object_keys("__body").alias("__keys"),
        F.from_json("__body", K.VERDICT_SCHEMA).alias("__v"),
        (alone & closed).alias("__alone"),
    )
    ok = F.coalesce(F.col("__keys").isNotNull() & F.col("__alone"), F.lit(False))
    checked = read.withColumn("__ok", ok).withColumn(name, _checked(ml_score))
    return checked.drop("__body", "__keys", "__v", "__alone", "__ok")


def _checked(ml_score: str) -> Column:
    ok, ml = F.col("__ok"), number(ml_score)
    given = lambda field: F.col(f"__v.{field}")
    has = lambda field: F.array_contains("__keys", field)
    spare = decide(ml_score, "reviewer_unavailable")
    unknown = F.array(F.lit("unknown"))
    error = "JSON parse error"

    stated = clamp(F.coalesce(number(given("contextual_toxicity_score")), ml))
    stated = F.when(has("contextual_toxicity_score"), stated).otherwise(dbl(0.5))
    action = F.when(given("recommended_action").isin(*K.ACTIONS), given("recommended_action"))
    or_else = lambda field, spare: F.when(has(field), given(field)).otherwise(spare)
    if_ok = lambda field, spare: F.coalesce(F.when(ok, given(field)), spare)
    return F.struct(
        F.when(ok, stated).otherwise(ml).alias("score"),
        F.when(ok, F.coalesce(action, F.lit("review"))).otherwise(spare["action"]).alias("action"),
        F.when(ok, or_else("confidence", F.lit("medium"))).otherwise(spare["confidence"]).alias("confidence"),
        F.when(ok, or_else("reasoning", F.lit(K.MISSING_REASONING)))
        .otherwise(F.lit(failure_reason(error)))
        .alias("reasoning"),
        F.when(ok, or_else("harm_categories", unknown)).otherwise(unknown).alias("harm_categories"),
        F.when(ok, F.coalesce(given("context_factors"), F.array().cast("array<string>")))
        .otherwise(F.array(F.lit("reviewer_unavailable")))
        .alias("context_factors"),
        if_ok("is_sarcasm", F.lit(False)).alias("is_sarcasm"),
        if_ok("is_false_positive", F.lit(False)).alias("is_false_positive"),
        if_ok("severity_level", F.lit("medium")).alias("severity_level"),
        if_ok("target_audience_risk", F.lit("unknown")).alias("target_audience_risk"),
        if_ok("cultural_sensitivity", F.lit("unknown")).alias("cultural_sensitivity"),
        if_ok("explanation_for_user", F.lit(K.DEFAULT_EXPLANATION)).alias("explanation_for_user"),
        ok.alias("enhanced"),
        F.when(ok, F.abs(stated - ml)).otherwise(dbl(0)).alias("score_difference"),
        F.when(~ok, F.lit(error)).alias("error"),
    )


def failure_reason(error: str) -> str:
    return f"Second opinion failed: {error}. Using ML model score."


def model_only_verdict(ml_score: Column | str) -> Column:
    """The verdict a row gets that is not sent to a reviewer."""
    reason = lambda a: F.coalesce(*[F.when(a == k, v) for k, v in K.MODEL_ONLY_REASONS.items()])
    return _own_verdict(ml_score, "ml_only", reason, F.array().cast("array<string>"), None)


def unavailable_verdict(ml_score: Column | str, error: str = "no answer") -> Column:
    """The verdict a row gets whose reviewer never answered."""
    reason = lambda a: F.lit(failure_reason(error))
    factors = F.array(F.lit("reviewer_unavailable"))
    return _own_verdict(ml_score, "reviewer_unavailable", reason, factors, error)


def _own_verdict(ml_score, policy, reason, factors, error) -> Column:
    ml = number(ml_score)
    d = decide(ml_score, policy)
    return F.struct(
        ml.alias("score"),
        d["action"].alias("action"),
        d["confidence"].alias("confidence"),
        reason(d["action"]).alias("reasoning"),
        F.array(F.lit("unknown")).alias("harm_categories"),
        factors.alias("context_factors"),
        F.lit(False).alias("is_sarcasm"),
        F.lit(False).alias("is_false_positive"),
        F.lit("medium").alias("severity_level"),
        F.lit("unknown").alias("target_audience_risk"),
        F.lit("unknown").alias("cultural_sensitivity"),
        F.lit(K.DEFAULT_EXPLANATION).alias("explanation_for_user"),
        F.lit(False).alias("enhanced"),
        dbl(0).alias("score_difference"),
        F.lit(error).cast("string").alias("error"),
    )
