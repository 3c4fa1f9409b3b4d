"""Decision policies: a score, with flags or a verdict, becomes an action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import col, dbl
from textwarden.functions.scores import blend, bump, clamp, distance_of, number

# fixed values: block above, confidence; review above, confidence; confidence of the rest
LADDERS = {
    "demo": (0.7, "high", 0.5, "medium", "high"),
    "ml_only": (0.7, "high", 0.5, "medium", "high"),
    "reviewer_unavailable": (0.8, "medium", 0.6, "low", "medium"),
}
POLICIES = (*LADDERS, "online_fallback", "binary")


def _result(action, confidence, threshold, toxic) -> Column:
    return F.struct(
        action.alias("action"),
        confidence.alias("confidence"),
        threshold.cast("double").alias("threshold"),
        toxic.alias("is_toxic"),
    )


def adjusted_threshold(flags: Column | str | None, adjust: bool) -> Column:
    """0.5, lowered for each flag if asked for, kept within [0.3, 0.8]."""
    base = dbl(0.5)
    if adjust and flags is not None:
        flags = col(flags)
        # fixed values: flag, reduction
        for name, less in (
            ("excessive_caps", 0.1),
            ("excessive_punctuation", 0.05),
            ("repeated_chars", 0.05),
        ):
            base = base - F.when(flags[name], dbl(less)).otherwise(dbl(0))
    return clamp(base, 0.3, 0.8)


def decide(
    score: Column | str, policy: str, flags: Column | str | None = None, adjust: bool = False
) -> Column:
    """Struct of action, confidence, threshold and is_toxic under a named policy.

    A row without a score goes to review: a missing score is not a low one, and a
    value that is no finite number is a missing score.
    """
    s = number(score)
    if policy in LADDERS:
        block, block_conf, review, review_conf, allow_conf = LADDERS[policy]
        threshold = dbl(review)
        action = F.when(s > dbl(block), "block").when(s > threshold, "review").otherwise("allow")
        confidence = (
            F.when(s > dbl(block), block_conf).when(s > threshold, review_conf).otherwise(allow_conf)
        )
        toxic = s > dbl(K.TOXIC_ABOVE)
    elif policy == "online_fallback":
        threshold = adjusted_threshold(flags, adjust)
        action = F.when(s > dbl(0.8), "block").when(s > threshold, "review").otherwise("allow")
        confidence = (
            F.when(s > dbl(0.8), "high")
            .when(s > threshold, "medium")
            .when(s < dbl(0.2), "high")
            .otherwise("medium")
        )
        toxic = s > threshold
    elif policy == "binary":
        threshold = dbl(K.TOXIC_ABOVE)
        toxic = s > dbl(K.TOXIC_ABOVE)
        action = F.when(toxic, "toxic").otherwise("safe")
        confidence = distance_of(s)
    else:
        raise ValueError(f"unknown policy: {policy}")
    missing = s.isNull()
    if policy != "binary":
        confidence = F.when(missing, "medium").otherwise(confidence)
    return _result(F.when(missing, "review").otherwise(action), confidence, threshold, toxic)


def combine_scores(ml: Column | str, verdict: Column | str, flags: Column | str) -> Column:
    """Final score, action and confidence from model score, verdict and flags.

    ``verdict`` is a struct with score, action, confidence, enhanced and
    is_false_positive.  Limits are compared before rounding.
    """
    v = col(verdict)
    final = bump(blend(number(ml), number(v["score"]), v["enhanced"]), flags)
    block = (final > dbl(0.8)) | (v["action"] == "block")
    review = (final > dbl(0.5)) | (v["action"] == "review")
    false_positive = F.coalesce(v["is_false_positive"], F.lit(False))
    action = (
        F.when(false_positive, "allow").when(block, "block").when(review, "review").otherwise("allow")
    )
    confidence = (
        F.when(false_positive | block, "high").when(review, v["confidence"]).otherwise("high")
    )
    return F.struct(
        F.round(final, 4).alias("score"),
        F.when(final.isNull(), "review").otherwise(action).alias("action"),
        F.when(final.isNull(), "medium").otherwise(confidence).alias("confidence"),
    )


def route(score: Column | str, verdict_action: Column | str) -> Column:
    """Workflow routing: branch, decision, action, confidence, reason, fallback mark.

    A row in the closed upper borderline range needs a verdict; without one, or
    without a score, it goes to review.
    """
    s, va = number(score), col(verdict_action)
    borderline = (s > dbl(0.3)) & (s <= dbl(0.8))
    fallback = s.isNull() | (borderline & va.isNull())
    block = (s > dbl(0.8)) | (borderline & (va == "block"))
    review = borderline & (va == "review")
    pick = lambda fb, b, r, a: F.when(fallback, fb).when(block, b).when(review, r).otherwise(a)
    return F.struct(
        F.when(s > dbl(0.8), "high").when(borderline, "borderline").otherwise("low").alias("branch"),
        pick(F.lit(None).cast("string"), F.lit("BLOCKED"), F.lit("REVIEW"), F.lit("ALLOWED")).alias(
            "final_decision"
        ),
        pick(F.lit("review"), F.lit("block"), F.lit("review"), F.lit("allow")).alias("action"),
        pick(F.lit("medium"), F.lit("high"), F.lit("medium"), F.lit("high")).alias("confidence"),
        pick(*[F.lit(K.ROUTE_REASONS[k]) for k in ("fallback", "block", "review", "allow")]).alias(
            "reasoning"
        ),
        fallback.alias("fallback_used"),
    )


def decision_reason(
    action: Column | str, categories: Column | str, reasoning: Column | str
) -> Column:
    """Text shown with a reviewed or blocked row; NULL for an allowed one."""
    a, cats, why = col(action), col(categories), col(reasoning)
    named = (F.size(cats) > 0) & ~((F.size(cats) == 1) & (F.element_at(cats, 1) == "unknown"))
    concerns = F.concat(
        F.lit(K.REVIEW_REASON + " (Potential concerns: "), F.array_join(cats, ", "), F.lit(")")
    )
    analysis = F.concat(
        F.lit(K.BLOCK_REASON + " (Analysis: "), F.substring(why, 1, 100), F.lit("...)")
    )
    return (
        F.when(a == "review", F.when(named, concerns).otherwise(F.lit(K.REVIEW_REASON)))
        .when(a == "block", F.when(F.length(why) > 0, analysis).otherwise(F.lit(K.BLOCK_REASON)))
    )
