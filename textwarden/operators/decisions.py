"""Scored rows, verdicts, decisions, logs and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import dbl
from textwarden.functions.policy import combine_scores, decide, decision_reason, route
from textwarden.functions.scores import borderline, is_toxic, number, percent_text
from textwarden.functions.text import preview
from textwarden.functions.verdicts import (
    model_only_verdict,
    parse_verdicts,
    review_prompt,
    unavailable_verdict,
)


def review_queue(scored: DataFrame, hi_closed: bool = False) -> DataFrame:
    """The borderline rows, batch or stream: those to send to a reviewer."""
    return scored.filter(borderline("score", hi_closed=hi_closed))


def render_review_requests(scored: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One request text per borderline row."""
    queue = review_queue(scored)
    return queue.select(key, review_prompt(text, "score", "flags").alias("prompt"))


def latest_verdicts(verdicts: DataFrame, key: str = "doc_id", ts: str | None = None) -> DataFrame:
    """One answer per key: the newest, or the greatest text if there is no time."""
    order = F.struct(*([ts] if ts else []), "raw")
    return verdicts.groupBy(key).agg(F.max_by("raw", order).alias("raw"))


def attach_verdicts(
    scored: DataFrame,
    verdicts: DataFrame,
    key: str = "doc_id",
    use_reviewer: bool = True,
    ts: str | None = None,
) -> DataFrame:
    """Add ``routed``, ``enhanced`` and the verdict struct to scored rows.

    ``verdicts`` has raw answers; of several for one key the newest (by ``ts``)
    or greatest counts, so a row stays one row.  Only borderline rows look for
    one; the others, and those whose answer is missing or broken, get the verdict
    of their own score.  The key stays the join key of every row, so rows that need
    no answer do not gather in one task.
    """
    routed = borderline("score") if use_reviewer else F.lit(False)
    rows = scored.withColumn("routed", F.coalesce(routed, F.lit(False)))
    # the reduction and the join share one shuffle by the key
    one = latest_verdicts(verdicts, key, ts)
    answers = one.select(F.col(key).alias("__key"), F.col("raw").alias("__raw"))
    joined = rows.join(answers, (rows[key] == answers["__key"]) & rows["routed"], "left")
    verdict = (
        F.when(~F.col("routed"), model_only_verdict("score"))
        .when(F.col("__raw").isNull(), unavailable_verdict("score"))
        .otherwise(F.col("__parsed"))
    )
    parsed = parse_verdicts(joined, "__raw", "score", "__parsed")
    out = parsed.withColumn("verdict", verdict).drop("__key", "__raw", "__parsed")
    return out.withColumn("enhanced", F.col("verdict.enhanced"))


def decide_combined(attached: DataFrame) -> DataFrame:
    """Final score, action and confidence from score, flags and verdict."""
    final = combine_scores("score", "verdict", "flags")
    return (
        attached.withColumn("final", final)
        .withColumn("final_score", F.col("final.score"))
        .withColumn("action", F.col("final.action"))
        .withColumn("confidence", F.col("final.confidence"))
        .drop("final")
    )


def decide_enhanced(attached: DataFrame, available: str | None = None) -> DataFrame:
    """The online decision with its reason.

    Rows whose ``available`` column is false had no enhanced analysis at all and
    fall back to the threshold policy on the model score.
    """
    combined = decide_combined(attached)
    spare = decide("score", "online_fallback")
    ok = F.coalesce(F.col(available), F.lit(False)) if available else F.lit(True)
    out = combined.withColumn("__spare", spare)
    pick = lambda mine, other: F.when(ok, mine).otherwise(other)
    cats, why = F.col("verdict.harm_categories"), F.col("verdict.reasoning")
    return (
        out.withColumn("action", pick(F.col("action"), F.col("__spare.action")))
        .withColumn("confidence", pick(F.col("confidence"), F.col("__spare.confidence")))
        .withColumn("is_toxic", pick(is_toxic("final_score"), F.col("__spare.is_toxic")))
        .withColumn("threshold", pick(dbl(0.5), F.col("__spare.threshold")))
        .withColumn("final_score", pick(F.col("final_score"), F.round(number("score"), 4)))
        .withColumn(
            "reason",
            decision_reason("action", F.when(ok, cats), F.when(ok, why)),
        )
        .drop("__spare")
    )


def route_workflow(scored: DataFrame, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Workflow decision of every row, and in ``enhanced`` whether an answer decided it.

    ``verdicts`` has key and action; of several actions for one key the newest
    (by ``ts``, where there is one) or greatest counts.
    """
    rows = scored.withColumn("__ask", F.coalesce(borderline("score", hi_closed=True), F.lit(False)))
    order = F.struct(*(["ts"] if "ts" in verdicts.columns else []), "action")
    # rows without action have no order and are passed over; a filter would compute the action twice
    one = verdicts.groupBy(key).agg(F.max_by("action", F.when(F.col("action").isNotNull(), order)).alias("__action"))
    answers = one.select(F.col(key).alias("__key"), "__action")
    joined = rows.join(answers, (rows[key] == answers["__key"]) & rows["__ask"], "left")
    routed = joined.withColumn("__r", route("score", "__action"))
    return routed.select(*scored.columns, "__r.*", F.col("__action").isNotNull().alias("enhanced"))


def decision_log(
    decisions: DataFrame, execution_id: str = "execution_id", columns: Sequence[str] = ()
) -> DataFrame:
    """Log line of every decision, with defaults for what is missing.

    The whole text is not kept, only its first 100 characters.  A decision
    without ``ts`` is logged under the time of the run; ``day`` is for the
    folders of the written log.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    at = F.coalesce(F.col("ts").cast("timestamp_ntz"), now) if "ts" in decisions.columns else now
    missing = lambda name, default: (
        F.coalesce(F.col(name), F.lit(default)) if name in decisions.columns else F.lit(default)
    )
    return decisions.select(
        *columns,
        at.alias("ts"),
        F.to_date(at).alias("day"),
        missing(execution_id, "unknown").alias("execution_id"),
        preview(missing("text", "")).alias("text_preview"),
        missing("score", 0.0).cast("double").alias("ml_score"),
        missing("action", "unknown").alias("action"),
        missing("confidence", "unknown").alias("confidence"),
        missing("reasoning", "").alias("reasoning"),
        missing("enhanced", False).alias("enhanced"),
    )


def blocked_alerts(decisions: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One alert per blocked row, batch or stream; needs only the decision."""
    return decisions.filter(F.col("final_decision") == "BLOCKED").select(
        *columns, F.lit(K.ALERT_SUBJECT).alias("subject"), F.col("reasoning").alias("message")
    )


def format_result_line(text: str = "text", score: str = "score"):
    """One line for people: label, percentage, confidence and the start of the text."""
    d = decide(score, "binary")
    label = F.when(d["is_toxic"], "TOXIC").otherwise("SAFE")
    line = F.format_string(
        '%s (%s) - %s confidence\n   Text: "%s"',
        label, percent_text(score), d["confidence"], preview(text, 100, "if_longer"),
    )
    return F.when(number(score).isNull(), F.lit("Error: no score")).otherwise(line)


def format_result_json(text: str = "text", score: str = "score"):
    """One JSON object per result, with status and error."""
    d = decide(score, "binary")
    failed = number(score).isNull()
    return F.to_json(
        F.struct(
            F.col(text).alias("text"),
            number(score).alias("toxicity_score"),
            F.coalesce(d["is_toxic"], F.lit(False)).alias("is_toxic"),
            d["confidence"].alias("confidence"),
            F.when(failed, "error").otherwise("success").alias("status"),
            F.when(failed, "no score").alias("error"),
        )
    )
