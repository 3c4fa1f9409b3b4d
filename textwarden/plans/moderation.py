"""The whole moderation plan: clean, classify, describe, score, ask, decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import dbl
from textwarden.functions.features import risk_flags, risk_record, text_features
from textwarden.functions.payload import classify_request
from textwarden.functions.scores import number
from textwarden.functions.text import clean_text, has_listed_word
from textwarden.functions.verdicts import model_only_verdict
from textwarden.operators.decisions import attach_verdicts, decide_enhanced


def prepare(
    df: DataFrame, text: str = "text", risk_on: str = "clean", max_len: int | None = None
) -> DataFrame:
    """Add cleaned text, outcome, features, risk record and flags.

    Each step reads the columns of the one before, so the cleaning runs once per
    row; nothing here moves rows.
    """
    if risk_on not in ("clean", "raw"):
        raise ValueError(f"unknown risk source: {risk_on}")
    cleaned = df.withColumn("cleaned", clean_text(text))
    described = cleaned.select(
        "*",
        classify_request(text, "cleaned", max_len).alias("outcome"),
        text_features("cleaned").alias("features"),
        has_listed_word("cleaned").alias("__offensive"),
        risk_flags("cleaned" if risk_on == "clean" else text).alias("flags"),
    )
    return described.withColumn("risk", risk_record("features", F.col("__offensive"))).drop(
        "__offensive"
    )


def moderate(
    prepared: DataFrame, verdicts: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """Decide every prepared row that has a ``score``.

    Rows that are not to be scored keep their outcome: too short ones are
    allowed, rejected ones get no action.  No row is dropped.
    """
    scored = F.col("outcome") == "scored"
    rows = prepared.withColumn("score", F.when(scored, F.col("score").cast("double")))
    if verdicts is None:
        own = rows.withColumn("routed", F.lit(False)).withColumn("verdict", model_only_verdict("score"))
        attached = own.withColumn("enhanced", F.lit(False))
    else:
        attached = attach_verdicts(rows, verdicts, key)
    decided = decide_enhanced(attached)
    short = F.col("outcome") == "too_short"
    keep = lambda value, short_value: F.when(scored, value).when(short, short_value)
    return (
        decided.withColumn("final_score", keep(F.col("final_score"), dbl(0)))
        .withColumn("action", keep(F.col("action"), F.lit("allow")))
        .withColumn("confidence", keep(F.col("confidence"), F.lit("high")))
        .withColumn("is_toxic", keep(F.col("is_toxic"), F.lit(False)))
        .withColumn("threshold", F.when(scored, F.col("threshold")))
        .withColumn("reason", keep(F.col("reason"), F.lit(K.TOO_SHORT_REASON)))
        .withColumn(
            "error",
            F.when(F.col("outcome").startswith("invalid"), K.NO_TEXT_ERROR)
            .when(F.col("outcome") == "empty_after_clean", K.NOTHING_LEFT_ERROR)
            .when(scored & number("score").isNull(), "no score"),
        )
    )
