"""Text features, risk record and risk flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import col, dbl
from textwarden.functions.text import (
    count_of,
    has_listed_word,
    strip_space,
    word_count,
)


def text_features(c: Column | str) -> Column:
    """The eight features of a cleaned text."""
    c = col(c)
    words = word_count(c)
    letters = F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.struct(
        F.length(c).alias("length"),
        words.alias("word_count"),
        c.rlike("[A-Z]{3,}").alias("has_caps"),
        c.rlike(r"(.)\1{3,}").alias("has_repeated_chars"),
        count_of(c, "!").alias("exclamation_count"),
        count_of(c, "?").alias("question_count"),
        c.rlike(r"\p{Nd}").alias("has_numbers"),
        (letters.cast("double") / F.greatest(words, F.lit(1))).alias("avg_word_length"),
    )


def risk_record(features: Column | str, offensive: Column) -> Column:
    """Weighted risk score, the rules hit in order, and the human-review mark."""
    f = col(features)
    too_long = f["length"] > K.RISK_LONG_ABOVE
    too_short = f["length"] < K.RISK_SHORT_BELOW
    # fixed values: rule, name, weight
    rules = [
        (too_long, "very_long_text", 1),
        (~too_long & too_short, "very_short_text", 1),
        (f["has_caps"], "excessive_caps", 2),
        (f["has_repeated_chars"], "repeated_characters", 1),
        (f["exclamation_count"] > K.RISK_EXCLAMATIONS_ABOVE, "excessive_exclamations", 1),
        (offensive, "potential_offensive_language", 3),
    ]
    score = sum((F.when(hit, weight).otherwise(0) for hit, _, weight in rules), F.lit(0))
    names = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name, _ in rules]))
    return F.struct(
        score.alias("risk_score"),
        names.alias("indicators"),
        (score > K.RISK_REVIEW_ABOVE).alias("needs_human_review"),
    )


def risk_of_text(c: Column | str) -> Column:
    """Risk record of a cleaned text without a separate feature column."""
    return risk_record(text_features(c), has_listed_word(c))


def risk_flags(c: Column | str) -> Column:
    """The five flags the score policies read."""
    c = col(c)
    stripped = F.length(strip_space(c))
    return F.struct(
        (F.regexp_count(c, F.lit(r"\p{IsUppercase}")) > dbl(0.5) * F.length(c)).alias("excessive_caps"),
        (count_of(c, "!") + count_of(c, "?") > 5).alias("excessive_punctuation"),
        c.rlike(r"([a-z])\1{3}").alias("repeated_chars"),
        (stripped < 10).alias("very_short"),
        (stripped > 1000).alias("very_long"),
    )
