"""Score arithmetic, ratios, labels and identifiers."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import col, dbl


def clamp(x: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Bring a number into [lo, hi]; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNull(), x).otherwise(F.greatest(dbl(lo), F.least(dbl(hi), x)))


def number(c: Column | str) -> Column:
    """A score as double; NaN and infinite values are no scores and become NULL."""
    x = col(c).cast("double")
    # NaN is above every number here
    return F.when(F.abs(x) <= dbl(sys.float_info.max), x)


def blend(ml: Column | str, verdict: Column | str, enhanced: Column | str) -> Column:
    """Weighted mean of verdict and model score where a verdict exists."""
    mixed = dbl(K.VERDICT_WEIGHT) * col(verdict) + dbl(K.MODEL_WEIGHT) * col(ml)
    return F.when(col(enhanced), mixed).otherwise(col(ml))


def bump(score: Column | str, flags: Column | str) -> Column:
    """Raise a score for capitals and for punctuation, without clamping."""
    flags = col(flags)
    caps = F.when(flags["excessive_caps"], dbl(K.CAPS_BUMP)).otherwise(dbl(0))
    marks = F.when(flags["excessive_punctuation"], dbl(K.PUNCTUATION_BUMP)).otherwise(dbl(0))
    return col(score) + caps + marks


def score_difference(a: Column | str, b: Column | str) -> Column:
    return F.abs(col(a) - col(b))


def is_toxic(score: Column | str, threshold: float = K.TOXIC_ABOVE) -> Column:
    return number(score) > dbl(threshold)


def distance_confidence(score: Column | str) -> Column:
    """HIGH far from the middle, MEDIUM near it, LOW without a score."""
    return distance_of(number(score))


def distance_of(s: Column) -> Column:
    """As distance_confidence, for a score known to be finite or NULL."""
    return (
        F.when(s.isNull(), "LOW")
        .when(F.abs(s - dbl(0.5)) > dbl(0.3), "HIGH")
        .otherwise("MEDIUM")
    )


def borderline(
    score: Column | str, lo: float = K.BORDERLINE[0], hi: float = K.BORDERLINE[1], hi_closed: bool = False
) -> Column:
    """Between the limits; the upper one counts only if asked for."""
    s = number(score)
    return (s > dbl(lo)) & ((s <= dbl(hi)) if hi_closed else (s < dbl(hi)))


def safe_ratio(n: Column | str, d: Column | str) -> Column:
    """n / d as double, 0 where the denominator is not positive."""
    n, d = col(n).cast("double"), col(d).cast("double")
    return F.when(d > 0, n / d).otherwise(dbl(0))


def percent_text(ratio: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(ratio) * dbl(100))


def status_bucket(pct: Column | str, ok: float = 80.0, warn: float = 50.0) -> Column:
    p = col(pct)
    return F.when(p >= dbl(ok), "ok").when(p >= dbl(warn), "warn").otherwise("bad")


def duration_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two times."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1000).cast("bigint")


def iso_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def plain_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def last_part(c: Column | str, sep: str = "/") -> Column:
    """The part of an identifier after its last separator."""
    return F.substring_index(col(c), sep, -1)


def any_contains(arr: Column | str, s: str) -> Column:
    """True if any element holds the text, ignoring case."""
    needle = s.lower()
    return F.exists(col(arr), lambda x: F.lower(x).contains(needle))
