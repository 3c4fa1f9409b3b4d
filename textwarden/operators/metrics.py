"""Metric points of decisions, their windows, rates and log counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import dbl
from textwarden.functions.scores import safe_ratio
from textwarden.operators.evaluate import one_row


def _point(name: str, value: Column, unit: str, dims: Column, when: Column | None = None) -> Column:
    point = F.struct(
        F.lit(name).alias("name"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        dims.alias("dims"),
    )
    return F.when(F.lit(True) if when is None else when, point)


def _explode(decisions: DataFrame, points: list[Column]) -> DataFrame:
    exploded = decisions.select(
        "ts", F.explode(F.filter(F.array(*points), lambda p: p.isNotNull())).alias("p")
    )
    return exploded.select("ts", "p.name", "p.value", "p.unit", "p.dims")


def _environment(name: str) -> Column:
    return F.create_map(F.lit("Environment"), F.lit(name))


def decision_metrics(decisions: DataFrame, environment: str = "Production") -> DataFrame:
    """Metric points of every decision.

    Needs ts, action, confidence, latency_ms, enhanced and reviewer_latency_ms.
    A failed second opinion counts, but has no latency.  The share of high
    confidence is a point of its own, see high_confidence_pct.
    """
    dims = _environment(environment)
    one = F.lit(1.0)
    # fixed values: metric names and units
    points = [
        _point("ToxicityPredictionCount", one, "Count", dims),
        _point("ToxicityPredictionLatency", F.col("latency_ms"), "Milliseconds", dims),
        _point("HighConfidenceCount", one, "Count", dims, F.col("confidence") == "high"),
        _point("ContentBlockedCount", one, "Count", dims, F.col("action") == "block"),
        _point("ContentReviewCount", one, "Count", dims, F.col("action") == "review"),
        _point("SecondOpinionCount", one, "Count", dims, F.col("routed")),
        _point(
            "SecondOpinionLatency", F.col("reviewer_latency_ms"), "Milliseconds", dims, F.col("enhanced")
        ),
    ]
    return _explode(decisions, points)


def request_metrics(decisions: DataFrame) -> DataFrame:
    """Metric points of the online path; the decision point carries its action.

    Rows may say in ``failure`` that the model (``model``) or the request
    (anything else) failed; such a row has no decision.
    """
    failure = F.col("failure") if "failure" in decisions.columns else F.lit(None).cast("string")
    reviewed = (
        F.col("reviewer_latency_ms") if "reviewer_latency_ms" in decisions.columns else F.lit(None).cast("double")
    )
    none = F.create_map().cast("map<string,string>")
    by_action = F.create_map(
        F.lit("Action"), F.col("action"), F.lit("Confidence"), F.col("confidence")
    )
    one = F.lit(1.0)
    # fixed values: metric names and units
    points = [
        _point("PredictionRequestStart", one, "Count", none),
        _point("PredictionLatency", F.col("latency_ms"), "Milliseconds", none),
        _point("ToxicityScore", F.col("score"), "None", none),
        _point("SecondOpinionSuccess", one, "Count", none, F.col("enhanced")),
        _point("SecondOpinionError", one, "Count", none, F.col("routed") & ~F.col("enhanced")),
        _point("SecondOpinionLatency", reviewed, "Milliseconds", none, F.col("enhanced") & reviewed.isNotNull()),
        _point("ModerationDecision", one, "Count", by_action, failure.isNull()),
        _point("ModelError", one, "Count", none, failure == "model"),
        _point("PredictionError", one, "Count", none, failure != "model"),
    ]
    return _explode(decisions, points)


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Points, sum and mean per metric name."""
    return metrics.groupBy("name").agg(
        F.count("*").alias("points"), F.sum("value").alias("total"), F.avg("value").alias("mean")
    )


def windowed_stat(
    metrics: DataFrame, window: str = "5 minutes", stat: str | None = None, names: tuple[str, ...] = ()
) -> DataFrame:
    """Sum, mean, least, greatest and count per window and name, or one of them.

    Partial sums per window and name are built before the shuffle, so a hot
    metric costs one row per window and task.
    """
    kept = metrics.filter(F.col("name").isin(*names)) if names else metrics
    stats = {
        "Sum": F.sum("value"), "Average": F.avg("value"), "Minimum": F.min("value"),
        "Maximum": F.max("value"), "SampleCount": F.count("value").cast("double"),
    }
    chosen = [stats[stat].alias("value")] if stat else [v.alias(k.lower()) for k, v in stats.items()]
    grouped = kept.groupBy(F.window("ts", window).alias("w"), "name").agg(*chosen)
    return grouped.select(F.col("w.start").alias("window_start"), *grouped.columns[1:])


def high_confidence_pct(
    decisions: DataFrame, window: str = "5 minutes", environment: str = "Production"
) -> DataFrame:
    """Share of high-confidence decisions per window, in percent: a metric point per window."""
    hit = F.col("confidence") == "high"
    return _percent(decisions, window, "HighConfidencePredictions", hit, F.lit(True), environment)


def false_positive_pct(
    decisions: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    window: str = "15 minutes",
    environment: str = "Production",
) -> DataFrame:
    """Share of harmless rows that were flagged, per window, in percent: a point per window."""
    return false_positive_points(decisions.join(labels.select(key, "label"), key), window, environment)


def false_positive_points(labelled: DataFrame, window: str = "15 minutes", environment: str = "Production") -> DataFrame:
    """The same from decisions that carry their label, batch or stream."""
    flagged = F.col("action") != "allow"
    return _percent(labelled, window, "FalsePositiveRate", flagged, F.col("label") == 0, environment)


def _percent(df: DataFrame, window: str, name: str, hit: Column, among: Column, environment: str) -> DataFrame:
    counts = df.groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(hit & among).alias("hits"), F.count_if(among).alias("among")
    )
    return counts.select(
        F.col("w.start").alias("ts"),
        F.lit(name).alias("name"),
        (dbl(100) * safe_ratio("hits", "among")).alias("value"),
        F.lit("Percent").alias("unit"),
        _environment(environment).alias("dims"),
        "among",
    )


def alarm_feed(decisions: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """All points the default alarms watch: those of the decisions and the two shares.

    A share without rows to count has no point.
    """
    columns = ("ts", "name", "value", "unit", "dims")
    points = decision_metrics(decisions).select(*columns)
    shares = high_confidence_pct(decisions).unionByName(false_positive_pct(decisions, labels, key))
    return points.unionByName(shares.filter("among > 0").select(*columns))


def metric_names(metrics: DataFrame, first: int = 5) -> DataFrame:
    """Number of distinct names and the first few in alphabetical order."""
    names = metrics.select("name").distinct()
    total = names.agg(F.count("*").alias("n_names"))
    head = names.orderBy("name").limit(first).agg(F.sort_array(F.collect_list("name")).alias("first"))
    return one_row(total, head)


def count_log_patterns(
    logs: DataFrame, patterns: Sequence[tuple[str, str, str]], window: str = "5 minutes"
) -> DataFrame:
    """Log lines per window and pattern, all patterns in one pass.

    A pattern is (column name, level, start of the message).  Windows without a
    line of a pattern count 0.
    """
    hits = [
        F.count_if((F.col("level") == level) & F.col("message").startswith(prefix)).alias(name)
        for name, level, prefix in patterns
    ]
    counted = logs.groupBy(F.window("ts", window).alias("w")).agg(*hits)
    return counted.select(F.col("w.start").alias("window_start"), *[name for name, _, _ in patterns])


def apply_retention(
    df: DataFrame,
    as_of: Column,
    days_by_stream: dict[str, int] = K.RETENTION_DAYS,
    stream: str = "stream",
) -> DataFrame:
    """Keep what is not older than the days of its stream; unknown streams keep all.

    Stated as alternatives of plain comparisons, which a Parquet scan can use to
    skip row groups and date partitions.
    """
    name = F.col(stream)
    keep = name.isNull() | ~name.isin(*days_by_stream)
    for known, days in days_by_stream.items():
        keep = keep | ((name == known) & (F.col("ts") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")))
    return df.filter(keep)
