"""Summaries of results, checks and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions._base import dbl
from textwarden.functions.scores import is_toxic, safe_ratio, status_bucket
from textwarden.functions.text import preview, title_label


def toxic_summary(results: DataFrame, score: str = "score") -> DataFrame:
    """Toxic rows out of all."""
    return results.agg(F.count_if(is_toxic(score)).alias("toxic"), F.count("*").alias("total"))


def latency_summary(results: DataFrame) -> DataFrame:
    """Latency of the successes; success and reviewer rates over all cases.

    Needs status, latency_ms and enhanced.
    """
    ok = F.col("status") == "success"
    latency = F.when(ok, F.col("latency_ms"))
    return results.agg(
        F.coalesce(F.avg(latency), dbl(0)).alias("avg_latency_ms"),
        F.coalesce(F.min(latency), dbl(0)).alias("min_latency_ms"),
        F.coalesce(F.max(latency), dbl(0)).alias("max_latency_ms"),
        safe_ratio(F.count_if(ok), F.count("*")).alias("success_rate"),
        safe_ratio(F.count_if(ok & F.col("enhanced")), F.count("*")).alias("reviewer_rate"),
    )


def pass_rate_report(checks: DataFrame) -> DataFrame:
    """Passed and total checks per category and overall, with rate and status.

    The rollup works on one row per category.
    """
    parts = checks.groupBy("category").agg(
        F.count_if(F.col("status") == "passed").alias("passed"), F.count("*").alias("total")
    )
    sums = parts.rollup("category").agg(
        F.grouping_id().alias("level"), F.sum("passed").alias("passed"), F.sum("total").alias("total")
    )
    rate = safe_ratio("passed", "total") * dbl(100)
    overall = F.col("level") == 1
    return sums.select(
        F.when(overall, "overall").otherwise(F.col("category")).alias("category"),
        F.when(overall, "Overall").otherwise(title_label("category")).alias("title"),
        "passed",
        "total",
        rate.alias("rate"),
        F.when(overall, status_bucket(rate, 90, 70)).otherwise(status_bucket(rate)).alias("status"),
    )


def failed_checks(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("status") == "failed")


def top_failures(checks: DataFrame, k: int = 5) -> DataFrame:
    """The first failed checks by category and name, with a shortened error."""
    error = F.coalesce("error", F.lit("Unknown error"))
    return (
        failed_checks(checks)
        .select("category", "test", preview(error, 100, "always").alias("error"))
        .orderBy("category", "test")
        .limit(k)
    )


def decision_cube(decisions: DataFrame) -> DataFrame:
    """Decisions per action and confidence, with all marginals.

    The cube works on one row per action and confidence.
    """
    counts = decisions.groupBy("action", "confidence").agg(F.count("*").alias("n"))
    sums = counts.cube("action", "confidence").agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))
    return sums.select(
        F.when(F.col("level").isin(2, 3), "all").otherwise(F.col("action")).alias("action"),
        F.when(F.col("level").isin(1, 3), "all").otherwise(F.col("confidence")).alias("confidence"),
        "n",
    )
