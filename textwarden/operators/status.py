"""Step status over time: changes and final states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.ordering import with_previous


def status_changes(
    events: DataFrame, by: Sequence[str] = ("step",), order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """The events whose status differs from the one before, per step; the first counts."""
    marked = with_previous(events, by, order, "status", "previous_status")
    changed = ~F.col("has_previous_status") | ~F.col("status").eqNullSafe(F.col("previous_status"))
    return marked.filter(changed).drop("has_previous_status")


def final_status(
    events: DataFrame, by: Sequence[str] = ("step",), order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Last status and failure reason per step, and whether that ends it.

    The newest row comes from one aggregate; no group is sorted.
    """
    boxed = F.struct("status", "failure_reason")
    last = events.groupBy(*by).agg(
        F.max_by(boxed, F.struct(*order)).alias("last"),
        F.max(order[0]).alias("last_ts"),
        F.count("*").alias("events"),
    )
    status = F.col("last.status")
    return last.select(
        *by,
        status.alias("status"),
        F.when(status == "Failed", F.col("last.failure_reason")).alias("failure_reason"),
        F.coalesce(status.isin(*K.TERMINAL_STATES), F.lit(False)).alias("terminal"),
        "last_ts",
        "events",
    )


def run_summary(finals: DataFrame) -> DataFrame:
    """Steps per final status."""
    return finals.groupBy("status").agg(F.count("*").alias("steps"))
