"""Append-only registry of models, pipelines, runs and endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions.scores import epoch_seconds, last_part

# fixed values: order in which kinds of models are preferred
PRIORITY = ("pipeline", "legacy_pipeline", "standalone", "legacy")


def registry_rows(
    df: DataFrame,
    kind: Column | str,
    name: Column | str,
    payload: Column,
    ts: Column | str,
    status: Column | None = None,
    extra: Column | None = None,
) -> DataFrame:
    """Registry rows with a time-stamped key; extra entries win over the payload's.

    Both maps are merged, so a key given twice keeps the extra value.
    """
    merged = payload
    if extra is not None:
        kept = F.map_filter(payload, lambda k, v: ~F.map_contains_key(extra, k))
        merged = F.when(extra.isNull(), payload).otherwise(F.map_concat(kept, extra))
    kind, name, ts = (F.col(c) if isinstance(c, str) else c for c in (kind, name, ts))
    return df.select(
        kind.alias("kind"),
        name.alias("name"),
        merged.alias("payload"),
        (status if status is not None else F.lit("deployed")).alias("status"),
        ts.alias("ts"),
        F.concat(kind, F.lit("_info_"), epoch_seconds(ts).cast("string")).alias("key"),
    )


def register_model(df: DataFrame, name: Column | str, ts: Column | str, payload: Column) -> DataFrame:
    """A new package, pending approval."""
    return registry_rows(df, F.lit("package"), name, payload, ts, F.lit(K.PENDING))


def current_state(registry: DataFrame) -> DataFrame:
    """The newest row of every registered name: one max per name, no sort."""
    order = F.struct("ts", "status")
    row = F.struct("payload", "status", "ts")
    created = F.min("ts").alias("created")
    newest = registry.groupBy("kind", "name").agg(F.max_by(row, order).alias("r"), created)
    return newest.select("kind", "name", "r.payload", "r.status", "r.ts", "created")


def latest_pending(registry: DataFrame, group: str | None = None) -> DataFrame:
    """The pending package created last."""
    pending = current_state(registry).filter(
        (F.col("kind") == "package") & (F.col("status") == K.PENDING)
    )
    return pending.orderBy(F.desc("created"), F.desc("name")).limit(1)


def approve_latest(registry: DataFrame, ts: Column) -> DataFrame:
    """The approval row of the latest pending package; append it to the registry."""
    return latest_pending(registry).select(
        "kind", "name", "payload", F.lit(K.APPROVED).alias("status"), ts.alias("ts")
    )


def approved_model(registry: DataFrame) -> DataFrame:
    """The package approved last, of those that still are."""
    packages = current_state(registry).filter((F.col("kind") == "package") & (F.col("status") == K.APPROVED))
    return packages.orderBy(F.desc("ts"), F.desc("name")).limit(1)


def list_models(registry: DataFrame) -> DataFrame:
    """All packages with their current status, newest first."""
    packages = current_state(registry).filter(F.col("kind") == "package")
    return packages.select("name", "status", "created").orderBy(F.desc("created"), F.desc("name"))


def latest_model(registry: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """The newest row of the first kind in the priority list that has any."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("kind"))
    ranked = registry.withColumn("priority", rank).filter(F.col("priority") > 0)
    return ranked.orderBy("priority", F.desc("ts"), F.desc("name")).limit(1)


def sync_missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the source the target lacks; append them to it."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def steps_with_jobs(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Steps with the details of the job their identifier ends in; jobs have one row each."""
    return steps.withColumn("job", last_part("job_path")).join(jobs, "job")


def flag_available(models: DataFrame, available: DataFrame, key: str = "model") -> DataFrame:
    """Known models with a mark for those that can be reached."""
    seen = available.select(key).distinct().withColumn("__hit", F.lit(True))
    return models.join(seen, key, "left").withColumn(
        "available", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")
