"""Ranks, running totals and neighbours that do not need one task per key.

A window over a whole class, metric or table would sort that group in one task.
The operators here cut each group into pieces first, work inside the pieces, and
carry the totals of the pieces before, which are one small row each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions._base import col
from textwarden.session import materialized

RANKED_TOGETHER = 50_000  # rows of a piece that hash_rank sorts together


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    """Hex digest of key and seed, the same in every engine that knows MD5."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"-{seed}")))


def _box(*columns: Column | str) -> Column:
    """Columns as one key that is never NULL; NULL fields of two keys are equal.

    Windows and joins on the same key share one shuffle.
    """
    return F.struct(*columns)


def join_back(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL; the right side brings one row per key."""
    right = small.select(_box(*keys).alias("__key"), *[c for c in small.columns if c not in keys])
    return rows.withColumn("__key", _box(*keys)).join(right, "__key", "left").drop("__key")


def hash_rank(
    df: DataFrame, by: Sequence[str], key: str, seed: int | str = 42, digits: int | None = None
) -> DataFrame:
    """Add ``rank`` (1-based, in hash order, per group) and ``total`` (group size).

    The first hex digits of the hash cut every group into 16**digits even
    pieces, by default as many that a piece has RANKED_TOGETHER rows at most, so a
    group of any size spreads over the cluster; pieces are ranked on their own and
    shifted by the row counts of the pieces before.
    """
    by = list(by)
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, df.count()) / RANKED_TOGETHER, 16)))
    hashed = df.withColumn("__h", seeded_hash(key, seed))
    hashed = hashed.withColumn("__piece", F.substring("__h", 1, digits))
    keyed = hashed.withColumn("__key", _box(*by, "__piece"))
    sizes = keyed.groupBy("__key").agg(F.count("*").alias("__n")).select("__key", "__key.*", "__n")
    # one row per piece and group: 16**digits rows at most in a window partition
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__key",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy("__key").orderBy("__h", key)
    ranked = keyed.withColumn("__i", F.row_number().over(inside))
    return (
        ranked.join(offsets, "__key")
        .withColumn("rank", F.col("__before") + F.col("__i"))
        .drop("__key", "__h", "__piece", "__i", "__before")
    )


def numbered(df: DataFrame, order_by: Sequence[Column | str], name: str = "n") -> DataFrame:
    """Number all rows from 1 in a total order.

    The rows are cut by range and stored once; each piece is numbered on its own
    and shifted by the sizes of those before it.  ``order_by`` should end in a
    unique column.
    """
    stored = materialized(df.repartitionByRange(*order_by))
    placed = stored.withColumn("__part", F.spark_partition_id())
    placed = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*order_by)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per stored partition
    offsets = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__i"))
        .drop("__part", "__i", "__before")
    )


def running_sums(
    df: DataFrame, by: Sequence[str], order_by: str, columns: Sequence[str]
) -> DataFrame:
    """Add ``before_<column>``: the sum over smaller ``order_by`` values of the group.

    ``order_by`` must be unique within its group: aggregate equal values first.
    """
    by = list(by)
    stored = materialized(df.repartitionByRange(*by, order_by))
    placed = stored.withColumn("__part", F.spark_partition_id()).withColumn("__key", _box(*by, "__part"))
    totals = placed.groupBy("__key").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    totals = totals.select("*", "__key.*")
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__key", *[F.coalesce(F.sum(f"__{c}").over(upto), F.lit(0)).alias(f"__o_{c}") for c in columns]
    )
    inside = Window.partitionBy("__key").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{c}") for c in columns]
    )
    out = summed.join(offsets, "__key")
    for c in columns:
        out = out.withColumn(f"before_{c}", F.col(f"__o_{c}") + F.col(f"__i_{c}"))
    return out.drop("__key", "__part", *[f"__{p}_{c}" for c in columns for p in "oi"])


def with_previous(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str], value: str, name: str = "previous"
) -> DataFrame:
    """Add the value of the row before, per key, and whether there is one.

    The rows are cut by range, so a busy key fills several pieces and pieces
    follow the number of rows.  Inside a piece the neighbour comes from a window,
    the first row of a piece takes the last value of the piece before, which is
    one row per piece and key.  Rows without a time come first.
    """
    by = list(by)
    stored = materialized(df.repartitionByRange(*by, *order_by))
    cut = stored.withColumn("__part", F.spark_partition_id()).withColumn("__key", _box(*by, "__part"))
    boxed = F.struct(F.col(value).alias("v"))
    order = F.struct(*order_by)
    last = cut.groupBy("__key").agg(F.max_by(boxed, order).alias("__last")).select("*", "__key.*")
    carry = last.select(
        "__key", F.lag("__last").over(Window.partitionBy(*by).orderBy("__part")).alias("__carry")
    )
    inside = Window.partitionBy("__key").orderBy(*order_by)
    near = cut.withColumn("__near", F.lag(boxed).over(inside))
    out = near.join(carry, "__key")
    found = F.coalesce("__near", "__carry")
    return (
        out.withColumn(name, found["v"])
        .withColumn(f"has_{name}", found.isNotNull())
        .drop("__key", "__part", "__near", "__carry")
    )


def last_n(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], n: int = 5
) -> DataFrame:
    """The first n rows of each group in the given order, with their number.

    Spark keeps only n rows of a group per task before it shuffles them.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
