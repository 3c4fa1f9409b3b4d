"""Unions, splits, folds and sampling that any engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.text import text_variants
from textwarden.operators.ordering import hash_rank, join_back, numbered, seeded_hash
from textwarden.session import materialized

SAMPLE_RATES = {1: 0.3, 0: 0.2}
FEW_CLASSES = 1000  # as many cuts are sent to every task
DRAWS_PER_BLOCK = 100_000  # draws that one task makes at a time


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All parts below each other, with the name of the part in a column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def hash_cuts(
    df: DataFrame, by: str, key: str, shares: Sequence[float], seed: int = 42, digits: int = 3
) -> DataFrame:
    """Per class (``__by``) the cuts ``__cuts``: hash and key of the row that closes each share.

    The result is what a sort of every class by hash would show at the rounded
    positions.  Only counts per hash piece and the few pieces a cut falls into
    are looked at, and only the key column is read.  One row per class, with one
    entry per share: any number of classes will do.
    """
    narrow = df.select(F.col(by).alias("__by"), F.col(key).alias("__id"))
    narrow = narrow.withColumn("__h", seeded_hash("__id", seed))
    narrow = narrow.withColumn("__piece", F.substring("__h", 1, digits))
    sizes = narrow.groupBy("__by", "__piece").agg(F.count("*").alias("__n"))
    group = Window.partitionBy("__by")
    limits = F.array(*[F.round(F.lit(float(s)) * F.sum("__n").over(group)) for s in shares])
    upto = group.orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)
    wanted = (
        sizes.select("*", F.sum("__n").over(upto).alias("__upto"), limits.alias("__limits"))
        .select("*", F.posexplode("__limits").alias("__i", "__limit"))
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .filter(
            ((F.col("__limit") <= F.col("__upto")) & (F.col("__limit") > F.col("__before")))
            | ((F.col("__limit") == 0) & (F.col("__before") == 0))
        )
        .select(
            "__by", "__piece", "__i",
            (F.col("__limit") - F.col("__before")).cast("bigint").alias("__at"),
        )
    )
    pieces = wanted.filter("__at > 0").groupBy("__by", "__piece").agg(F.collect_set("__at").alias("__ats"))
    near = join_back(narrow, pieces, ["__by", "__piece"]).filter("__ats IS NOT NULL")
    order = Window.partitionBy("__by", "__piece").orderBy("__h", "__id")
    near = near.withColumn("__at", F.row_number().over(order).cast("bigint"))
    near = near.filter(F.array_contains("__ats", F.col("__at"))).select("__by", "__piece", "__at", "__h", "__id")
    # a share that rounds to no row closes before the first one
    closed = join_back(wanted, near, ["__by", "__piece", "__at"])
    cut = F.struct(F.coalesce("__h", F.lit("")).alias("h"), F.col("__id").alias("id"))
    return closed.groupBy("__by").agg(F.collect_list(cut).alias("__cuts"))


def _with_side(df: DataFrame, by: str, key: str, cuts: DataFrame, seed: int) -> DataFrame:
    """Add ``__side``: the number of cuts of its class a row lies behind.

    A shuffle by class would bring the rows of a large class into one task, so the cuts go to
    the rows where there are few classes.
    """
    of_class = cuts.withColumnRenamed("__by", "__class")
    if df.select(by).distinct().limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
        of_class = F.broadcast(of_class)
    rows = join_back(df.withColumn("__class", F.col(by)), of_class, ["__class"])
    # the hash is a column of its own, so that it is computed once per row
    rows = rows.withColumn("__h", seeded_hash(key, seed))
    beyond = lambda c: (F.col("__h") > c["h"]) | ((F.col("__h") == c["h"]) & (F.col(key) > c["id"]))
    side = F.size(F.filter("__cuts", lambda c: F.coalesce(beyond(c), F.lit(False))))
    return rows.withColumn("__side", side).drop("__h", "__cuts", "__class")


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` = test | train; each class gives its rounded share to the test part.

    Once the cuts are known every row is placed on its own, without a shuffle.
    """
    cuts = hash_cuts(df, label, key, [test_size], seed)
    sided = _with_side(df, label, key, cuts, seed)
    return sided.withColumn("split", F.when(F.col("__side") == 0, "test").otherwise("train")).drop("__side")


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add a fold number: k hash ranges per class that differ by one row at most."""
    cuts = hash_cuts(df, label, key, [i / k for i in range(1, k)], seed)
    return _with_side(df, label, key, cuts, seed).withColumnRenamed("__side", name)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "n") -> DataFrame:
    """All rows in hash order, with their place."""
    return numbered(df, [seeded_hash(key, seed), key], name)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 * n_class) per class."""
    n = df.groupBy(label).agg(F.count("*").alias("n_class"))
    # the window sees one row per class
    total = F.sum("n_class").over(Window.partitionBy(F.lit(0)))
    return n.select(label, "n_class", (total / (F.lit(2.0) * F.col("n_class"))).alias("weight"))


def _unit(text: str) -> Column:
    """A number in [0, 1) from the first eight digits of a hash."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sample_variants(
    base: DataFrame,
    key: str,
    text: str,
    label: str,
    n_per_class: int,
    rates: dict[int, float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Draw n texts of each class with replacement and vary some of them.

    The classes of the result are equally large, whatever the base has.  A draw
    takes the row whose rank the hash of the draw names; rates gives the share of
    draws per class that become one of the three variants.  Ranks and draws are
    narrow rows; the texts are joined last.
    """
    rates = rates or SAMPLE_RATES
    ranked = materialized(hash_rank(base.select(key, F.col(label).alias("__label")), ["__label"], key, seed))
    classes = ranked.groupBy("__label").agg(F.max("total").alias("__total"))
    # draws are made block by block, so that many of one class fill several tasks
    blocks = F.sequence(F.lit(0), F.lit((n_per_class - 1) // DRAWS_PER_BLOCK)) if n_per_class > 0 else F.array()
    blocks = classes.select("*", F.explode(blocks.cast("array<bigint>")).alias("__block")).repartition("__label", "__block")
    first = F.col("__block") * DRAWS_PER_BLOCK
    last = F.least(first + DRAWS_PER_BLOCK, F.lit(n_per_class)) - 1
    draws = blocks.select("__label", "__total", F.explode(F.sequence(first, last)).alias("draw_id"))
    name = F.concat_ws("-", F.col("__label").cast("string"), F.col("draw_id").cast("string"))
    pick = F.conv(F.substring(seeded_hash(name, f"row-{seed}"), 1, 12), 16, 10).cast("bigint")
    draws = draws.select(
        "__label",
        "draw_id",
        (pick % F.col("__total") + 1).alias("rank"),
        seeded_hash(name, f"vary-{seed}").alias("__vary"),
        seeded_hash(name, f"variant-{seed}").alias("__variant"),
    )
    drawn = draws.join(ranked.select("__label", "rank", key), ["__label", "rank"]).join(base.select(key, text), key)
    rate = F.lit(0.0)
    for value, share in rates.items():
        rate = F.when(F.col("__label") == value, F.lit(float(share))).otherwise(rate)
    which = (F.conv(F.substring("__variant", 1, 8), 16, 10).cast("bigint") % 3 + 1).cast("int")
    variants = F.when(F.col("__label") == 1, text_variants(text, "toxic")).otherwise(
        text_variants(text, "benign")
    )
    varied = _unit("__vary") < rate
    return drawn.select(
        F.col("__label").alias(label),
        "draw_id",
        key,
        varied.alias("varied"),
        F.when(varied, F.element_at(variants, which)).otherwise(F.col(text)).alias(text),
    )
