"""Mixing sources to target weights: rake token weights to marginals, then sample by them.

Documents are summed to cells, one per combination of the dimensions.  Iterative
proportional fitting scales the cells' weights to the target share of each value, one
dimension after the other, sweep by sweep.  A document's inclusion probability is its
cell's fitted weight per token, scaled so that the largest is at most 1: the expected
sample has the target mix, whatever a hot source or language holds.

``sized_cells``, which the queries and the pipeline use, draws an expected number of tokens
that is given: cells with less than their part are kept whole, and the others are fitted again
to what they leave, so that a rare cell costs the others nothing.  ``calibrated_cells`` keeps
the mix exactly, for whom that is worth a sample as small as its rarest cell allows.

Only sums per cell are shuffled after the first aggregation.  All of it is DataFrame
functions.  Null values of a dimension are a value like any other; null texts have no
tokens; cells without tokens are not sampled.  The draw depends on the id alone, so
repeated rows stay or go together; a null id draws like an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.store import stored

SWEEPS = 16
SWEEPS_A_JOB = 4
ALPHA = 0.7  # target share of a value ~ its share of tokens to this power
DIGITS = 1e9  # probabilities are rounded to this part


def token_weight(text: str) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: str) -> Column:
    """A coarse topic by marks in the text; the first that fits."""
    c = F.col(text)
    return (
        F.when(c.isNull(), "none").when(c.contains("|"), "table").when(c.contains("!!"), "shout")
        .when(c.contains("@"), "contact").when(F.length(c) < 500, "note").otherwise("prose")
    )


def tempered(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """Target shares (value, share) of a dimension: token shares to a power, normalised."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("n"))
    parts = sums.select("value", F.when(F.col("n") > 0, F.pow("n", F.lit(alpha))).otherwise(0.0).alias("share"))
    total = parts.agg(F.sum("share")).first()[0] or 1.0
    return parts.select("value", (F.col("share") / F.lit(float(total))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Adds ``weight``: the cells' shares of all tokens, fitted to the target shares.

    ``cells``: the dimensions and tokens.  A value without target gets no weight; target
    shares of values that no cell has are left out of the sum.
    """
    for dim, target in targets.items():
        t = target.select(F.col("value").alias("__v"), F.col("share").alias(f"__t_{dim}"))
        cells = cells.join(t, cells[dim].eqNullSafe(t["__v"]), "left").drop("__v")
        cells = cells.withColumn(f"__t_{dim}", F.coalesce(f"__t_{dim}", F.lit(0.0)))
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for i in range(sweeps):
        for dim in targets:
            now = F.sum("weight").over(Window.partitionBy(dim))
            scaled = F.when(now > 0, F.col("weight") * F.col(f"__t_{dim}") / now).otherwise(0.0)
            fitted = fitted.withColumn("weight", scaled)
        if (i + 1) % SWEEPS_A_JOB == 0 or i + 1 == sweeps:
            fitted = stored(fitted, "raked")
    return fitted.drop(*(f"__t_{dim}" for dim in targets))


def residual(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a fitted and a target share."""
    off = []
    for dim, target in targets.items():
        have = fitted.groupBy(F.col(dim).alias("value")).agg(F.sum("weight").alias("w"))
        both = have.join(target.select(F.col("value").alias("v"), "share"), F.col("value").eqNullSafe(F.col("v")))
        off.append(both.agg(F.max(F.abs(F.col("w") - F.col("share"))).alias("off")))
    return reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0] or 0.0


def inclusion(fitted: DataFrame, fraction: float = 1.0) -> DataFrame:
    """Adds ``p``, the inclusion probability of a cell's documents, for at most this part of all tokens."""
    per_token = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rated = fitted.withColumn("__r", per_token)
    top, tokens, weight = rated.agg(F.max("__r"), F.sum("tokens"), F.sum("weight")).first()
    scale = min(1.0 / top, fraction * tokens / weight) if top else 0.0
    p = F.least(F.lit(1.0), F.floor(F.col("__r") * F.lit(scale) * F.lit(DIGITS) + F.lit(0.500001)) / F.lit(DIGITS))
    return rated.withColumn("p", p).drop("__r")


def draw(key: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrated_cells(sums: DataFrame, alpha: float = ALPHA, fraction: float = 1.0) -> DataFrame:
    """The cells with weight and p.  ``sums``: one row per cell, the dimensions and tokens."""
    cells = stored(sums, "cells")
    dims = [c for c in cells.columns if c != "tokens"]
    return inclusion(rake(cells, {d: tempered(cells, d, alpha) for d in dims}), fraction)


def water_level(rows: DataFrame, cap: str, weight: str, total: float) -> float:
    """The factor for the weights at which they, each up to its cap, sum to the total.

    The largest factor that still changes a weight, if the caps sum to no more than the total.
    """
    level, some = 0.0, rows.filter(F.col(weight) > 0)
    while True:
        full = F.col(cap) <= F.col(weight) * F.lit(level)
        held, free, most = some.agg(
            F.sum(F.when(full, F.col(cap)).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col(weight))),
            F.max(F.col(cap) / F.col(weight)),
        ).first()
        if not free:
            return most or 0.0
        now = (total - held) / free
        # a factor from below: what is full at it is full at the right one
        if now <= level * (1 + 1e-12):
            return level
        level = now


def available(targets: dict[str, DataFrame], tokens: float) -> float:
    """Tokens left if no value had more than its target share of all; the least of the dimensions."""
    left = [t.agg(F.sum(F.least("n", F.col("share") * F.lit(float(tokens))))).first()[0] for t in targets.values()]
    return min(x or 0.0 for x in left)


def fit_capped(cells: DataFrame, targets: dict[str, DataFrame], size: float, sweeps: int = SWEEPS) -> DataFrame:
    """Adds ``weight``: tokens expected of a cell, at most its own, ``size`` in all.

    ``targets``: value, n (its tokens) and share.  A value that has less than its share of the
    size is kept whole, the others share the rest.
    """
    for dim, target in targets.items():
        level = water_level(target, "n", "share", size)
        part = F.least(F.col("n").cast("double"), F.col("share") * F.lit(level))
        t = target.select(F.col("value").alias("__v"), part.alias(f"__t_{dim}"))
        cells = cells.join(t, cells[dim].eqNullSafe(t["__v"]), "left").drop("__v")
    fitted = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "capped")
    for i in range(sweeps):
        for dim in targets:
            # cells in the order in which they fill up; a factor fills those before a row and
            # gives the rest their part, and the right one is the largest of these
            order = Window.partitionBy(dim).orderBy("__full")
            before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
            full = F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")).otherwise(0.0)
            fitted = fitted.withColumn("__full", full).withColumn("__before", before).withColumn("__rest", rest)
            factor = F.when(F.col("__rest") > 0, (F.col(f"__t_{dim}") - F.col("__before")) / F.col("__rest"))
            factor = F.coalesce(F.max(factor).over(Window.partitionBy(dim)), F.lit(0.0))
            fitted = fitted.withColumn("weight", F.col("weight") * F.greatest(factor, F.lit(0.0)))
            fitted = fitted.drop("__full", "__before", "__rest")
        if (i + 1) % SWEEPS_A_JOB == 0 or i + 1 == sweeps:
            fitted = stored(fitted, "capped")
    level = water_level(fitted, "tokens", "weight", size)
    held = F.least(F.col("tokens").cast("double"), F.col("weight") * F.lit(level))
    return fitted.withColumn("weight", held).drop(*(f"__t_{dim}" for dim in targets))


def sized_cells(sums: DataFrame, alpha: float = ALPHA, size: float | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """The cells with weight (expected tokens) and p, for an expected sample of ``size`` tokens.

    Without a size it is what remains when every value is cut to its target share of all
    tokens.  ``sums``: one row per cell, the dimensions and tokens.
    """
    cells = stored(sums, "cells")
    dims = [c for c in cells.columns if c != "tokens"]
    targets = {}
    for d in dims:
        have = cells.groupBy(F.col(d).alias("__v")).agg(F.sum("tokens").alias("n"))
        shares = tempered(cells, d, alpha)
        targets[d] = stored(shares.join(have, F.col("value").eqNullSafe(F.col("__v"))).drop("__v"), "targets")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    size = available(targets, total) if size is None else float(min(size, total))
    fitted = fit_capped(cells, targets, size, sweeps)
    part = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    p = F.least(F.lit(1.0), F.floor(part * F.lit(DIGITS) + F.lit(0.500001)) / F.lit(DIGITS))
    return fitted.withColumn("p", p)


def with_chance(docs: DataFrame, dims: dict[str, Column], cells: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``__p``, their cell's probability."""
    names = {n: f"__d_{n}" for n in dims}
    for n, c in dims.items():
        docs = docs.withColumn(names[n], c)
    p = cells.select(*[F.col(n).alias(f"__c_{n}") for n in dims], F.col("p").alias("__p"))
    same = reduce(Column.__and__, [F.col(names[n]).eqNullSafe(F.col(f"__c_{n}")) for n in dims])
    return docs.join(p, same, "left").drop(*names.values(), *(f"__c_{n}" for n in dims))


def mixed_sample(
    docs: DataFrame, key: str, text: str, dims: dict[str, Column], cells_of=sized_cells, **how
) -> DataFrame:
    """The rows of ``docs`` that the draw keeps; all columns, nothing added."""
    narrow = docs.select(*[c.alias(n) for n, c in dims.items()], token_weight(text).alias("tokens"))
    cells = cells_of(narrow.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), **how)
    return with_chance(docs, dims, cells).filter(draw(key) < F.col("__p")).drop("__p")
