"""Model evaluation: one grouped count feeds every report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions._base import dbl
from textwarden.functions.scores import safe_ratio
from textwarden.operators.ordering import join_back, running_sums
from textwarden.session import materialized


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def with_labels(decisions: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decisions next to the labels of the same key."""
    return decisions.join(labels, key)


def label_counts(
    df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per label and prediction; a row without prediction is unscored.

    Every report below can be taken from these few rows, see the ``_of`` forms.
    """
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.lit(0).cast("bigint"))


def _when(label: int, pred: int) -> Column:
    return _sum((F.col("label") == label) & (F.col("pred") == pred))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Actual classes as rows, predicted ones and unscored rows as columns; empty cells are 0."""
    return confusion_of(label_counts(df, label, pred))


def confusion_of(counts: DataFrame) -> DataFrame:
    cells = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(actual).alias("actual"),
                    F.col(f"c{actual}0").alias("predicted_0"),
                    F.col(f"c{actual}1").alias("predicted_1"),
                    F.col(f"u{actual}").alias("unscored"),
                )
                for actual in (0, 1)
            ]
        )
    )
    wide = counts.agg(
        *[_when(a, p).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)],
        *[_sum((F.col("label") == a) & F.col("pred").isNull()).alias(f"u{a}") for a in (0, 1)],
    )
    return wide.select(cells)


def accuracy(
    df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Rows, unscored rows, hits, and the share of hits among the scored ones."""
    return accuracy_of(label_counts(df, label, pred, by), by)


def accuracy_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hits, scored = _sum(F.col("label") == F.col("pred")), _sum(F.col("pred").isNotNull())
    return counts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        _sum(F.col("pred").isNull()).alias("unscored"),
        hits.alias("correct"),
        safe_ratio(hits, scored).alias("accuracy"),
    )


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, f1 and support per class, with macro and weighted means, of scored rows."""
    return report_of(label_counts(df, label, pred))


def report_of(counts: DataFrame) -> DataFrame:
    sides = counts.filter("pred IS NOT NULL").select(
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("chosen"),
                    F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("pred").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("chosen"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    precision, recall = safe_ratio("hits", "chosen"), safe_ratio("hits", "support")
    per_class = per_class.select(
        F.col("class").cast("string").alias("class"),
        "support",
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1"),
    )
    names = ("precision", "recall", "f1")
    means = per_class.agg(
        F.sum("support").alias("support"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
    )
    rows = [
        F.struct(
            F.lit(f"{kind} avg").alias("class"),
            F.col("support"),
            *[F.col(f"{kind}_{c}").alias(c) for c in names],
        )
        for kind in ("macro", "weighted")
    ]
    return per_class.unionByName(means.select(F.inline(F.array(*rows))))


def score_cells(
    df: DataFrame, label: str, pred: str | None, score: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per group, score, label and prediction, stored: counts and areas read the input once."""
    guess = F.col(pred) if pred else F.lit(None).cast("int")
    keys = [F.col(score).alias("__s"), F.col(label).alias("label"), guess.alias("pred")]
    return materialized(df.groupBy(*by, *keys).agg(F.count("*").alias("n")))


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve as the share of ordered pairs, ties counted half.

    Rows without a score take no part.  Equal scores become one row first; the
    sums over smaller scores come from range pieces, so neither a hot score nor
    a hot class fills one task.
    """
    return roc_of(score_cells(df, label, None, score, by), by)


def roc_of(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    points = cells.filter("__s IS NOT NULL").groupBy(*by, "__s").agg(
        _sum(F.col("label") == 1).alias("__pos"), _sum(F.col("label") == 0).alias("__neg")
    )
    summed = running_sums(points, by, "__s", ["__neg"])
    pairs = F.col("__pos").cast("double") * (F.col("before___neg") + F.col("__neg") / 2)
    every = F.sum("__pos").cast("double") * F.sum("__neg")
    area = F.when(every > 0, F.sum(pairs) / every)
    return summed.groupBy(*by).agg(area.alias("roc_auc"))


def binary_metrics(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    score: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, precision, recall, f1 of class 1 and, with a score, the ROC area.

    Unscored rows stand in a column of their own; the rates are those of the
    scored rows.
    """
    by = list(by)
    cells = score_cells(df, label, pred, score, by) if score else label_counts(df, label, pred, by)
    sums = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), _sum(F.col("pred").isNull()).alias("unscored"),
        _when(1, 1).alias("tp"), _when(0, 1).alias("fp"), _when(1, 0).alias("fn"), _when(0, 0).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = sums.select(
        *by, "n", "unscored", "tp", "fp", "fn", "tn",
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )
    if score is None:
        return out
    areas = roc_of(cells, by)
    return join_back(out, areas, by) if by else one_row(out, areas)


def cv_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds, in long form."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = folds.select(F.inline(values))
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std_pop"),
        (F.stddev_pop("value") * dbl(2)).alias("two_std"),
    )


def evaluation_gate(report: DataFrame, min_accuracy: float = 0.8) -> DataFrame:
    """Add readiness, confidence and recommendation from the accuracy column."""
    ready = F.col("accuracy") > dbl(min_accuracy)
    return report.select(
        "*",
        ready.alias("production_ready"),
        F.when(F.col("accuracy") > dbl(0.85), "high").otherwise("medium").alias("confidence"),
        F.when(ready, "approve").otherwise("reject").alias("recommendation"),
    )


def metrics_long(report: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per metric name and value."""
    values = F.array(
        *[F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return report.select(F.inline(values))


def expectation_accuracy(
    df: DataFrame, category: str, expected: str, predicted: str, ok: str | None = None
) -> DataFrame:
    """Share of met expectations per category and in all; a suite passes with one success."""
    success = F.col(ok) if ok else F.col(predicted).isNotNull()
    parts = df.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("cases"),
        F.count_if(success).alias("succeeded"),
        F.count_if(success & (F.col(expected) == F.col(predicted))).alias("correct"),
    )
    # the rollup sees one row per category
    sums = parts.rollup("category").agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("cases", "succeeded", "correct")]
    )
    return sums.select(
        F.when(F.col("level") == 1, "all").otherwise(F.col("category")).alias("category"),
        "cases", "succeeded", "correct",
        safe_ratio("correct", "succeeded").alias("accuracy"),
        (F.col("succeeded") > 0).alias("passed"),
    )
