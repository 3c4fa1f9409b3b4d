"""Data quality: required columns, missing values, label balance, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import dbl
from textwarden.functions.text import strip_space
from textwarden.operators.splits import tagged_union

REQUIRED = ("comment_text", "toxic")
STATISTICS = {
    "samples": "BIGINT", "missing_values": "BIGINT", "toxic_ratio": "DOUBLE", "final_samples": "BIGINT",
}


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def column_issues(parts: dict[str, DataFrame], required: Sequence[str] = REQUIRED) -> list[str]:
    """What the parts lack, known without a job."""
    return [f"{n} lacks columns: {m}" for n, df in parts.items() if (m := missing_columns(df, required))]


def clean_labelled(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Drop rows with a NULL, strip the text, drop empty texts."""
    text = required[0]
    kept = df.na.drop(subset=list(required)).withColumn(text, strip_space(text))
    return kept.filter(F.col(text) != "")


def split_statistics(
    df: DataFrame, required: Sequence[str] = REQUIRED, split: str = "split"
) -> DataFrame:
    """Rows, missing values, label share and rows left after cleaning, per split."""
    text, label = required
    missing = sum((F.col(c).isNull().cast("bigint") for c in required), F.lit(0).cast("bigint"))
    kept = F.col(text).isNotNull() & F.col(label).isNotNull() & (strip_space(text) != "")
    return df.groupBy(split).agg(
        F.count("*").alias("samples"),
        F.sum(missing).alias("missing_values"),
        F.avg(F.col(label).cast("double")).alias("toxic_ratio"),
        F.count_if(kept).alias("final_samples"),
    )


def validation_report(
    parts: dict[str, DataFrame],
    min_rows: int = 100,
    max_null_share: float = 0.1,
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """One row: verdict, issues and the statistics of train and test.

    One pass over the data; everything after it works on one row per split.  If
    a part lacks a column nothing is read: the report says so and has no statistics.
    """
    lacking = column_issues(parts, required)
    if lacking:
        spark = next(iter(parts.values())).sparkSession
        numbers = ", ".join(f"{n}_{c} {kind}" for n in ("train", "test") for c, kind in STATISTICS.items())
        schema = f"validation_passed BOOLEAN, issues ARRAY<STRING>, {numbers}"
        return spark.createDataFrame([(False, lacking, *[None] * 2 * len(STATISTICS))], schema)
    stats = split_statistics(tagged_union(parts), required)
    value = lambda name, c: F.max(F.when(F.col("split") == name, F.col(c)))
    columns = tuple(STATISTICS)
    wide = stats.groupBy().agg(
        *[value(n, c).alias(f"{n}_{c}") for n in ("train", "test") for c in columns]
    )
    for n in ("train", "test"):
        for c in ("samples", "missing_values", "final_samples"):
            wide = wide.withColumn(f"{n}_{c}", F.coalesce(f"{n}_{c}", F.lit(0).cast("bigint")))
    train_missing, test_missing = F.col("train_missing_values"), F.col("test_missing_values")
    any_missing = (train_missing > 0) | (test_missing > 0)
    too_many = (train_missing > F.col("train_samples") * dbl(max_null_share)) | (
        test_missing > F.col("test_samples") * dbl(max_null_share)
    )
    small = F.col("train_samples") < min_rows
    ratio = F.col("train_toxic_ratio")
    skewed = (ratio < dbl(0.01)) | (ratio > dbl(0.99))
    issues = F.array_compact(
        F.array(
            F.when(
                any_missing,
                F.format_string(K.ISSUES["missing"], train_missing, test_missing),
            ),
            F.when(small, F.format_string(K.ISSUES["small"], F.col("train_samples"))),
            F.when(skewed, F.format_string(K.ISSUES["skewed"], ratio)),
        )
    )
    return wide.select((~(too_many | small)).alias("validation_passed"), issues.alias("issues"), "*")
