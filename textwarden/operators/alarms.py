"""Alarms: thresholds over windows, several windows in a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden import constants as K

ALARM_COLUMNS = (
    "alarm STRING, metric STRING, stat STRING, op STRING, threshold DOUBLE, periods INT, period_s INT,"
    " wanted MAP<STRING, STRING>"
)


def alarm_table(spark: SparkSession, rows: Sequence[tuple] = K.ALARMS) -> DataFrame:
    """Configured alarms; the dimensions of a row may be left out and are then none."""
    return spark.createDataFrame([(*row, {}) if len(row) == 7 else tuple(row) for row in rows], ALARM_COLUMNS)


def alarm_points(metrics: DataFrame, alarms: Sequence[tuple]) -> DataFrame:
    """Every point next to the alarms that watch its metric under its dimensions.

    An alarm takes the points that have all its dimensions; points without a
    ``dims`` column have none.  The alarm list is a fixed small table.
    """
    if "dims" not in metrics.columns:
        metrics = metrics.withColumn("dims", F.create_map().cast("map<string,string>"))
    table = F.broadcast(alarm_table(metrics.sparkSession, alarms))  # one row per configured alarm
    met = metrics.join(table, metrics["name"] == table["metric"])
    has = F.forall(F.map_entries("wanted"), lambda e: F.try_element_at("dims", e["key"]).eqNullSafe(e["value"]))
    return met.filter(has).drop("name", "dims", "wanted")


def breaches(value: Column, op: Column, threshold: Column) -> Column:
    return F.when(op == ">", value > threshold).when(op == "<", value < threshold).otherwise(False)


def alarm_windows(metrics: DataFrame, alarms: Sequence[tuple]) -> DataFrame:
    """Statistic of each alarm's metric per window of the alarm's period.

    The alarms are joined before the grouping, so points of other metrics never
    reach a shuffle.
    """
    points = alarm_points(metrics, alarms)
    # windows of different lengths in one pass: floor the epoch second to the period
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    slot = (F.floor(second / F.col("period_s")) * F.col("period_s")).cast("bigint")
    keys = ["alarm", "metric", "stat", "op", "threshold", "periods", "period_s"]
    sums = points.groupBy(*keys, slot.alias("slot")).agg(
        F.sum("value").alias("__sum"), F.count("value").alias("__n"),
        F.min("value").alias("__min"), F.max("value").alias("__max"),
    )
    value = (
        F.when(F.col("stat") == "Sum", F.col("__sum"))
        .when(F.col("stat") == "Average", F.col("__sum") / F.col("__n"))
        .when(F.col("stat") == "Minimum", F.col("__min"))
        .when(F.col("stat") == "Maximum", F.col("__max"))
        .otherwise(F.col("__n").cast("double"))
    )
    return sums.select(*keys, "slot", value.alias("value"))


def evaluate_alarms(metrics: DataFrame, alarms: Sequence[tuple] = K.ALARMS) -> DataFrame:
    """Value, breach and alarm state of every window, gaps included.

    A window without points does not breach.  Each window is followed by the
    empty ones up to the next, so the points are read and grouped once.
    """
    windows = alarm_windows(metrics, alarms)
    period = F.col("period_s").cast("bigint")
    ordered = Window.partitionBy("alarm").orderBy("slot")
    until = F.coalesce(F.lead("slot").over(ordered) - period, F.col("slot"))
    spans = windows.withColumn("__slots", F.sequence("slot", until, period))
    filled = spans.select(
        "alarm", "metric", "stat", "op", "threshold", "periods", "period_s",
        F.col("slot").alias("__slot"), F.explode("__slots").alias("slot"), F.col("value").alias("__value"),
    ).withColumn("value", F.when(F.col("slot") == F.col("__slot"), F.col("__value")))
    breach = F.coalesce(breaches(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False))
    marked = filled.drop("__slot", "__value").withColumn("breach", breach)
    # length of the current run of breaches: windows since the last one without
    calm = F.max(F.when(~F.col("breach"), F.col("slot"))).over(ordered)
    first = F.min("slot").over(Window.partitionBy("alarm"))
    run = (F.col("slot") - F.coalesce(calm, first - F.col("period_s"))) / F.col("period_s")
    state = marked.withColumn("run", F.when(F.col("breach"), run.cast("bigint")).otherwise(0))
    return state.withColumn("in_alarm", F.col("run") >= F.col("periods"))


def alarm_changes(evaluated: DataFrame) -> DataFrame:
    """The windows at which an alarm goes on or off; it starts off."""
    before = F.lag("in_alarm", 1, False).over(Window.partitionBy("alarm").orderBy("slot"))
    return evaluated.withColumn("__before", before).filter("in_alarm <> __before").select(
        "alarm", "slot", F.when(F.col("in_alarm"), "ALARM").otherwise("OK").alias("state"), "value"
    )
