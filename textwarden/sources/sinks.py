"""Writers: tables, reports, models, registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.sources.folders import files_in, partitions, remove

GROUP_BYTES = 16 << 20  # of a stored table that a task holds until it writes them


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    fmt: str = "parquet",
    whole: bool = False,
) -> None:
    """Write a table; partition folders get evenly sized files, hot ones several.

    Overwriting a table with partitions replaces those that the rows belong to and leaves the
    others, unless the ``whole`` table is to be replaced.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
        # texts keep their outer blanks
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        writer = writer.option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.save(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written once as Parquet and read from there.

    Cached rows of texts fill the memory of an executor and are copied whole, once more, where
    a task reads those of another executor; files are read some rows at a time by any task.
    """
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_run(df: DataFrame, path: str, run: str, partition_by: Sequence[str] = ("day",)) -> DataFrame:
    """Write what one run has made into a table that many runs write; returns the folders it has now.

    The rows lie in folders of their partition and, below, of the run, so a run replaces nothing
    of another one, on whichever days both have written.  A run that is repeated replaces what
    it wrote before: folders that it fills again are overwritten, and those that it does not
    fill any more are removed.  Should it stop between the two, repeating it once more ends
    in the same state.
    """
    spark, columns = df.sparkSession, [*partition_by, "run"]

    def mine() -> dict[str, dict[str, int]]:
        found = partitions(spark, path, *columns)
        return {folder: files_in(spark, folder) for values, folder in found if values["run"] == run}

    before = mine()
    write_table(df.withColumn("run", F.lit(run)), path, columns)
    after = mine()
    kept = []
    for folder, files in after.items():
        if before.get(folder) == files:  # as it was before this write: no row belongs there now
            remove(spark, folder)
        else:
            kept.append((folder, len(files), sum(files.values())))
    return spark.createDataFrame(kept, "folder STRING, files INT, bytes LONG")


def drop_expired(
    spark: SparkSession,
    path: str,
    as_of: dt.date,
    days_by_stream: dict[str, int] = K.RETENTION_DAYS,
    stream: str = "stream",
    day: str = "day",
) -> DataFrame:
    """Delete the day folders of a log that are older than their stream is kept; returns what went.

    The log lies in folders of stream and day.  A day that begins ``days`` days before ``as_of``
    stays, those before it go.  Unknown streams, and folders whose day is no date, stay.
    Nothing is read: the folders are listed and dropped as a whole, so no row of a kept day
    is written again.
    """
    gone = []
    for values, folder in partitions(spark, path, stream, day):
        kept = days_by_stream.get(values[stream])
        try:
            at = dt.date.fromisoformat(values[day])
        except ValueError:
            continue
        if kept is None or at >= as_of - dt.timedelta(days=kept):
            continue
        files = files_in(spark, folder)
        remove(spark, folder)
        gone.append((values[stream], at, len(files), sum(files.values())))
    return spark.createDataFrame(gone, f"{stream} STRING, {day} DATE, files INT, bytes LONG")


def report_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON text, with NULL fields kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_report(df: DataFrame, path: str) -> None:
    """Write a report of a few rows as JSON in one file; not for tables that grow."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_registry(df: DataFrame, path: str) -> None:
    """Append registry rows, one folder per kind."""
    write_table(df, path, partition_by=["kind"], mode="append")
