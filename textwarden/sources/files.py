"""Readers: labelled CSV, text lines, JSON reports, file listings, event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden import schemas
from textwarden.functions.text import strip_space
from textwarden.sources.folders import is_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_labelled_csv(
    spark: SparkSession, path: str, schema: str = schemas.LABELLED, multi_line: bool = False
) -> DataFrame:
    """Labelled rows with quoted commas; rows that do not fit keep their raw line.

    Large files are cut into pieces.  Where quoted texts hold line breaks,
    ``multi_line=True`` is needed, and a file is then read by one task.
    """
    return (
        spark.read.schema(f"{schema}, _corrupt_record STRING")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def read_text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Stripped non-blank lines with their file and an id that rises within it."""
    raw = spark.read.text(path if isinstance(path, str) else list(path))
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("line_id"),
        strip_space("value").alias("text"),
    )
    return lines.filter(F.col("text") != "")


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stripped non-blank lines of a text column, with their 1-based number."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("__p", "__l"))
    return lines.select(
        key, (F.col("__p") + 1).alias("line_no"), strip_space("__l").alias("text")
    ).filter(F.col("text") != "")


def read_json_report(
    spark: SparkSession, path: str, schema: str, pretty: bool = False
) -> DataFrame:
    """JSON documents under a fixed schema; no file gives no row.

    One document per line, or with ``pretty`` one per file over many lines.
    """
    try:
        return spark.read.schema(schema).option("multiLine", pretty).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a registry; one that nothing was appended to has none."""
    try:
        return spark.read.schema(schemas.REGISTRY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.REGISTRY)


def list_artifacts(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Path, size and time of all files below a folder whose relative path has the prefix.

    The content column is never read.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            "path",
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
        )
    )
    base = root.rstrip("/") + "/"
    relative = F.element_at(F.split("path", _quoted(base), 2), -1)
    return listing.withColumn("key", relative).filter(F.col("key").startswith(prefix))


def _quoted(text: str) -> str:
    return r"\Q" + text.split("://", 1)[-1] + r"\E"


def first_existing(listing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per wanted name, the candidate path of lowest priority number that is listed.

    ``candidates`` has name, priority and key; ``listing`` has key.
    """
    best = Window.partitionBy("name").orderBy("priority")
    found = candidates.join(listing.select("key").distinct(), "key", "left_semi")
    return found.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def read_event_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new events."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_table_stream(
    spark: SparkSession, folder: str, name: str, schema: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if is_folder(spark, path):
        return read_event_stream(spark, path, schema, files_per_trigger=files_per_trigger)
    return read_event_stream(spark, folder, schema, f"{name}.parquet", files_per_trigger)
