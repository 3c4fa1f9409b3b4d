"""Session defaults and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from textwarden.sources.folders import remove

# AQE splits skewed joins and merges small shuffle partitions on its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("textwarden")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textwarden-"))
    return spark.sparkContext.getCheckpointDir()


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder; ``release`` deletes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this driver has put below fresh paths; call it once the results are written.

    Tables read from there are gone with it.  Returns the number of paths.
    """
    done = len(_MADE)
    while _MADE:
        remove(spark, _MADE.pop())
    return done


def materialized(df):
    """The same rows cut from their lineage, stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
