"""Scoring a stream by the model that is approved while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textwarden.operators.registry import approved_model
from textwarden.plans.training import score_texts
from textwarden.sources.files import read_registry
from textwarden.sources.sinks import load_model
from textwarden.streaming.streams import ONCE


class CurrentModel:
    """The approved model of a registry; loaded again only when another one is approved."""

    def __init__(self, registry: str, load: Callable[[str], PipelineModel] = load_model):
        self.registry, self.load, self.version, self.model = registry, load, None, None

    def refresh(self, spark) -> str | None:
        """Look the approved version up and hold it; its name, or None if none is approved."""
        found = approved_model(read_registry(spark, self.registry)).first()
        version = (found["name"], found["payload"].get("model_path")) if found else None
        if version != self.version:
            self.model = self.load(version[1]) if version else None
            self.version = version
        return version[0] if version else None

    def score(self, rows: DataFrame, text: str) -> DataFrame:
        """The rows with ``score``, ``pred``, ``error`` and ``model``, the version that scored them."""
        name = self.refresh(rows.sparkSession)
        if self.model is None:
            none = {"score": "double", "pred": "int"}
            out = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
            return out.withColumns({"error": F.lit("no approved model"), "model": F.lit(None).cast("string")})
        return score_texts(self.model, rows, text).withColumn("model", F.lit(name))


def score_by_current(
    stream: DataFrame, registry: str, out: str, state: str, text: str = "text", trigger: dict | None = ONCE
) -> StreamingQuery:
    """Write the rows of a stream with their score, every micro-batch by the model approved as it begins.

    The registry is looked up once a batch, on the driver; a batch has one version, which each
    of its rows carries.  A batch that is repeated after a failure replaces its folder, and may
    then have a newer version.  Without an approved model rows are written with an error, none
    is lost.
    """
    current = CurrentModel(registry)

    def write(batch: DataFrame, number: int) -> None:
        current.score(batch, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", state)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(write).start()
