"""Structured Streaming forms of moderation, metrics, alerts and reviewer answers."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textwarden.operators.decisions import blocked_alerts
from textwarden.operators.metrics import false_positive_points
from textwarden.plans.moderation import moderate, prepare
from textwarden.session import fresh_path


def moderate_stream(
    events: DataFrame,
    score: Column | Callable[[DataFrame], DataFrame],
    text: str = "text",
    key: str = "doc_id",
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """The batch moderation plan on a stream: stateless, so late rows are kept.

    ``score`` is a column or a function that adds the score column, such as a
    fitted pipeline; ``verdicts`` is a static table of raw answers.
    """
    ready = prepare(events, text)
    scored = score(ready) if callable(score) else ready.withColumn("score", score)
    return moderate(scored, verdicts, key)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with a watermark; times without a zone are read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_metrics_stream(
    metrics: DataFrame, window: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Sum, mean and count per window and name; points older than the delay are dropped.

    In append mode a window comes once, when it is closed; in update mode it
    comes whenever it changes, see latest_updates.
    """
    stats = (
        event_time(metrics, "ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "name")
        .agg(
            F.sum("value").alias("total"),
            F.avg("value").alias("mean"),
            F.count("value").alias("points"),
        )
    )
    return stats.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "name", "total", "mean", "points",
    )


def false_positive_stream(
    decisions: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    window: str = "15 minutes",
    wait: str = "1 hour",
    delay: str = "10 minutes",
    environment: str = "Production",
) -> DataFrame:
    """Share of harmless rows that were flagged, per closed window of a stream: a metric point each.

    ``decisions`` has key, ts and action; ``labels`` has key, label_ts and label.  A label counts if
    it comes within the wait after the decision; the same label sent again within the delay
    counts once.  Two states in a row: the join keeps a decision for the wait, the windows
    behind it keep two numbers each, and close when no decision in them can be labelled any
    more.  Rows with a null key only move the time on.
    """
    left = event_time(decisions.select(key, "ts", "action"), "ts", delay)
    right = event_time(labels.select(key, "label_ts", "label"), "label_ts", delay)
    once = right.dropDuplicatesWithinWatermark([key])
    right = once.select(F.col(key).alias("__key"), "label_ts", "label")
    in_time = F.expr(f"label_ts >= ts AND label_ts <= ts + INTERVAL {wait}")
    labelled = left.join(right, (F.col(key) == F.col("__key")) & in_time)
    return false_positive_points(labelled, window, environment)


ONCE = {"availableNow": True}  # all files that are there, then the stream ends


def start(
    stream: DataFrame, out: str, state: str, mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """Start a stream that writes to ``out``; ``trigger`` as for Spark, by default without end."""
    writer = stream.writeStream.option("checkpointLocation", state)
    writer = writer.trigger(**trigger) if trigger else writer
    if mode == "append":
        return writer.outputMode("append").format("parquet").option("path", out).start()
    return writer.outputMode(mode).foreachBatch(_numbered_batches(out)).start()


def run_available(
    stream: DataFrame, name: str, mode: str = "append", out: str | None = None, state: str | None = None
) -> DataFrame:
    """Process all files that are there, and return what was written as a table.

    Output and progress lie in the shared folder, so that any executor may be
    lost and a later call with the same folders goes on where this one ended.
    In update mode every batch is written with its number.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, name)
    state = state or fresh_path(spark, f"{name}-progress")
    finish(start(stream, out, state, mode, ONCE))
    if mode != "append":
        return spark.read.parquet(out)
    return spark.read.schema(stream.schema).parquet(out)


COUNTS = "batch LONG, rows_in LONG, late LONG, rows_out LONG"


def run_counted(
    stream: DataFrame, name: str, source: str = "rows_in", out: str | None = None, state: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Process all files that are there; what was written, and per batch the rows in, late and out.

    ``source`` is the name under which ``counted`` counts the rows of the source.  Late are the
    rows that operators with a state have refused because the watermark had passed them.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, name)
    state = state or fresh_path(spark, f"{name}-progress")
    log = ProgressLog(source)
    spark.streams.addListener(log)
    try:
        query = start(counted(stream, "rows_out"), out, state, trigger=ONCE)
        log.watch(query)
        finish(query)
        log.wait()
    finally:
        spark.streams.removeListener(log)
    return spark.read.schema(stream.schema).parquet(out), spark.createDataFrame(log.rows(), COUNTS)


def counted(df: DataFrame, name: str) -> DataFrame:
    """The same stream; its progress tells how many rows have passed here."""
    return df.observe(name, F.count(F.lit(1)).alias("n"))


class ProgressLog(StreamingQueryListener):
    """The counts of every batch of one query, from its progress events: a row of numbers per batch."""

    def __init__(self, source: str):
        self.source, self.run, self.seen, self.over = source, None, {}, threading.Event()

    def watch(self, query: StreamingQuery) -> None:
        self.run = str(query.runId)

    def wait(self, seconds: float = 60) -> None:
        """Until the events, which come after the batches they tell of, are all there."""
        if not self.over.wait(seconds):
            raise TimeoutError("the stream's last progress event did not come")

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [counts for (run, _), counts in sorted(self.seen.items()) if run == self.run]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        passed = {name: row["n"] for name, row in p.observedMetrics.items()}
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        counts = (p.batchId, passed.get(self.source, 0), late, passed.get("rows_out", 0))
        self.seen[str(p.runId), p.batchId] = counts

    def onQueryTerminated(self, event) -> None:
        if self.run in (None, str(event.runId)):
            self.over.set()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _numbered_batches(out: str):
    def write(batch: DataFrame, number: int) -> None:
        # one folder per batch: a repeated batch replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def latest_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last written row of every key: a numbered update log as a table."""
    rest = [c for c in updates.columns if c not in keys and c != "batch"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*")


def append_alerts(
    decisions: DataFrame, out: str, state: str, columns: Sequence[str] = (), trigger: dict | None = ONCE
) -> StreamingQuery:
    """Write the alerts of a decision stream, batch by batch, next to its own sink.

    ``trigger`` as for Spark; without one the stream runs until it is stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        blocked_alerts(batch, columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = decisions.writeStream.option("checkpointLocation", state)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(write).start()
