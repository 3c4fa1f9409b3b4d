"""Streams over the given tables, drained and read back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from catalog import _base as B
from catalog import policy as CP
from catalog import monitoring as CM
from catalog._base import ORACLES, fixture_score, query, stamp, table
from textwarden import schemas
from textwarden.functions.policy import route
from textwarden.functions.scores import borderline
from textwarden.operators.decisions import review_queue
from textwarden.session import fresh_path
from textwarden.sources.files import read_event_stream, read_table_stream
from textwarden.streaming import stateful as ST
from textwarden.streaming import streams as S


def _documents(spark, sf):
    return read_table_stream(spark, sf, "documents", schemas.DOCUMENTS)


BATCHES = 6
FILE_ROWS = 100_000


def _in_batches(df, name, jitter=0):
    """A table with ``ts`` as a stream of BATCHES micro-batches at most, in time order.

    A batch is as many files as it needs for FILE_ROWS rows each: their number follows the rows,
    that of the batches does not.  Rows without a time come first.  With ``jitter``, each row is
    moved by up to so many minutes, by a hash: rows are then out of order across files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    moved = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(moved, F.lit(max(1, jitter * 60_000_000)))
    files = max(1, -(-df.count() // (BATCHES * FILE_ROWS)))
    # rows of one time, or of none, need not share a file
    df.repartitionByRange(BATCHES * files, at, moved).write.parquet(path)
    _in_order(spark, path)
    return read_event_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=files)


def _in_order(spark, path):
    """Let the files have been written one after the other, in the order of their names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")), key=str)
    first = fs.getFileStatus(files[0]).getModificationTime() if files else 0
    for i, file in enumerate(files):
        fs.setTimes(file, first - 1000 * (len(files) - i), -1)


def _with_heartbeat(df):
    """The rows and one more, a day after the last of them, that has nothing but its time."""
    end = df.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != "ts"]
    return df.unionByName(end.select("ts", *empty))


def _event_batches(spark, sf, jitter=0):
    return _in_batches(table(spark, sf, "events"), "event-files", jitter)


def _points(spark, sf):
    return _event_batches(spark, sf).select("ts", F.col("event_type").alias("name"), "value")


@query(
    "stream_moderation",
    f"""WITH {B.SQL_CLEANED}, {B.sql_flags('cleaned')},
    s AS (SELECT *, CASE WHEN length(c) >= 3 THEN {B.SQL_SCORE} END AS score FROM flags),
    f AS (SELECT *, score + (CASE WHEN excessive_caps THEN 0.05::DOUBLE ELSE 0::DOUBLE END)
      + (CASE WHEN excessive_punctuation THEN 0.03::DOUBLE ELSE 0::DOUBLE END) AS fs FROM s)
    SELECT doc_id, CASE WHEN text = '' THEN 'invalid_empty' WHEN c = '' THEN 'empty_after_clean'
        WHEN length(c) < 3 THEN 'too_short' ELSE 'scored' END AS outcome,
      CASE WHEN c = '' THEN NULL WHEN length(c) < 3 THEN 0::DOUBLE ELSE round(fs, 4) END AS final_score,
      CASE WHEN c = '' THEN NULL WHEN length(c) < 3 THEN 'allow'
        WHEN fs > 0.8::DOUBLE OR score > 0.7::DOUBLE THEN 'block'
        WHEN fs > 0.5::DOUBLE THEN 'review' ELSE 'allow' END AS action FROM f""",
)
def stream_moderation(spark, sf):
    """Moderation of the document stream without a reviewer."""
    decided = S.moderate_stream(_documents(spark, sf), fixture_score())
    narrow = decided.select("doc_id", "outcome", "final_score", "action")
    return S.run_available(narrow, "moderation")


@query(
    "stream_moderation_with_verdicts",
    f"""WITH {CP.SQL_ATTACHED.replace('SELECT doc_id, lang, text, text AS c,', f"SELECT doc_id, lang, text, {B.sql_clean('text')} AS c,")}
    SELECT doc_id, round(fs, 4) AS final_score, action, confidence, routed, enhanced FROM combined""",
)
def stream_moderation_with_verdicts(spark, sf):
    """The document stream joined to the static table of reviewer answers."""
    answers = CP.answers(spark, sf)
    decided = S.moderate_stream(_documents(spark, sf), fixture_score(), verdicts=answers)
    narrow = decided.select("doc_id", "final_score", "action", "confidence", "routed", "enhanced")
    return S.run_available(narrow, "moderation-verdicts")


@query(
    "stream_windowed_metrics",
    f"""SELECT {B.sql_stamp("time_bucket(INTERVAL 5 MINUTE, ts)")} AS window_start, event_type AS name,
      {B.sql_steady("sum(value)")} AS total, {B.sql_steady("avg(value)")} AS mean, count(*) AS points
    FROM events GROUP BY 1, 2""",
)
def stream_windowed_metrics(spark, sf):
    w = S.windowed_metrics_stream(_points(spark, sf)).drop("window_end")
    updates = S.run_available(w, "windows", "update")
    latest = S.latest_updates(updates, ["window_start", "name"])
    return latest.select(
        stamp("window_start").alias("window_start"), "name",
        B.steady("total").alias("total"), B.steady("mean").alias("mean"), "points",
    )


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query(
    "stream_closed_windows",
    f"""SELECT {B.sql_stamp("time_bucket(INTERVAL 15 MINUTE, ts)")} AS window_start, event_type AS name,
      {B.sql_steady("sum(value)")} AS total, count(*) AS points FROM events GROUP BY 1, 2
    HAVING max(time_bucket(INTERVAL 15 MINUTE, ts)) + INTERVAL 15 MINUTE <= {_CLOSED}""",
)
def stream_closed_windows(spark, sf):
    """Windows the watermark has closed, each written once."""
    w = S.windowed_metrics_stream(_points(spark, sf), "15 minutes").drop("window_end", "mean")
    out = S.run_available(w, "closed-windows")
    return out.select(
        stamp("window_start").alias("window_start"), "name", B.steady("total").alias("total"), "points"
    )


@query(
    "stream_alerts",
    f"""SELECT doc_id, '{CP.K.ALERT_SUBJECT}' AS subject, '{CP.K.ROUTE_REASONS["block"]}' AS message
    FROM documents WHERE {B.SQL_SCORE} > 0.8::DOUBLE""",
)
def stream_alerts(spark, sf):
    """Alerts of a decision stream whose borderline rows have no answer."""
    docs = _documents(spark, sf).withColumn("score", fixture_score())
    none = F.lit(None).cast("string")
    decided = docs.select("doc_id", route("score", none).alias("r")).select("doc_id", "r.*")
    out = fresh_path(spark, "alerts")
    S.finish(S.append_alerts(decided, out, fresh_path(spark, "alerts-progress"), ["doc_id"], S.ONCE))
    return spark.read.parquet(out).drop("batch")


@query(
    "stream_review_queue",
    f"""SELECT doc_id, {B.SQL_SCORE} AS score FROM documents
    WHERE {B.SQL_SCORE} > 0.3::DOUBLE AND {B.SQL_SCORE} < 0.8::DOUBLE""",
)
def stream_review_queue(spark, sf):
    scored = _documents(spark, sf).select("doc_id", fixture_score().alias("score"))
    return S.run_available(review_queue(scored), "review-queue")


ALARMS = (
    ("ErrorSum", "error", "Sum", ">", 150.005, 2, 3600),
    ("SlowClicks", "click", "Average", ">", 55.0037, 3, 3600),
    ("FewViews", "view", "SampleCount", "<", 2.5, 2, 3600),
)

_VALUES = ", ".join(str(row) for row in ALARMS)
_SQL_STREAM_ALARMS = f"""WITH a(alarm, metric, stat, op, threshold, periods, period_s) AS (VALUES {_VALUES}),
  pts AS (SELECT a.*, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS slot, value
    FROM events JOIN a ON event_type = metric),
  wins AS (SELECT alarm, slot, CASE any_value(stat) WHEN 'Sum' THEN sum(value) WHEN 'Average' THEN avg(value)
    ELSE CAST(count(*) AS DOUBLE) END AS value FROM pts GROUP BY ALL
    HAVING slot + 3600 <= epoch({_CLOSED})),
  span AS (SELECT alarm, min(slot) AS lo, CAST(floor(epoch({_CLOSED}) / 3600) * 3600 - 3600 AS BIGINT) AS hi FROM wins GROUP BY alarm),
  grid AS (SELECT a.*, unnest(generate_series(lo, hi, 3600)) AS slot FROM a JOIN span USING (alarm)),
  filled AS (SELECT g.*, w.value, coalesce(CASE WHEN op = '>' THEN w.value > threshold::DOUBLE
    ELSE w.value < threshold::DOUBLE END, FALSE) AS breach FROM grid g LEFT JOIN wins w USING (alarm, slot)),
  state AS (SELECT *, breach AND coalesce(lag(breach, 1) OVER o, FALSE)
      AND (periods < 3 OR coalesce(lag(breach, 2) OVER o, FALSE)) AS in_alarm
    FROM filled WINDOW o AS (PARTITION BY alarm ORDER BY slot)),
  b AS (SELECT *, lag(in_alarm, 1, FALSE) OVER (PARTITION BY alarm ORDER BY slot) AS was FROM state)
  SELECT alarm, CAST(slot AS BIGINT) AS slot, CASE WHEN in_alarm THEN 'ALARM' ELSE 'OK' END AS state,
    {B.sql_steady("value")} AS value FROM b WHERE in_alarm <> was"""


@query("stream_alarms", _SQL_STREAM_ALARMS)
def stream_alarms(spark, sf):
    """Alarm changes over the windows the watermark has closed, those without points included."""
    out = S.run_available(ST.alarm_stream(_points(spark, sf), ALARMS), "alarms")
    return out.withColumn("value", B.steady("value"))


_FEED_CLOSED = "epoch((SELECT max(ts) FROM feed) - INTERVAL 10 MINUTE)"


@query(
    "stream_default_alarms",
    f"""WITH {CM.SQL_FEED}, {CM.sql_alarm_states(ST.K.ALARMS, "feed", _FEED_CLOSED)}
    SELECT alarm, CAST(slot AS BIGINT) AS slot, CASE WHEN in_alarm THEN 'ALARM' ELSE 'OK' END AS state,
      {B.sql_steady("value")} AS value FROM awas WHERE in_alarm <> was""",
)
def stream_default_alarms(spark, sf):
    """The default alarms, of two period lengths, over the feed as a stream of several batches."""
    points = _in_batches(CM.feed(spark, sf), "feed-files")
    out = S.run_available(ST.alarm_stream(points, ST.K.ALARMS), "default-alarms")
    return out.withColumn("value", B.steady("value"))


_STATUS = """CASE WHEN value < 30 THEN 'Executing' WHEN value < 80 THEN 'Succeeded'
  WHEN value < 150 THEN 'Failed' ELSE 'Stopped' END"""


@query(
    "stream_status_changes",
    f"""WITH s AS (SELECT event_id, event_type AS step, {_STATUS} AS status, ts FROM events),
    l AS (SELECT *, lag(status) OVER w AS previous_status FROM s
      WINDOW w AS (PARTITION BY step ORDER BY ts, event_id))
    SELECT event_id, step, status, previous_status FROM l WHERE status IS DISTINCT FROM previous_status
      AND time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= {_CLOSED}""",
)
def stream_status_changes(spark, sf):
    """Status changes over micro-batches whose rows are out of order, up to the watermark; as of the whole table."""
    steps = _event_batches(spark, sf, jitter=5).select(
        F.col("event_type").alias("step"), F.expr(_STATUS).alias("status"), "ts", "event_id"
    )
    changes = S.run_available(ST.status_change_stream(steps), "status")
    return changes.select("event_id", "step", "status", "previous_status")


@query(
    "stream_verdict_return",
    f"""WITH s AS (SELECT event_id, ts, {B.SQL_SCORE.replace('doc_id', 'event_id')} AS score,
      CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN value > 80 THEN 'review' WHEN value > 50 THEN 'block' ELSE 'allow' END
      END AS act FROM events),
    b AS (SELECT *, score > 0.3::DOUBLE AND score <= 0.8::DOUBLE AS asked FROM s),
    r AS (SELECT *, CASE WHEN asked THEN act END AS va FROM b)
    SELECT event_id, {B.sql_stamp('ts')} AS ts, score,
      CASE WHEN score > 0.8::DOUBLE THEN 'high' WHEN asked THEN 'borderline' ELSE 'low' END AS branch,
      CASE WHEN asked AND va IS NULL THEN NULL WHEN score > 0.8::DOUBLE OR va = 'block' THEN 'BLOCKED'
        WHEN va = 'review' THEN 'REVIEW' ELSE 'ALLOWED' END AS final_decision,
      CASE WHEN asked AND va IS NULL THEN 'review' WHEN score > 0.8::DOUBLE OR va = 'block' THEN 'block'
        WHEN va = 'review' THEN 'review' ELSE 'allow' END AS action,
      CASE WHEN asked AND va IS NULL OR va = 'review' THEN 'medium' ELSE 'high' END AS confidence,
      CASE WHEN asked AND va IS NULL THEN '{CP.K.ROUTE_REASONS["fallback"]}'
        WHEN score > 0.8::DOUBLE OR va = 'block' THEN '{CP.K.ROUTE_REASONS["block"]}'
        WHEN va = 'review' THEN '{CP.K.ROUTE_REASONS["review"]}' ELSE '{CP.K.ROUTE_REASONS["allow"]}' END AS reasoning,
      asked AND va IS NULL AS fallback_used FROM r""",
)
def stream_verdict_return(spark, sf):
    """Events as scored rows; one decision for each, as the batch workflow gives it.

    Clicks and views get two answers in time, of which the newer counts, and a third, that is
    late; errors get one that is late, other events none.  A heartbeat in both streams, a day
    after the last event, lets every timer fire.
    """
    live = _in_batches(_with_heartbeat(table(spark, sf, "events")), "event-files", jitter=2)
    scored = live.select("event_id", "ts", fixture_score("event_id").alias("score"))
    act = F.when(F.col("value") > 80, "review").when(F.col("value") > 50, "block").otherwise("allow")
    other = F.when(act == "allow", "block").otherwise("allow")
    at = lambda minutes, action: F.struct(
        (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("answer_ts"), action.alias("action")
    )
    given = F.when(F.col("event_type").isin("click", "view"), F.array(at(4, act), at(1, other), at(11, other)))
    given = given.when(F.col("event_type") == "error", F.array(at(60, other)))
    given = given.when(F.col("event_id").isNull(), F.array(at(0, F.lit(None).cast("string"))))
    asked = borderline(fixture_score("event_id"), hi_closed=True) | F.col("event_id").isNull()
    answers = live.filter(asked).select("event_id", F.explode(given).alias("a")).select("event_id", "a.*")
    out = S.run_available(ST.verdict_return_stream(scored, answers, "event_id"), "verdict-return")
    return out.filter("event_id IS NOT NULL").withColumn("ts", stamp("ts"))


@query("stream_false_positive_share", ORACLES["false_positive_share"])
def stream_false_positive_share(spark, sf):
    """The share over a stream of decisions and one of labels, some of which are sent twice; as in batch."""
    decided = CM.decisions(spark, sf).select("doc_id", "ts", "action")
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    minutes = F.make_dt_interval(mins=(F.col("doc_id") % 50).cast("int"))
    sent = decided.select("doc_id", "ts").join(labels, "doc_id").withColumn("ts", F.col("ts") + minutes)
    again = sent.filter("doc_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    decisions = _in_batches(_with_heartbeat(decided), "decision-files")
    given = _in_batches(_with_heartbeat(sent.unionByName(again)), "label-files").withColumnRenamed("ts", "label_ts")
    points = S.false_positive_stream(decisions, given)
    return CM._share(S.run_available(points, "false-positives"))


@query(
    "stream_row_counts",
    f"""WITH late AS (SELECT event_id % 7 = 3 AND ts < (SELECT max(ts) FROM events WHERE event_id % 7 <> 3) - INTERVAL 10 MINUTE
        AS late FROM events)
    SELECT 'status' AS stream, count(*) + 2 AS rows_in, count(*) FILTER (WHERE late) AS late FROM late
    UNION ALL SELECT 'decisions', count(*) + 2, 0 FROM late""",
)
def stream_row_counts(spark, sf):
    """A seventh of the events comes after all others: status changes refuse them as late, decisions lose none.

    Summed over the batches of each stream, from its progress events.
    """
    events = table(spark, sf, "events")
    path = fresh_path(spark, "late-files")
    on_time = events.filter("event_id % 7 <> 3")
    beat = on_time.agg(F.max("ts").alias("ts"))
    beat = beat.select(*[F.col(c) if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    on_time.repartitionByRange(BATCHES, "ts").write.parquet(path)
    _in_order(spark, path)
    for part in (beat, beat, events.filter("event_id % 7 = 3").repartition(BATCHES)):
        part.write.mode("append").parquet(path)
        time.sleep(0.01)  # files are read in the order of their times, of a millisecond
    live = S.counted(read_event_stream(spark, path, events.schema, files_per_trigger=1), "rows_in")
    steps = live.select(F.col("event_type").alias("step"), F.expr(_STATUS).alias("status"), "ts", "event_id")
    scored = live.select("event_id", "ts", F.when(F.col("event_id").isNotNull(), 0.9).alias("score"))
    none = F.lit(None).cast("string")
    decided = scored.select("event_id", route("score", none).alias("r")).select("event_id", "r.*")
    counts = []
    for name, stream in (("status", ST.status_change_stream(steps)), ("decisions", decided)):
        _, log = S.run_counted(stream, name)
        total = log.agg(*[F.sum(c).alias(c) for c in ("rows_in", "late", "rows_out")])
        counts.append(total.select(F.lit(name).alias("stream"), "rows_in", "late", "rows_out"))
    status, decisions = counts
    # a decision per row, late ones as well
    whole = decisions.filter("rows_out = rows_in")
    return status.unionByName(whole).drop("rows_out")
