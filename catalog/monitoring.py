"""Metrics, windows, alarms, logs and reports over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog._base import big, fixture_score, query, sql_stamp, stamp, table
from textwarden.functions import policy as P
from textwarden.functions import scores as S
from textwarden.operators import alarms as A
from textwarden.operators import metrics as M
from textwarden.operators import reports as R

_S = "CAST(event_id * 13 % 101 AS DOUBLE) / 100"
SQL_DECISIONS = f"""decisions AS (SELECT event_id, event_id AS doc_id, ts, user_id, {_S} AS score, value AS latency_ms,
  CASE WHEN {_S} > 0.7::DOUBLE THEN 'block' WHEN {_S} > 0.5::DOUBLE THEN 'review' ELSE 'allow' END AS action,
  CASE WHEN {_S} > 0.7::DOUBLE THEN 'high' WHEN {_S} > 0.5::DOUBLE THEN 'medium' ELSE 'high' END AS confidence,
  {_S} > 0.3::DOUBLE AND {_S} < 0.8::DOUBLE AS routed,
  {_S} > 0.3::DOUBLE AND {_S} < 0.8::DOUBLE AND event_type <> 'error' AS enhanced,
  value * 10 AS reviewer_latency_ms,
  CASE WHEN event_id % 53 = 7 THEN 'model' WHEN event_id % 59 = 8 THEN 'input' END AS failure FROM events)"""


def decisions(spark, sf):
    """Every event as a decision: its value is the latency, its id gives the score."""
    e = table(spark, sf, "events").withColumn("score", fixture_score("event_id"))
    d = P.decide("score", "ml_only")
    routed = S.borderline("score")
    return e.select(
        "event_id", F.col("event_id").alias("doc_id"), "ts", "user_id", "score",
        F.col("value").alias("latency_ms"),
        d["action"].alias("action"), d["confidence"].alias("confidence"), routed.alias("routed"),
        (routed & (F.col("event_type") != "error")).alias("enhanced"),
        (F.col("value") * 10).alias("reviewer_latency_ms"),
        F.when(F.col("event_id") % 53 == 7, "model").when(F.col("event_id") % 59 == 8, "input").alias("failure"),
    )


def metrics(spark, sf):
    """Every event as a metric point of its type."""
    return table(spark, sf, "events").select("ts", F.col("event_type").alias("name"), "value")


_POINTS = """points AS (
  SELECT ts, 'ToxicityPredictionCount' AS name, 1::DOUBLE AS value, 'Count' AS unit FROM decisions
  UNION ALL SELECT ts, 'ToxicityPredictionLatency', latency_ms, 'Milliseconds' FROM decisions
  UNION ALL SELECT ts, 'HighConfidenceCount', 1, 'Count' FROM decisions WHERE confidence = 'high'
  UNION ALL SELECT ts, 'ContentBlockedCount', 1, 'Count' FROM decisions WHERE action = 'block'
  UNION ALL SELECT ts, 'ContentReviewCount', 1, 'Count' FROM decisions WHERE action = 'review'
  UNION ALL SELECT ts, 'SecondOpinionCount', 1, 'Count' FROM decisions WHERE routed
  UNION ALL SELECT ts, 'SecondOpinionLatency', reviewer_latency_ms, 'Milliseconds' FROM decisions
    WHERE enhanced)"""


@query(
    "decision_metrics",
    f"""WITH {SQL_DECISIONS}, {_POINTS} SELECT {sql_stamp('ts')} AS ts, name, value, unit,
      'Production' AS environment FROM points""",
)
def decision_metrics(spark, sf):
    m = M.decision_metrics(decisions(spark, sf))
    return m.select(
        stamp("ts").alias("ts"), "name", "value", "unit", F.col("dims")["Environment"].alias("environment")
    )


@query(
    "request_metrics",
    f"""WITH {SQL_DECISIONS}, p AS (
      SELECT 'PredictionRequestStart' AS name, 1::DOUBLE AS value, 'Count' AS unit, NULL AS action,
        NULL AS confidence FROM decisions
      UNION ALL SELECT 'PredictionLatency', latency_ms, 'Milliseconds', NULL, NULL FROM decisions
      UNION ALL SELECT 'ToxicityScore', score, 'None', NULL, NULL FROM decisions
      UNION ALL SELECT 'SecondOpinionSuccess', 1, 'Count', NULL, NULL FROM decisions WHERE enhanced
      UNION ALL SELECT 'SecondOpinionError', 1, 'Count', NULL, NULL FROM decisions
        WHERE routed AND NOT enhanced
      UNION ALL SELECT 'SecondOpinionLatency', reviewer_latency_ms, 'Milliseconds', NULL, NULL FROM decisions
        WHERE enhanced AND reviewer_latency_ms IS NOT NULL
      UNION ALL SELECT 'ModelError', 1, 'Count', NULL, NULL FROM decisions WHERE failure = 'model'
      UNION ALL SELECT 'PredictionError', 1, 'Count', NULL, NULL FROM decisions WHERE failure <> 'model'
      UNION ALL SELECT 'ModerationDecision', 1, 'Count', action, confidence FROM decisions WHERE failure IS NULL)
    SELECT name, unit, action, confidence, count(*) AS points, {B.sql_steady("sum(value)", 3)} AS total
    FROM p GROUP BY ALL""",
)
def request_metrics(spark, sf):
    m = M.request_metrics(decisions(spark, sf))
    action, confidence = F.col("dims")["Action"], F.col("dims")["Confidence"]
    return m.groupBy("name", "unit", action.alias("action"), confidence.alias("confidence")).agg(
        F.count("*").alias("points"), B.steady(F.sum("value"), 3).alias("total")
    )


@query(
    "metric_totals",
    f"""WITH {SQL_DECISIONS}, {_POINTS} SELECT name, count(*) AS points, {B.sql_steady("sum(value)", 3)} AS total,
      {B.sql_steady("avg(value)")} AS mean FROM points GROUP BY name""",
)
def metric_totals(spark, sf):
    t = M.metric_totals(M.decision_metrics(decisions(spark, sf)))
    return t.select("name", "points", B.steady("total", 3).alias("total"), B.steady("mean").alias("mean"))


def _sql_window(agg: str, minutes: int, where: str = "") -> str:
    return f"""SELECT {sql_stamp(f"time_bucket(INTERVAL {minutes} MINUTE, ts)")} AS window_start,
      event_type AS name, {B.sql_steady(agg)} AS value FROM events {where} GROUP BY 1, 2"""


def _stamped(df):
    return df.withColumn("window_start", stamp("window_start"))


@query("windowed_sum", _sql_window("sum(value)", 5, "WHERE event_type IN ('click', 'error')"))
def windowed_sum(spark, sf):
    w = M.windowed_stat(metrics(spark, sf), "5 minutes", "Sum", ("click", "error"))
    return _stamped(w).withColumn("value", B.steady("value"))


@query("windowed_average", _sql_window("avg(value)", 5))
def windowed_average(spark, sf):
    w = M.windowed_stat(metrics(spark, sf), "5 minutes", "Average")
    return _stamped(w).withColumn("value", B.steady("value"))


@query(
    "windowed_statistics",
    f"""SELECT {sql_stamp("time_bucket(INTERVAL 1 DAY, ts)")} AS window_start, event_type AS name,
      {B.sql_steady("sum(value)", 3)} AS sum, {B.sql_steady("avg(value)")} AS average, min(value) AS minimum,
      max(value) AS maximum, CAST(count(value) AS DOUBLE) AS samplecount FROM events GROUP BY 1, 2""",
)
def windowed_statistics(spark, sf):
    w = _stamped(M.windowed_stat(metrics(spark, sf), "1 day"))
    return w.withColumn("sum", B.steady("sum", 3)).withColumn("average", B.steady("average"))


def _share(points):
    return points.select(
        stamp("ts").alias("window_start"), "name", F.round("value", 4).alias("value"), "among"
    )


@query(
    "high_confidence_share",
    f"""WITH {SQL_DECISIONS} SELECT {sql_stamp("time_bucket(INTERVAL 5 MINUTE, ts)")} AS window_start,
      'HighConfidencePredictions' AS name,
      round(100 * avg(CASE WHEN confidence = 'high' THEN 1::DOUBLE ELSE 0 END), 4) AS value,
      count(*) AS among FROM decisions GROUP BY 1""",
)
def high_confidence_share(spark, sf):
    return _share(M.high_confidence_pct(decisions(spark, sf)))


@query(
    "false_positive_share",
    f"""WITH {SQL_DECISIONS}, j AS (SELECT d.*, l.toxic AS label FROM decisions d JOIN labels l USING (doc_id))
    SELECT {sql_stamp("time_bucket(INTERVAL 15 MINUTE, ts)")} AS window_start,
      'FalsePositiveRate' AS name, count(*) FILTER (WHERE label = 0) AS among,
      round(CASE WHEN count(*) FILTER (WHERE label = 0) > 0 THEN 100.0::DOUBLE
        * count(*) FILTER (WHERE label = 0 AND action <> 'allow') / count(*) FILTER (WHERE label = 0)
        ELSE 0 END, 4) AS value FROM j GROUP BY 1""",
)
def false_positive_share(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return _share(M.false_positive_pct(decisions(spark, sf), labels))


@query(
    "metric_names",
    """WITH n AS (SELECT DISTINCT event_type AS name FROM events)
    SELECT count(*) AS n_names, array_to_string(list_sort(list(name))[1:5], ',') AS first FROM n""",
)
def metric_names(spark, sf):
    m = M.metric_names(metrics(spark, sf))
    return m.select("n_names", F.array_join("first", ",").alias("first"))


# limits that the values of the given events cross now and then, but never meet
ALARMS = (
    ("ErrorSum", "error", "Sum", ">", 150.005, 2, 3600),
    ("SlowClicks", "click", "Average", ">", 55.0037, 3, 3600),
    ("FewViews", "view", "SampleCount", "<", 2.5, 2, 3600),
    ("SmallPurchases", "purchase", "Maximum", "<", 60.005, 3, 1800),
)

_SQL_ALARMS = f"""a(alarm, metric, stat, op, threshold, periods, period_s) AS (VALUES
    {", ".join(str(row) for row in ALARMS)}),
  pts AS (SELECT a.*, CAST(floor(epoch(ts) / period_s) * period_s AS BIGINT) AS slot, value
    FROM events JOIN a ON event_type = metric),
  wins AS (SELECT alarm, slot, CASE any_value(stat) WHEN 'Sum' THEN sum(value) WHEN 'Average' THEN avg(value)
    WHEN 'Maximum' THEN max(value) ELSE CAST(count(*) AS DOUBLE) END AS value FROM pts GROUP BY ALL),
  span AS (SELECT alarm, min(slot) AS lo, max(slot) AS hi FROM wins GROUP BY alarm),
  grid AS (SELECT a.*, unnest(generate_series(lo, hi, CAST(period_s AS BIGINT))) AS slot
    FROM a JOIN span USING (alarm)),
  filled AS (SELECT g.*, w.value, coalesce(CASE WHEN op = '>' THEN w.value > threshold::DOUBLE
    ELSE w.value < threshold::DOUBLE END, FALSE) AS breach FROM grid g LEFT JOIN wins w USING (alarm, slot)),
  lagged AS (SELECT *, breach AND coalesce(lag(breach, 1) OVER o, FALSE)
      AND (periods < 3 OR coalesce(lag(breach, 2) OVER o, FALSE)) AS in_alarm
    FROM filled WINDOW o AS (PARTITION BY alarm ORDER BY slot))"""


@query(
    "evaluate_alarms",
    f"""WITH {_SQL_ALARMS} SELECT alarm, metric, CAST(slot AS BIGINT) AS slot, {B.sql_steady("value")} AS value,
      breach, in_alarm FROM lagged""",
)
def evaluate_alarms(spark, sf):
    e = A.evaluate_alarms(metrics(spark, sf), ALARMS)
    return e.select("alarm", "metric", "slot", B.steady("value").alias("value"), "breach", "in_alarm")


@query(
    "alarm_changes",
    f"""WITH {_SQL_ALARMS}, b AS (SELECT *, lag(in_alarm, 1, FALSE) OVER (PARTITION BY alarm ORDER BY slot)
      AS was FROM lagged)
    SELECT alarm, CAST(slot AS BIGINT) AS slot, CASE WHEN in_alarm THEN 'ALARM' ELSE 'OK' END AS state,
      {B.sql_steady("value")} AS value FROM b WHERE in_alarm <> was""",
)
def alarm_changes(spark, sf):
    c = A.alarm_changes(A.evaluate_alarms(metrics(spark, sf), ALARMS))
    return c.withColumn("value", B.steady("value"))


def feed(spark, sf):
    """The points the default alarms watch: those of the decisions and the two shares."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return M.alarm_feed(decisions(spark, sf), labels)


SQL_FEED = f"""{SQL_DECISIONS}, {_POINTS},
  feed AS (SELECT ts, name, value FROM points
    UNION ALL SELECT time_bucket(INTERVAL 5 MINUTE, ts), 'HighConfidencePredictions',
      100.0::DOUBLE * count(*) FILTER (WHERE confidence = 'high') / count(*) FROM decisions GROUP BY 1
    UNION ALL SELECT time_bucket(INTERVAL 15 MINUTE, ts), 'FalsePositiveRate',
      100.0::DOUBLE * count(*) FILTER (WHERE toxic = 0 AND action <> 'allow') / count(*) FILTER (WHERE toxic = 0)
      FROM decisions JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (WHERE toxic = 0) > 0)"""


def sql_alarm_states(alarms, points: str, closed: str | None = None) -> str:
    """Value, breach and state of every window of alarms with any periods; needs ``points`` (ts, name, value).

    Up to an epoch second ``closed``, if given, with the windows before it that have no points.
    """
    ended = f"slot + period_s <= {closed}" if closed else "TRUE"
    last = f"CAST(floor({closed} / period_s) * period_s - period_s AS BIGINT)" if closed else "max(slot)"
    rows = ", ".join(str(tuple(row[:7])) for row in alarms)
    return f"""a(alarm, metric, stat, op, threshold, periods, period_s) AS (VALUES {rows}),
  apts AS (SELECT a.*, CAST(floor(epoch(ts) / period_s) * period_s AS BIGINT) AS slot, value
    FROM {points} p JOIN a ON p.name = metric),
  awins AS (SELECT alarm, period_s, slot, CASE any_value(stat) WHEN 'Sum' THEN sum(value) WHEN 'Average' THEN avg(value)
    WHEN 'Maximum' THEN max(value) ELSE CAST(count(*) AS DOUBLE) END AS value FROM apts
    GROUP BY alarm, slot, period_s HAVING {ended}),
  aspan AS (SELECT alarm, period_s, min(slot) AS lo, {last} AS hi FROM awins GROUP BY alarm, period_s),
  agrid AS (SELECT a.*, lo, unnest(generate_series(lo, hi, CAST(period_s AS BIGINT))) AS slot
    FROM a JOIN aspan USING (alarm, period_s)),
  afilled AS (SELECT g.*, w.value, coalesce(CASE WHEN op = '>' THEN w.value > threshold::DOUBLE
    ELSE w.value < threshold::DOUBLE END, FALSE) AS breach FROM agrid g LEFT JOIN awins w USING (alarm, slot)),
  astate AS (SELECT *, breach AND slot - coalesce(max(slot) FILTER (WHERE NOT breach) OVER o, lo - period_s)
      >= periods * period_s AS in_alarm
    FROM afilled WINDOW o AS (PARTITION BY alarm ORDER BY slot)),
  awas AS (SELECT *, lag(in_alarm, 1, FALSE) OVER (PARTITION BY alarm ORDER BY slot) AS was FROM astate)"""


@query(
    "default_alarms",
    f"""WITH {SQL_FEED}, {sql_alarm_states(A.K.ALARMS, 'feed')} SELECT alarm, metric, CAST(slot AS BIGINT) AS slot,
      {B.sql_steady("value")} AS value, breach, in_alarm FROM astate""",
)
def default_alarms(spark, sf):
    """The default alarms over all points of the decisions."""
    e = A.evaluate_alarms(feed(spark, sf))
    return e.select("alarm", "metric", "slot", B.steady("value").alias("value"), "breach", "in_alarm")


@query(
    "log_patterns",
    f"""WITH logs AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
      CASE WHEN value > 50 THEN 'TOXIC content ' ELSE 'clean content ' END || props AS message FROM events)
    SELECT {sql_stamp("time_bucket(INTERVAL 5 MINUTE, ts)")} AS window_start,
      count(*) FILTER (WHERE level = 'INFO' AND starts_with(message, 'TOXIC')) AS toxic,
      count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs GROUP BY 1""",
)
def log_patterns(spark, sf):
    e = table(spark, sf, "events")
    start = F.when(F.col("value") > 50, "TOXIC content ").otherwise("clean content ")
    logs = e.select(
        "ts",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(start, "props").alias("message"),
    )
    return _stamped(M.count_log_patterns(logs, [("toxic", "INFO", "TOXIC"), ("errors", "ERROR", "")]))


@query(
    "retention",
    """SELECT event_id, event_type FROM events WHERE CASE event_type
      WHEN 'click' THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
      WHEN 'error' THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY ELSE TRUE END""",
)
def retention(spark, sf):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf, "events")
    kept = M.apply_retention(e, as_of, {"click": 7, "error": 20}, "event_type")
    return kept.select("event_id", "event_type")


SQL_RESULTS = """results AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  value AS latency_ms, event_type = 'purchase' AS enhanced FROM events)"""


def results(spark, sf):
    """Every event as a timed call; errors are failed calls."""
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "purchase").alias("enhanced"),
    )


@query(
    "latency_summary",
    f"""WITH {SQL_RESULTS} SELECT {B.sql_steady("avg(latency_ms) FILTER (WHERE status = 'success')")}
        AS avg_latency_ms, min(latency_ms) FILTER (WHERE status = 'success') AS min_latency_ms,
      max(latency_ms) FILTER (WHERE status = 'success') AS max_latency_ms,
      round(count(*) FILTER (WHERE status = 'success')::DOUBLE / count(*), 6) AS success_rate,
      round(count(*) FILTER (WHERE status = 'success' AND enhanced)::DOUBLE / count(*), 6)
        AS reviewer_rate FROM results""",
)
def latency_summary(spark, sf):
    s = R.latency_summary(results(spark, sf))
    return (
        s.withColumn("avg_latency_ms", B.steady("avg_latency_ms"))
        .withColumn("success_rate", F.round("success_rate", 6))
        .withColumn("reviewer_rate", F.round("reviewer_rate", 6))
    )


@query(
    "toxic_summary",
    f"""SELECT count(*) FILTER (WHERE {B.SQL_SCORE} > 0.5::DOUBLE) AS toxic, count(*) AS total
    FROM documents""",
)
def toxic_summary(spark, sf):
    return R.toxic_summary(table(spark, sf, "documents").select(fixture_score().alias("score")))


SQL_CHECKS = """checks AS (SELECT event_type || '_check' AS category, 'check-' || lpad(CAST(event_id AS VARCHAR), 9, '0')
  AS test, CASE WHEN value > 120 THEN 'failed' WHEN value > 110 THEN 'warning' ELSE 'passed' END AS status,
  CASE WHEN value > 200 THEN NULL ELSE props END AS error FROM events)"""


def checks(spark, sf):
    """Every event as a check of its type; large values fail."""
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.concat("event_type", F.lit("_check")).alias("category"),
        F.concat(F.lit("check-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("test"),
        F.when(v > 120, "failed").when(v > 110, "warning").otherwise("passed").alias("status"),
        F.when(v > 200, F.lit(None)).otherwise(F.col("props")).alias("error"),
    )


@query(
    "pass_rate_report",
    f"""WITH {SQL_CHECKS}, g AS (SELECT category, count(*) FILTER (WHERE status = 'passed') AS passed,
      count(*) AS total FROM checks GROUP BY ROLLUP (category)),
    r AS (SELECT *, 100.0::DOUBLE * passed / total AS rate FROM g)
    SELECT coalesce(category, 'overall') AS category, CASE WHEN category IS NULL THEN 'Overall'
        ELSE upper(category[1]) || replace(replace(category, '_check', ' Check')[2:], '_', ' ') END AS title,
      passed, total, round(rate, 4) AS rate, CASE WHEN category IS NULL THEN
        CASE WHEN rate >= 90 THEN 'ok' WHEN rate >= 70 THEN 'warn' ELSE 'bad' END
        ELSE CASE WHEN rate >= 80 THEN 'ok' WHEN rate >= 50 THEN 'warn' ELSE 'bad' END END AS status
    FROM r""",
)
def pass_rate_report(spark, sf):
    return R.pass_rate_report(checks(spark, sf)).withColumn("rate", F.round("rate", 4))


@query("failed_checks", f"WITH {SQL_CHECKS} SELECT * FROM checks WHERE status = 'failed'")
def failed_checks(spark, sf):
    return R.failed_checks(checks(spark, sf))


@query(
    "top_failures",
    f"""WITH {SQL_CHECKS} SELECT category, test, substr(coalesce(error, 'Unknown error'), 1, 100) || '...'
      AS error FROM checks WHERE status = 'failed' ORDER BY category, test LIMIT 5""",
)
def top_failures(spark, sf):
    return R.top_failures(checks(spark, sf))


@query(
    "decision_cube",
    f"""WITH {SQL_DECISIONS} SELECT CASE WHEN grouping(action) = 1 THEN 'all' ELSE action END AS action,
      CASE WHEN grouping(confidence) = 1 THEN 'all' ELSE confidence END AS confidence, count(*) AS n
    FROM decisions GROUP BY CUBE (action, confidence)""",
)
def decision_cube(spark, sf):
    return R.decision_cube(decisions(spark, sf))


@query(
    "time_functions",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, {sql_stamp('ts')} AS plain,
      CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s,
      CAST(floor((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000) AS BIGINT) AS ms_in_hour
    FROM events""",
)
def time_functions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        S.iso_time("ts").alias("iso"),
        S.plain_time("ts").alias("plain"),
        big(S.epoch_seconds("ts")).alias("epoch_s"),
        S.duration_ms(F.date_trunc("hour", "ts").cast("timestamp_ntz"), "ts").alias("ms_in_hour"),
    )


@query(
    "identifier_functions",
    """SELECT page_id, string_split(url, '/')[-1] AS last_part, string_split(url, ':')[-1] AS after_colon,
      len(list_filter(string_split(url, '/'), lambda x: contains(lower(x), 'example'))) > 0 AS has_host
    FROM pages""",
)
def identifier_functions(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        S.last_part("url").alias("last_part"),
        S.last_part("url", ":").alias("after_colon"),
        S.any_contains(F.split("url", "/"), "Example").alias("has_host"),
    )
