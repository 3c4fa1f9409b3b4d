"""Sources and sinks: what is written is read back and compared with the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog import policy as CP
from catalog import registry as CR
from catalog._base import big, documents, query, sql_stamp, stamp, table
from textwarden import schemas
from textwarden.operators import decisions as D
from textwarden.operators import plugins as PL
from textwarden.operators import quality as Q
from textwarden.session import fresh_path
from textwarden.sources import files, sinks


@query(
    "labelled_csv",
    """SELECT d.text AS comment_text, CAST(l.toxic AS INTEGER) AS toxic, NULL::VARCHAR AS broken
    FROM documents d JOIN labels l USING (doc_id)""",
)
def labelled_csv(spark, sf):
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    path = fresh_path(spark, "labelled")
    sinks.write_table(rows.select(F.col("text").alias("comment_text"), "toxic"), path, fmt="csv")
    read = files.read_labelled_csv(spark, path, multi_line=True)  # texts hold line breaks
    return read.select("comment_text", "toxic", F.col("_corrupt_record").alias("broken"))


@query(
    "text_file_lines",
    f"""WITH u AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT {B.sql_strip('t')} AS text, count(*) AS n FROM u WHERE {B.sql_strip('t')} <> '' GROUP BY 1""",
)
def text_file_lines(spark, sf):
    path = fresh_path(spark, "lines")
    documents(spark, sf).select("text").write.text(path)
    return files.read_text_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query(
    "json_reports",
    """SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang""",
)
def json_reports(spark, sf):
    path = fresh_path(spark, "report")
    docs = table(spark, sf, "documents")
    stats = docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    sinks.write_report(stats, path)
    return files.read_json_report(spark, path, "lang STRING, docs BIGINT, chars BIGINT")


@query(
    "decision_table",
    f"SELECT event_id, event_type, {sql_stamp('ts')} AS ts, strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def decision_table(spark, sf):
    """Events written by day and read back."""
    path = fresh_path(spark, "decisions")
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sinks.write_table(e, path, ["day"])
    return spark.read.parquet(path).select("event_id", "event_type", stamp("ts").alias("ts"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    "decision_log_table",
    f"""WITH {CP.SQL_ROUTED} SELECT 'run-' || doc_id AS execution_id, substr(text, 1, 100) AS text_preview,
      score AS ml_score, action, confidence, reasoning, enhanced, {CP.SQL_LOGGED_AT} AS ts,
      strftime({CP.SQL_LOGGED}, '%Y-%m-%d') AS day FROM workflow""",
)
def decision_log_table(spark, sf):
    """The log written by day and read back."""
    path = fresh_path(spark, "log")
    sinks.write_table(D.decision_log(CP.logged(spark, sf)), path, ["day"])
    log = spark.read.parquet(path)
    return log.withColumn("ts", stamp("ts")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "repeated_log_runs",
    f"""WITH {CP.SQL_ROUTED}, l AS (SELECT doc_id, action, {CP.SQL_LOGGED} AS logged_at FROM workflow)
    SELECT 'run-' || doc_id AS execution_id, action, strftime(logged_at, '%Y-%m-%d') AS day,
      CASE WHEN doc_id % 3 = 0 THEN 'morning' ELSE 'evening' END AS run FROM l
    WHERE doc_id % 3 <> 0 OR strftime(logged_at, '%d') <> '03'""",
)
def repeated_log_runs(spark, sf):
    """A log written by two runs over the same days, each repeated; one of them without the rows of one day."""
    path = fresh_path(spark, "log-runs")
    logged = CP.logged(spark, sf)
    morning, evening = logged.filter("doc_id % 3 = 0"), logged.filter("doc_id % 3 <> 0")
    again = morning.filter(F.date_format("ts", "dd") != "03")
    for run, rows in (("morning", morning), ("evening", evening), ("evening", evening), ("morning", again)):
        sinks.write_run(D.decision_log(rows), path, run)
    log = spark.read.parquet(path)
    return log.select("execution_id", "action", F.date_format("day", "yyyy-MM-dd").alias("day"), "run")


_STREAM = "CASE event_type WHEN 'click' THEN 'prediction' WHEN 'error' THEN 'alerts' WHEN 'view' THEN 'api-access' ELSE 'other' END"
#: The events' thirty days, spread over four months.
_SPREAD = "CAST(ts AS DATE) + CAST((event_id % 4) * 30 AS INTEGER)"


@query(
    "retention_folders",
    f"""WITH e AS (SELECT event_id, {_STREAM} AS stream, CAST({_SPREAD} AS DATE) AS day FROM events),
    k AS (SELECT *, CASE stream WHEN 'prediction' THEN 30 WHEN 'api-access' THEN 30 WHEN 'alerts' THEN 7 END AS days,
      (SELECT max(day) FROM e) AS newest FROM e),
    x AS (SELECT *, days IS NOT NULL AND day < newest - CAST(days AS INTEGER) AS due FROM k)
    SELECT stream, strftime(day, '%Y-%m-%d') AS day, count(*) AS rows, due FROM x GROUP BY ALL""",
)
def retention_folders(spark, sf):
    """A log of 120 days in four streams after the due day folders were dropped: rows left, and folders gone."""
    path = fresh_path(spark, "retention")
    day = F.expr("date_add(CAST(ts AS DATE), CAST((event_id % 4) * 30 AS INT))")
    log = table(spark, sf, "events").select("event_id", F.expr(_STREAM).alias("stream"), day.alias("day"))
    sinks.write_table(log, path, ["stream", "day"])
    written = log.groupBy("stream", "day").agg(F.count("*").alias("rows"))
    gone = sinks.drop_expired(spark, path, log.agg(F.max("day")).first()[0])
    left = spark.read.schema(log.schema).parquet(path).groupBy("stream", "day").agg(F.count("*").alias("rows"), F.lit(False).alias("due"))
    dropped = written.join(gone.filter("files > 0 AND bytes > 0").select("stream", "day"), ["stream", "day"]).withColumn("due", F.lit(True))
    return left.unionByName(dropped).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "registry_table",
    f"""WITH {CR.SQL_REGISTRY} SELECT kind, name, status, CAST(event_id AS VARCHAR) AS event
    FROM registry""",
)
def registry_table(spark, sf):
    """Registry rows appended in two writes, one folder per kind."""
    path = fresh_path(spark, "registry")
    rows = CR._registry(spark, sf)
    sinks.append_registry(rows.filter("status = 'deployed'"), path)
    sinks.append_registry(rows.filter("status <> 'deployed'"), path)
    return spark.read.parquet(path).select("kind", "name", "status", F.col("payload")["event"].alias("event"))


@query(
    "artifact_listing",
    "SELECT DISTINCT 'day=' || strftime(ts, '%Y-%m-%d') AS folder, TRUE AS has_files FROM events",
)
def artifact_listing(spark, sf):
    """Files of a written table, by folder; contents are not read."""
    path = fresh_path(spark, "artifacts")
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sinks.write_table(e, path, ["day"])
    files_ = files.list_artifacts(spark, path, "day=")
    folder = F.substring_index("key", "/", 1)
    return files_.groupBy(folder.alias("folder")).agg((F.sum("size") > 0).alias("has_files"))


@query(
    "required_columns",
    """SELECT column_name AS name, (SELECT count(*) FROM documents) AS rows FROM (DESCRIBE documents)
    WHERE column_name NOT IN ('doc_id', 'text', 'lang')""",
)
def required_columns(spark, sf):
    """The columns of the documents that a table with three of them lacks, and its rows."""
    docs = table(spark, sf, "documents")
    part = docs.select("doc_id", "text", "lang")
    missing = F.array(*[F.lit(c) for c in Q.missing_columns(part, docs.columns)])
    return part.agg(F.count("*").alias("rows")).select(F.explode(missing).alias("name"), "rows")


def _length_scorer():
    def score(texts):
        if texts.str.contains("@").any():
            raise ValueError("unexpected character")
        return texts.str.len().mod(100) / 100

    return score


@query(
    "plugin_scores",
    """SELECT doc_id, CASE WHEN NOT contains(text, '@') THEN CAST(length(text) % 100 AS DOUBLE) / 100 END
      AS score, CASE WHEN contains(text, '@') THEN 'unexpected character' END AS error FROM documents""",
)
def plugin_scores(spark, sf):
    """A scorer from outside, loaded once per partition; it refuses some texts."""
    docs = documents(spark, sf).select("doc_id", "text")
    return PL.score_partitions(docs, _length_scorer).select("doc_id", "score", "error")


def _reviewer():
    def review(prompts):
        return [f'{{"contextual_toxicity_score": 0.{len(p) % 10}}}' for p in prompts]

    return review


def _picky_reviewer():
    def review(prompts):
        if (prompts.str.len() % 2 == 1).any():
            raise ValueError("odd length")
        return _reviewer()(prompts)

    return review


@query(
    "reviewer_answers",
    f"""WITH {CP.SCORED}, {B.sql_flags('scored')},
    q AS (SELECT doc_id, score, length('Judge whether the text below is harmful in its context.') + 2
      + length('Text: "') + length(text) + length('"') + 2 + length('Model score: 0.000')
      + length(' (0.0 = safe, 1.0 = toxic)') + 1 + length('Risk flags: {{') + 1
      + length('  "excessive_caps": ') + length(excessive_caps::VARCHAR) + 2
      + length('  "excessive_punctuation": ') + length(excessive_punctuation::VARCHAR) + 2
      + length('  "repeated_chars": ') + length(repeated_chars::VARCHAR) + 2
      + length('  "very_short": ') + length(very_short::VARCHAR) + 2
      + length('  "very_long": ') + length(very_long::VARCHAR) + 1 + 1 + 2
      + length('Weigh intent, real-world harm, irony, cultural context, audience and the chance of a false alarm. Answer with one JSON object with the fields: contextual_toxicity_score, recommended_action, confidence, reasoning, harm_categories, context_factors, is_sarcasm, is_false_positive, severity_level, target_audience_risk, cultural_sensitivity, explanation_for_user.')
      AS n FROM flags WHERE score > 0.3::DOUBLE AND score < 0.8::DOUBLE)
    SELECT doc_id, '{{"contextual_toxicity_score": 0.' || (n % 10) || '}}' AS raw, NULL::VARCHAR AS error,
      CAST(n % 2 AS INTEGER) AS reviewer FROM q""",
)
def reviewer_answers(spark, sf):
    """Two reviewers from outside, asked in order for the borderline rows; the first refuses some."""
    requests = D.render_review_requests(CP.scored(spark, sf))
    return PL.ask_reviewer(requests, [_picky_reviewer, _reviewer])


@query(
    "event_source",
    "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type",
)
def event_source(spark, sf):
    """The event table read as a stream and stored."""
    from textwarden.streaming.streams import run_available

    events = files.read_table_stream(spark, sf, "events", schemas.EVENTS)
    stored = run_available(events, "events")
    return stored.groupBy("event_type").agg(
        F.count("*").alias("n"), big(F.max("event_id")).alias("last_id")
    )
