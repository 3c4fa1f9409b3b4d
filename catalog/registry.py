"""Registry, step status and lookups, with the events as their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog._base import query, sql_stamp, stamp, table
from textwarden.operators import ordering as O
from textwarden.operators import registry as R
from textwarden.operators import status as ST

SQL_REGISTRY = """registry AS (SELECT CASE event_type WHEN 'click' THEN 'package' WHEN 'view' THEN 'pipeline'
    WHEN 'signup' THEN 'standalone' WHEN 'purchase' THEN 'endpoint' ELSE 'legacy' END AS kind,
  'item-' || user_id AS name, CASE WHEN event_type <> 'click' THEN 'deployed'
    WHEN value > 60 THEN 'Approved' ELSE 'PendingManualApproval' END AS status, ts, event_id, value,
  props FROM events)"""


def _kind():
    return (
        F.when(F.col("event_type") == "click", "package")
        .when(F.col("event_type") == "view", "pipeline")
        .when(F.col("event_type") == "signup", "standalone")
        .when(F.col("event_type") == "purchase", "endpoint")
        .otherwise("legacy")
    )


def _registry(spark, sf):
    """Every event as a registry row; clicks are model packages."""
    e = table(spark, sf, "events")
    payload = F.create_map(
        F.lit("event"), F.col("event_id").cast("string"), F.lit("framework"), F.lit("1.0")
    )
    extra = F.when(
        F.col("value") > 40, F.create_map(F.lit("framework"), F.lit("2.0"), F.lit("props"), F.col("props"))
    )
    status = (
        F.when(F.col("event_type") != "click", "deployed")
        .when(F.col("value") > 60, "Approved")
        .otherwise("PendingManualApproval")
    )
    name = F.concat(F.lit("item-"), F.col("user_id").cast("string"))
    return R.registry_rows(e, _kind(), name, payload, "ts", status, extra)


@query(
    "registry_rows",
    f"""WITH {SQL_REGISTRY} SELECT kind, name, status, {sql_stamp('ts')} AS ts,
      kind || '_info_' || CAST(floor(epoch(ts)) AS BIGINT) AS key, CAST(event_id AS VARCHAR) AS event,
      CASE WHEN value > 40 THEN '2.0' ELSE '1.0' END AS framework,
      CASE WHEN value > 40 THEN props END AS props FROM registry""",
)
def registry_rows(spark, sf):
    p = F.col("payload")
    return _registry(spark, sf).select(
        "kind", "name", "status", stamp("ts").alias("ts"), "key", p["event"].alias("event"),
        p["framework"].alias("framework"), p["props"].alias("props"),
    )


_SQL_CURRENT = f"""{SQL_REGISTRY}, c AS (SELECT *, min(ts) OVER (PARTITION BY kind, name) AS created,
    row_number() OVER (PARTITION BY kind, name ORDER BY ts DESC, status DESC) AS r FROM registry),
  current AS (SELECT kind, name, status, ts, created, event_id FROM c WHERE r = 1)"""


@query(
    "registry_current",
    f"""WITH {_SQL_CURRENT} SELECT kind, name, status, {sql_stamp('ts')} AS ts,
      {sql_stamp('created')} AS created, CAST(event_id AS VARCHAR) AS event FROM current""",
)
def registry_current(spark, sf):
    c = R.current_state(_registry(spark, sf))
    return c.select(
        "kind", "name", "status", stamp("ts").alias("ts"), stamp("created").alias("created"),
        F.col("payload")["event"].alias("event"),
    )


@query(
    "latest_pending",
    f"""WITH {_SQL_CURRENT} SELECT name, status, {sql_stamp('created')} AS created FROM current
    WHERE kind = 'package' AND status = 'PendingManualApproval' ORDER BY created DESC, name DESC LIMIT 1""",
)
def latest_pending(spark, sf):
    p = R.latest_pending(_registry(spark, sf))
    return p.select("name", "status", stamp("created").alias("created"))


@query(
    "approve_latest",
    f"""WITH {_SQL_CURRENT}, p AS (SELECT name FROM current WHERE kind = 'package'
      AND status = 'PendingManualApproval' ORDER BY created DESC, name DESC LIMIT 1)
    SELECT name, CASE WHEN name IN (SELECT name FROM p) THEN 'Approved' ELSE status END AS status,
      {sql_stamp('created')} AS created FROM current WHERE kind = 'package'""",
)
def approve_latest(spark, sf):
    """The package list after the latest pending one was approved."""
    registry = _registry(spark, sf).drop("key")
    when = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    after = registry.unionByName(R.approve_latest(registry, when))
    return R.list_models(after).select("name", "status", stamp("created").alias("created"))


@query(
    "latest_model",
    f"""WITH {SQL_REGISTRY} SELECT kind, name, {sql_stamp('ts')} AS ts FROM registry
    WHERE kind = 'pipeline' ORDER BY ts DESC, name DESC LIMIT 1""",
)
def latest_model(spark, sf):
    return R.latest_model(_registry(spark, sf)).select("kind", "name", stamp("ts").alias("ts"))


@query(
    "last_runs",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, event_id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 5""",
)
def last_runs(spark, sf):
    runs = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return O.last_n(runs, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


@query(
    "sync_missing",
    """SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS
      (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def sync_missing(spark, sf):
    source = table(spark, sf, "documents").select("doc_id", "source")
    return R.sync_missing(source, table(spark, sf, "labels"), ["doc_id"])


@query(
    "steps_with_jobs",
    """WITH jobs AS (SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS role FROM conversations
      GROUP BY conv_id)
    SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS job, j.role, j.turns FROM events e
    JOIN jobs j ON j.conv_id = e.user_id""",
)
def steps_with_jobs(spark, sf):
    """Events as steps whose path ends in the conversation they belong to."""
    path = F.concat(F.lit("jobs/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    steps = table(spark, sf, "events").select("event_id", path.alias("job_path"))
    jobs = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("job"))
    jobs = jobs.agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("role"))
    return R.steps_with_jobs(steps, jobs).select("event_id", "job", "role", "turns")


@query(
    "flag_available",
    """SELECT DISTINCT d.doc_id AS model, d.doc_id IN (SELECT doc_id FROM labels) AS available
    FROM documents d""",
)
def flag_available(spark, sf):
    models = table(spark, sf, "documents").select(F.col("doc_id").alias("model"))
    reachable = table(spark, sf, "labels").select(F.col("doc_id").alias("model"))
    return R.flag_available(models, reachable)


SQL_STEPS = """steps AS (SELECT event_id, ts, event_type AS step, CASE WHEN value < 1 THEN NULL
  WHEN value < 30 THEN 'Executing' WHEN value < 80 THEN 'Succeeded' WHEN value < 150 THEN 'Failed'
  ELSE 'Stopped' END AS status, props AS failure_reason FROM events)"""


def _steps(spark, sf):
    """Every event as a status of its type's step; small values have none."""
    v = F.col("value")
    status = (
        F.when(v < 1, F.lit(None)).when(v < 30, "Executing").when(v < 80, "Succeeded")
        .when(v < 150, "Failed").otherwise("Stopped")
    )
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("step"), status.alias("status"),
        F.col("props").alias("failure_reason"),
    )


@query(
    "status_changes",
    f"""WITH {SQL_STEPS}, l AS (SELECT *, lag(status) OVER w AS previous_status,
      row_number() OVER w AS r FROM steps WINDOW w AS (PARTITION BY step ORDER BY ts, event_id))
    SELECT event_id, step, status, previous_status FROM l
    WHERE r = 1 OR status IS DISTINCT FROM previous_status""",
)
def status_changes(spark, sf):
    return ST.status_changes(_steps(spark, sf)).select("event_id", "step", "status", "previous_status")


_SQL_FINAL = f"""{SQL_STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY step
    ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY step) AS events FROM steps),
  final AS (SELECT step, status, CASE WHEN status = 'Failed' THEN failure_reason END AS failure_reason,
    coalesce(status IN ('Succeeded', 'Failed', 'Stopped'), FALSE) AS terminal,
    {sql_stamp('ts')} AS last_ts, events FROM l WHERE r = 1)"""


@query("final_status", f"WITH {_SQL_FINAL} SELECT * FROM final")
def final_status(spark, sf):
    return ST.final_status(_steps(spark, sf)).withColumn("last_ts", stamp("last_ts"))


@query("run_summary", f"WITH {_SQL_FINAL} SELECT status, count(*) AS steps FROM final GROUP BY status")
def run_summary(spark, sf):
    return ST.run_summary(ST.final_status(_steps(spark, sf)))


@query(
    "status_changes_by_user",
    f"""WITH {SQL_STEPS.replace('event_id, ts,', 'event_id, ts, user_id,')},
    l AS (SELECT *, lag(status) OVER w AS previous_status,
      row_number() OVER w AS r FROM steps WINDOW w AS (PARTITION BY user_id, step ORDER BY ts, event_id))
    SELECT user_id, step, count(*) AS changes FROM l
    WHERE r = 1 OR status IS DISTINCT FROM previous_status GROUP BY ALL""",
)
def status_changes_by_user(spark, sf):
    users = table(spark, sf, "events").select("event_id", "user_id")
    steps = _steps(spark, sf).join(users, "event_id")
    changes = ST.status_changes(steps, ["user_id", "step"])
    return changes.groupBy("user_id", "step").agg(F.count("*").alias("changes"))
