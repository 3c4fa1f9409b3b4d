"""Streams in several batches against the batch operators over the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catalog import streaming as CS
from textwarden.operators import alarms as A
from textwarden.operators import decisions as D
from textwarden.operators import status as ST
from textwarden.plans import moderation as MO
from textwarden.session import fresh_path
from textwarden.sources.files import read_event_stream
from textwarden.streaming import stateful as SF
from textwarden.streaming import streams as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id INT, ts TIMESTAMP_NTZ, name STRING, value DOUBLE, status STRING"


@pytest.fixture(scope="module")
def events(spark):
    """Three files of events in time order; one name has two thirds of them."""
    r = random.Random(11)
    rows, t = [], START
    for i in range(900):
        t += dt.timedelta(minutes=r.choice([0, 1, 2, 9]))
        rows.append((i, t, r.choice(["a", "a", "b"]), float(r.randint(0, 40)), r.choice(["x", "x", "y"])))
    path = fresh_path(spark, "events")
    for n in range(3):
        part = rows[n * 300 : (n + 1) * 300]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.schema(SCHEMA).parquet(path)


def stream(spark, path):
    return read_event_stream(spark, path, SCHEMA, files_per_trigger=1)


def epoch(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds())


def files(spark, batches, schema, name="files"):
    """A folder with one file per batch, in their order."""
    path = fresh_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def changes_until(batch, alarms, limit):
    """Alarm changes over the windows that end by ``limit``; after a metric's last point it is silent."""
    evaluated = A.evaluate_alarms(batch, alarms)
    period = {a[0]: a[6] for a in alarms}
    changes = {tuple(r) for r in A.alarm_changes(evaluated).select("alarm", "slot", "state").collect()}
    changes = {c for c in changes if c[1] + period[c[0]] <= limit}
    closed = evaluated.collect()
    for name, p in period.items():
        mine = [r for r in closed if r["alarm"] == name and r["slot"] + p <= limit]
        last = max(mine, key=lambda r: r["slot"], default=None)
        if last and last["in_alarm"] and last["slot"] + 2 * p <= limit:
            changes.add((name, last["slot"] + p, "OK"))
    return changes


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_windows_equal_batch(spark, events):
    path, batch = events
    points = stream(spark, path).select("ts", "name", "value")
    w = S.windowed_metrics_stream(points, delay="1000 hours").drop("window_end", "mean")
    got = S.latest_updates(S.run_available(w, "w", "update"), ["window_start", "name"])
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(
        F.window("ts", "5 minutes")["start"].alias("window_start"), "name"
    ).agg(F.sum("value").alias("total"), F.count("*").alias("points"))
    cols = ("window_start", "name", "total", "points")
    assert as_set(got, *cols) == as_set(want, *cols)


def test_alarm_stream_equals_batch(spark, events):
    path, batch = events
    alarms = [("A", "a", "Sum", ">", 25.0, 2, 300), ("B", "b", "Average", ">", 20.0, 1, 300)]
    points = stream(spark, path).select("ts", "name", "value")
    got = S.run_available(SF.alarm_stream(points, alarms, "0 seconds"), "alarms")
    # the stream has seen the windows that end by the newest event
    newest = batch.agg(F.max("ts")).first()[0]
    assert as_set(got, "alarm", "slot", "state") == changes_until(batch, alarms, epoch(newest))
    assert got.count() > 20


def test_a_silent_metric_ends_its_alarm(spark):
    """Points stop while the alarm is on: OK for the first empty window, when the watermark passes its end."""
    at = lambda s: START + dt.timedelta(seconds=s)
    alarms = [("Hot", "m", "Sum", ">", 5.0, 2, 60), ("Long", "m", "Sum", ">", 5.0, 9, 60)]
    schema = "ts TIMESTAMP_NTZ, name STRING, value DOUBLE"
    breach = [(at(60 * i), "m", 9.0) for i in range(3)]
    start = epoch(START)
    for beat, want in ((239, []), (240, [(start + 180, "OK", None)]), (100_000, [(start + 180, "OK", None)])):
        path = files(spark, [breach, [(at(beat), "other", 1.0)], [(at(beat), "other", 1.0)]], schema)
        points = read_event_stream(spark, path, schema, files_per_trigger=1)
        got = S.run_available(SF.alarm_stream(points, alarms, "0 seconds"), "silent").orderBy("slot").collect()
        on = [] if beat < 180 else [(start + 60, "ALARM", 9.0)]
        assert [tuple(r)[1:] for r in got] == on + want
        assert {r["alarm"] for r in got} <= {"Hot"}


def test_an_alarm_comes_back_after_silence(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    schema = "ts TIMESTAMP_NTZ, name STRING, value DOUBLE"
    hot = lambda *minutes: [(at(60 * m), "m", 9.0) for m in minutes]
    path = files(spark, [hot(0, 1), [(at(700), "x", 0.0)], hot(12), hot(13, 14), [(at(2000), "x", 0.0)]], schema)
    points = read_event_stream(spark, path, schema, files_per_trigger=1)
    alarms = [("Hot", "m", "Sum", ">", 5.0, 2, 60)]
    got = as_set(S.run_available(SF.alarm_stream(points, alarms, "0 seconds"), "back"), "alarm", "slot", "state")
    assert got == changes_until(spark.read.parquet(path), alarms, epoch(at(2000)))
    assert [s for _, _, s in sorted(got, key=lambda r: r[1])] == ["ALARM", "OK", "ALARM", "OK"]


STATUS = ("event_id", "step", "status", "previous_status")


def closed_changes(batch, limit, piece_s=600):
    """Status changes of the events in pieces of time that end by ``limit``."""
    rows = ST.status_changes(batch).collect()
    return {tuple(r[c] for c in STATUS) for r in rows if (epoch(r["ts"]) // piece_s + 1) * piece_s <= limit}


def test_status_stream_equals_batch(spark, events):
    path, batch = events
    steps = stream(spark, path).select(F.col("name").alias("step"), "status", "ts", "event_id")
    got = S.run_available(SF.status_change_stream(steps, delay="0 seconds"), "status")
    newest = batch.agg(F.max("ts")).first()[0]
    assert as_set(got, *STATUS) == closed_changes(batch.withColumnRenamed("name", "step"), epoch(newest))


def test_status_events_out_of_order(spark):
    """Events are dealt over the files up to the delay too early or too late; null steps and statuses are values."""
    r = random.Random(4)
    schema = "event_id INT, ts TIMESTAMP_NTZ, step STRING, status STRING"
    rows = []
    for i in range(600):
        t = START + dt.timedelta(seconds=r.choice([20, 40]) * i)
        rows.append((i, t, r.choice(["a", "a", "a", "b", None]), r.choice(["x", "x", "y", None])))
    moved = sorted(rows, key=lambda e: e[1] + dt.timedelta(seconds=r.randrange(500)))
    end = START + dt.timedelta(days=2)
    batches = [moved[n : n + 100] for n in range(0, 600, 100)] + [[(9000, end, "end", "x"), (9001, None, "a", "y")]]
    path = files(spark, batches, schema)
    live = read_event_stream(spark, path, schema, files_per_trigger=1)
    got = S.run_available(SF.status_change_stream(live, delay="10 minutes", piece_s=120), "status")
    batch = spark.createDataFrame(rows, schema)
    assert got.count() == len(as_set(got, *STATUS))
    assert as_set(got, *STATUS) == closed_changes(batch, epoch(end), 120)
    assert as_set(got.select("event_id", "ts"), "event_id", "ts") <= {(e[0], e[1]) for e in rows}


def test_stream_goes_on_where_it_ended(spark, events):
    path, batch = events
    out, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    for _ in range(2):
        got = S.run_available(stream(spark, path), "again", out=out, state=state)
    assert got.count() == batch.count()


def test_moderation_stream_equals_batch(spark):
    texts = ["", "  ", "ok", "http://x.example", "KILL THEM ALL!!!!", "a fine day &amp; more", None, "x" * 1200]
    rows = [(i, t, i / 10) for i, t in enumerate(texts)]
    schema = "doc_id INT, text STRING, s DOUBLE"
    path = fresh_path(spark, "docs")
    spark.createDataFrame(rows, schema).write.parquet(path)
    answers = spark.createDataFrame([(5, '{"contextual_toxicity_score": 0.9, "recommended_action": "block"}')], "doc_id INT, raw STRING")
    live = S.moderate_stream(read_event_stream(spark, path, schema), F.col("s"), verdicts=answers)
    cols = ("doc_id", "outcome", "final_score", "action", "confidence", "reason", "error", "enhanced")
    got = S.run_available(live.select(*cols), "mod")
    ready = MO.prepare(spark.read.schema(schema).parquet(path)).withColumn("score", F.col("s"))
    want = MO.moderate(ready, answers)
    assert as_set(got, *cols) == as_set(want, *cols)
    outcomes = {r["doc_id"]: (r["outcome"], r["action"]) for r in got.collect()}
    assert outcomes[0] == ("invalid_empty", None) and outcomes[6] == ("invalid_empty", None)
    assert outcomes[1] == ("empty_after_clean", None) and outcomes[3] == ("empty_after_clean", None)
    assert outcomes[2] == ("too_short", "allow")
    assert outcomes[5] == ("scored", "block")


def test_one_decision_per_row_by_the_newest_answer_in_time(spark, events):
    """Answers of several batches, early, late, empty and repeated; equal to the batch workflow of those in time."""
    path, batch = events
    r = random.Random(6)
    rows = batch.orderBy("event_id").collect()
    waits = [(-3, "review"), (0, "allow"), (1, "block"), (4, None), (9, "allow"), (10, "review"), (11, "block"), (90, "block")]
    answers = []
    for e in rows:
        for minutes, action in r.sample(waits, r.randrange(4)):
            answers.append((e["event_id"], e["ts"] + dt.timedelta(minutes=minutes), action))
    answers.sort(key=lambda a: a[1] + dt.timedelta(minutes=r.randrange(8)))
    end = START + dt.timedelta(days=30)
    a_schema = "event_id INT, answer_ts TIMESTAMP_NTZ, action STRING"
    a_path = files(spark, [answers[i : i + 200] for i in range(0, len(answers), 200)] + [[(None, end, None)]], a_schema)
    s_path = files(spark, [[tuple(e) for e in rows[i : i + 180]] for i in range(0, 900, 180)] + [[(None, end, None, None, None)]], SCHEMA)
    scored = read_event_stream(spark, s_path, SCHEMA, files_per_trigger=1).select("event_id", "ts", F.lit(0.5).alias("score"), "name")
    given = read_event_stream(spark, a_path, a_schema, files_per_trigger=1)
    out = S.run_available(SF.verdict_return_stream(scored, given, "event_id"), "newest").filter("event_id IS NOT NULL")
    times = {e["event_id"]: e["ts"] for e in rows}
    in_time = [a for a in answers if times[a[0]] <= a[1] <= times[a[0]] + dt.timedelta(minutes=10)]
    verdicts = spark.createDataFrame(in_time, "event_id INT, ts TIMESTAMP_NTZ, action STRING")
    want = D.route_workflow(batch.select("event_id", "ts", F.lit(0.5).alias("score"), "name"), verdicts, "event_id")
    cols = ("event_id", "ts", "name", "branch", "final_decision", "action", "confidence", "reasoning", "fallback_used")
    assert out.count() == 900
    assert as_set(out, *cols) == as_set(want, *cols)
    assert {x["action"] for x in out.collect()} == {"allow", "block", "review"}


def test_a_row_waits_until_its_time_and_goes_on_after_a_stop(spark):
    """The rows of one key leave one by one; what waits when the stream stops leaves when it goes on."""
    at = lambda m: START + dt.timedelta(minutes=m)
    s_schema, a_schema = "k STRING, ts TIMESTAMP_NTZ, score DOUBLE", "k STRING, answer_ts TIMESTAMP_NTZ, action STRING"
    s_path = files(spark, [[("a", at(0), 0.5), ("a", at(5), 0.6), ("b", None, 0.5), (None, at(1), 0.5), ("c", at(0), 0.9)]], s_schema)
    a_path = files(spark, [[("a", at(7), "block"), ("a", at(12), "allow"), ("x", at(1), "block")]], a_schema)
    out, state = fresh_path(spark, "out"), fresh_path(spark, "state")

    def run():
        scored, answers = (read_event_stream(spark, p, s) for p, s in ((s_path, s_schema), (a_path, a_schema)))
        return S.run_available(SF.verdict_return_stream(scored, answers, "k"), "goes-on", out=out, state=state)

    rows = [(r["k"], r["score"], r["action"]) for r in run().collect()]
    assert sorted(rows, key=str) == [("b", 0.5, "review"), ("c", 0.9, "block"), (None, 0.5, "review")]
    for minute, left in ((21, [("a", 0.5, "block")]), (60, [("a", 0.6, "allow")])):
        for p, s, row in ((s_path, s_schema, (None, at(minute), None)), (a_path, a_schema, (None, at(minute), None))):
            spark.createDataFrame([row], s).write.mode("append").parquet(p)
        before = len(rows)
        rows = [(r["k"], r["score"], r["action"]) for r in run().filter("score IS NOT NULL").collect()]
        assert len(rows) == before + 1 and set(left) <= set(rows)


def test_late_rows_are_decided(spark):
    """A row that comes long after the watermark has passed it is not dropped."""
    at = lambda h: START + dt.timedelta(hours=h)
    s_schema, a_schema = "k INT, ts TIMESTAMP_NTZ, score DOUBLE", "k INT, answer_ts TIMESTAMP_NTZ, action STRING"
    s_path = files(spark, [[(1, at(0), 0.5)], [(2, at(50), 0.5)], [(3, at(1), 0.5)], [(4, at(100), 0.5)], [(None, at(200), None)]], s_schema)
    a_path = files(spark, [[(None, at(h), None)] for h in (1, 50, 60, 100, 200)], a_schema)
    scored, answers = (read_event_stream(spark, p, s, files_per_trigger=1) for p, s in ((s_path, s_schema), (a_path, a_schema)))
    out = S.run_available(SF.verdict_return_stream(scored, answers, "k"), "late").filter("k IS NOT NULL")
    assert sorted((r["k"], r["action"]) for r in out.collect()) == [(k, "review") for k in (1, 2, 3, 4)]


def test_rows_without_need_of_an_answer_leave_at_once(spark, events):
    path, batch = events
    low = F.when(F.col("event_id") % 3 == 0, 0.9).when(F.col("event_id") % 3 == 1, 0.1).otherwise(float("nan"))
    scored = stream(spark, path).select("event_id", "ts", low.alias("score"))
    answers = stream(spark, path).select("event_id", F.col("ts").alias("answer_ts"), F.lit("allow").alias("action"))
    out = S.run_available(SF.verdict_return_stream(scored, answers, "event_id"), "direct")
    actions = {r["event_id"]: r["action"] for r in out.collect()}
    assert len(actions) == batch.count()
    assert [actions[i] for i in range(3)] == ["block", "allow", "review"]


def test_alarms_of_two_periods(spark, events):
    path, batch = events
    alarms = [("A", "a", "Sum", ">", 25.0, 2, 300, {}), ("B", "b", "Average", ">", 20.0, 1, 900, {"Environment": "Test"})]
    dims = F.create_map(F.lit("Environment"), F.when(F.col("event_id") % 2 == 0, "Test").otherwise("Production"))
    points = stream(spark, path).select("ts", "name", "value", dims.alias("dims"))
    got = S.run_available(SF.alarm_stream(points, alarms, "0 seconds"), "alarms")
    newest = batch.agg(F.max("ts")).first()[0]
    want = changes_until(batch.withColumn("dims", dims), alarms, epoch(newest))
    assert as_set(got, "alarm", "slot", "state") == want
    assert {r["alarm"] for r in got.collect()} == {"A", "B"}


def test_alerts_stream(spark, events):
    path, batch = events
    decided = stream(spark, path).select(
        "event_id",
        F.when(F.col("value") > 30, "BLOCKED").otherwise("ALLOWED").alias("final_decision"),
        F.lit("r").alias("reasoning"),
    )
    out = fresh_path(spark, "alerts")
    S.finish(S.append_alerts(decided, out, fresh_path(spark, "p"), ["event_id"]))
    want = {r[0] for r in batch.filter("value > 30").select("event_id").collect()}
    assert {r[0] for r in spark.read.parquet(out).select("event_id").collect()} == want
    assert D.blocked_alerts(decided).isStreaming


def test_batches_do_not_grow_with_the_rows(spark, monkeypatch):
    """Ten times the rows are ten times the files, in as many batches, still in time order."""
    monkeypatch.setattr(CS, "FILE_ROWS", 10)
    rows = spark.range(600).select("id", (F.lit(START) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    live = CS._in_batches(rows, "batches")
    got = S.run_available(live.withColumn("file", F.col("_metadata.file_name")), "batches", "update")
    per_batch = got.groupBy("batch").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("file").alias("files"))
    found = per_batch.orderBy("batch").collect()
    assert len(found) == CS.BATCHES and all(b["files"] > 1 for b in found)
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]))
    assert got.count() == 600


class FakeHandle:
    """List states of one key in memory, which count the calls, and the timers that were set."""

    def __init__(self):
        self.lists, self.calls, self.timers = {}, 0, []

    def getListState(self, name, schema):
        values, handle = self.lists.setdefault(name, []), self

        class State:
            def appendValue(self, value):
                handle.calls += 1
                values.append(value)

            def get(self):
                handle.calls += 1
                return iter(values)

            def clear(self):
                handle.calls += 1
                values.clear()

        return State()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class FakeTime:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_calls_to_the_state_do_not_grow_with_the_rows():
    """Thousands of rows of a key are kept and given back by a handful of calls, not one or more each."""
    handle = FakeHandle()
    wait = SF.VerdictProcessor(["k", "__at", "__action"], ["__bucket", "k", "__answer", "__at", "__action"], 1000)
    wait.init(handle)
    rows = [(1, i, False, 0, None) for i in range(3000)] + [(1, i, True, 500_000, "block") for i in range(0, 3000, 2)]
    assert list(wait.handleInputRows((1,), iter(rows), FakeTime(0))) == []
    assert list(wait.handleExpiredTimer((1,), FakeTime(1001), FakeTime(501))) == []
    got = list(wait.handleExpiredTimer((1,), FakeTime(1002), FakeTime(1001)))
    assert [(r["k"], r["__action"]) for r in got] == [(i, None if i % 2 else "block") for i in range(3000)]
    assert handle.calls < 30 and not any(handle.lists.values())

    handle = FakeHandle()
    order = SF.ReorderProcessor(["step", "__slice", "__at", "id", "status"], 3, 600_000)
    order.init(handle)
    events = [("a", 0, None, i, i, "xy"[i // 1500]) for i in reversed(range(3000))]
    assert list(order.handleInputRows(("a", 0), iter(events), FakeTime(0))) == []
    got = list(order.handleExpiredTimer(("a", 0), FakeTime(600_001), FakeTime(599_999)))
    assert [(r["id"], r["status"], r["previous_status"], r["__first"]) for r in got] == [(0, "x", None, True), (1500, "y", "x", False)]
    assert handle.calls < 30 and not any(handle.lists.values())
