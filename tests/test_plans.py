"""Requests as a plan, stages that go on where a run stopped, and models that change under a stream."""

import json

import pytest
from pyspark.sql import functions as F

from textwarden.operators import registry as RG
from textwarden.plans import hooks as H
from textwarden.plans import training as TR
from textwarden.plans.stages import Stages, table_fingerprint
from textwarden.session import fresh_path
from textwarden.sources import sinks
from textwarden.sources.files import read_event_stream, read_registry
from textwarden.streaming import streams as S
from textwarden.streaming.swap import CurrentModel, score_by_current

QUICK = TR.Settings(max_features=50, max_iter=5, folds=2)


def by_length(rows):
    """A score that some texts do not get."""
    return rows.withColumn("score", F.when(F.col("text") != "none", F.length("text") / 10.0))


def test_answers_keep_the_order_of_the_texts(spark):
    texts = ["a" * (n % 7 + 1) for n in range(300)]
    rows = [
        (1, json.dumps(texts), "application/json", "application/json"),
        (2, "\n".join(["aaa", "  ", "", " a ", "none", "aa"]), "text/csv", "text/csv"),
        (3, '{"text": "aaaa"}', "application/json", "application/json"),
        (4, '["aa", null, "none", ""]', "application/json", "application/json"),
        (5, "", "text/csv", "application/json"),
        (6, " \n ", "text/csv", "text/csv"),
        (7, "none", "text/plain", None),
        (8, None, "text/csv", "text/csv"),
        (9, " x y ", None, "text/csv"),
    ]
    requests = spark.createDataFrame(rows, "request_id INT, body STRING, content_type STRING, accept STRING").repartition(4)
    got = {r["request_id"]: (r["n_texts"], r["body"]) for r in H.answer_requests(requests, by_length).collect()}
    assert got == {
        1: (300, "[" + ", ".join(str(len(t) / 10) for t in texts) + "]"),
        2: (4, "0.3,0.1,,0.2"),
        3: (1, "0.4"),
        4: (4, "[0.2, null, null, 0.0]"),
        5: (0, "[]"),
        6: (0, ""),
        7: (1, "null"),
        8: (0, ""),
        9: (1, "0.3"),
    }


def test_bodies_may_be_bytes_and_texts_are_not_shuffled(spark):
    requests = spark.createDataFrame([(1, bytearray("é\nbb".encode()), "text/csv", "text/csv")], "id INT, raw BINARY, kind STRING, accept STRING")
    answers = H.answer_requests(requests, by_length, "id", body="raw", content_type="kind")
    assert answers.collect()[0]["body"] == "0.1,0.2"
    plan = answers._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "ObjectHashAggregate" in line or "SortAggregate" in line]
    assert exchange and not any("text" in line for line in exchange)


def test_fingerprints_follow_the_rows_not_their_order(spark):
    rows = [(i, "x" * (i % 3), {"a": str(i)}, None) for i in range(50)]
    schema = "id INT, t STRING, m MAP<STRING,STRING>, d DOUBLE"
    one = table_fingerprint(spark.createDataFrame(rows, schema))
    assert table_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(7)) == one
    for other in (rows[1:], [*rows, rows[0], rows[0]], [(0, "y", {}, None), *rows[1:]]):
        assert table_fingerprint(spark.createDataFrame(other, schema)) != one
    assert table_fingerprint(spark.createDataFrame(rows, schema.replace("id", "key"))) != one


def test_a_stopped_run_goes_on_behind_its_last_mark(spark):
    out, done = fresh_path(spark, "stages"), []

    def run(broken=None, **settings):
        stages = Stages(spark, out)

        def work(name):
            def do():
                done.append(name)
                if name == broken:
                    raise RuntimeError(name)

            return do

        stages.run("one", work("one"), a=settings.get("a", 1))
        stages.run("two", work("two"), after=("one",), b=settings.get("b", 1))
        stages.run("three", work("three"), after=("two",))
        return stages.ran

    with pytest.raises(RuntimeError):
        run(broken="two")
    assert done == ["one", "two"]
    assert run() == ["two", "three"] and run() == []
    assert run(b=2) == ["two", "three"] and run(b=2) == []
    assert run(a=2, b=2) == ["one", "two", "three"]
    with pytest.raises(RuntimeError):
        run(broken="one", a=3, b=2)
    assert run(a=2, b=2) == ["one"]  # its mark went when it failed; what follows was done on the same


def labelled(spark, n, marks=("good", "bad")):
    rows = [(i, f"{marks[i % 2]} word{i % 11} text{i % 5}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id LONG, comment_text STRING, toxic INT")


def test_training_goes_on_without_fitting(spark, monkeypatch):
    out, fits = fresh_path(spark, "training"), []
    train, test = labelled(spark, 120), labelled(spark, 60)
    fit, evaluate = TR.train_classifier, TR.evaluate_model

    def counted(*args, **more):
        fits.append(1)
        return fit(*args, **more)

    def stop(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(TR, "train_classifier", counted)
    monkeypatch.setattr(TR, "evaluate_model", stop)
    with pytest.raises(KeyboardInterrupt):
        TR.run_training(spark, train, test, out, settings=QUICK, min_rows=10)
    monkeypatch.setattr(TR, "evaluate_model", evaluate)
    assert len(fits) == 1 and read_registry(spark, f"{out}/registry").isEmpty()
    gate = TR.run_training(spark, train.repartition(3), test, out, settings=QUICK, min_rows=10).first()
    assert len(fits) == 1 and gate["accuracy"] == 1.0
    # the mark of the last stage is lost, its row is there: it is not appended twice
    sinks.remove(spark, f"{out}/_stages/register")
    TR.run_training(spark, train, test, out, settings=QUICK, min_rows=10)
    assert read_registry(spark, f"{out}/registry").count() == 1
    TR.run_training(spark, train, test, out, settings=TR.Settings(max_features=50, max_iter=6, folds=2), min_rows=10)
    assert len(fits) == 2 and read_registry(spark, f"{out}/registry").count() == 2


def test_each_batch_is_scored_by_the_model_approved_then(spark):
    registry, source, out, state = (fresh_path(spark, f"swap-{n}") for n in ("registry", "source", "out", "state"))
    loads, models = [], {}
    schema = "doc_id LONG, text STRING"

    def approve(name, marks, hour):
        models[name] = TR.fit_all(labelled(spark, 60, marks), settings=QUICK)
        path = fresh_path(spark, name)
        sinks.save_model(models[name], path)
        at = F.lit(f"2024-01-01 {hour:02}:00:00").cast("timestamp_ntz")
        row = RG.register_model(spark.range(1), F.lit(name), at, F.create_map(F.lit("model_path"), F.lit(path)))
        sinks.append_registry(row.drop("key"), registry)
        sinks.append_registry(RG.approve_latest(read_registry(spark, registry), at + F.expr("INTERVAL 1 MINUTE")), registry)

    def go(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        S.finish(score_by_current(read_event_stream(spark, source, schema), registry, out, state))
        return {r["doc_id"]: r for r in spark.read.parquet(out).collect()}

    got = go((0, "good"), (1, None))
    assert [(r["model"], r["score"], r["error"]) for r in got.values()] == [(None, None, "no approved model")] * 2
    approve("first", ("good", "bad"), 1)
    got = go((2, "bad"), (3, None))
    assert got[2]["model"] == "first" and got[2]["score"] > 0.5 and got[3]["error"] == "no text"
    approve("second", ("bad", "good"), 2)
    got = go((4, "bad"))
    assert got[4]["model"] == "second" and got[4]["score"] < 0.5 and got[2]["model"] == "first"
    assert len(got) == 5

    current = CurrentModel(registry, lambda path: loads.append(path) or sinks.load_model(path))
    for _ in range(3):
        assert current.refresh(spark) == "second"
    assert len(loads) == 1
