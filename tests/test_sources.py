"""Readers and writers, and scorers from outside."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textwarden import session
from textwarden.operators import decisions as D
from textwarden.operators import plugins as PL
from textwarden.session import fresh_path, shared_dir
from textwarden.sources import files, folders, sinks
from textwarden.streaming.streams import run_available


def test_csv_keeps_texts(spark):
    rows = [('a, "quoted" text', 1), ("two\nlines", 0), ("  blanks  ", 1), ("back\\slash", 0), ("plain", None)]
    path = fresh_path(spark, "csv")
    sinks.write_table(spark.createDataFrame(rows, "comment_text STRING, toxic INT"), path, fmt="csv")
    got = files.read_labelled_csv(spark, path, multi_line=True).cache()
    assert {(r[0], r[1]) for r in got.collect()} == set(rows)
    assert got.filter("_corrupt_record IS NOT NULL").count() == 0


def test_csv_marks_broken_rows(spark):
    path = fresh_path(spark, "broken")
    lines = spark.createDataFrame([("comment_text,toxic",), ("fine,1",), ("odd,many",)], "value STRING")
    lines.coalesce(1).write.text(path)
    got = files.read_labelled_csv(spark, path, multi_line=True).cache()
    assert [r["comment_text"] for r in got.filter("_corrupt_record IS NULL").collect()] == ["fine"]
    assert got.filter("_corrupt_record IS NOT NULL").count() == 1


def test_text_lines(spark):
    path = fresh_path(spark, "txt")
    spark.createDataFrame([(" a ",), ("",), ("   ",), ("b",)], "value STRING").coalesce(1).write.text(path)
    got = files.read_text_lines(spark, path).orderBy("path", "line_id").collect()
    assert [r["text"] for r in got] == ["a", "b"]


def test_missing_report_gives_no_row(spark):
    assert files.read_json_report(spark, fresh_path(spark, "none"), "a INT").count() == 0


def test_pretty_report(spark):
    path = fresh_path(spark, "pretty")
    spark.createDataFrame([('{\n  "a": 1\n}',)], "value STRING").coalesce(1).write.text(path)
    assert files.read_json_report(spark, path, "a INT", pretty=True).first()["a"] == 1


def test_report_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a INT, b STRING")
    assert sinks.report_json(df).first()["json"] == '{"a":1,"b":null}'


def test_listing_and_first_existing(spark):
    root = fresh_path(spark, "files")
    for name in ("model/one", "logs/two"):
        spark.createDataFrame([("x",)], "value STRING").coalesce(1).write.text(f"{root}/{name}")
    listing = files.list_artifacts(spark, root)
    assert listing.filter("size > 0").count() == 2
    assert files.list_artifacts(spark, root, "model/").count() == 1
    folders = listing.select(F.substring_index("key", "/", 2).alias("key"))
    wanted = spark.createDataFrame(
        [("m", 1, "model/none"), ("m", 2, "model/one"), ("m", 3, "logs/two")], "name STRING, priority INT, key STRING"
    )
    assert files.first_existing(folders, wanted).first()["key"] == "model/one"


def test_partitioned_write_prunes(spark):
    path = fresh_path(spark, "parts")
    df = spark.range(1000).withColumn("day", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold"))
    sinks.write_table(df, path, ["day"])
    cold = spark.read.parquet(path).filter("day = 'cold'")
    assert cold.count() == 334
    assert all("day=cold" in f for f in [r[0] for r in cold.select(F.input_file_name()).distinct().collect()])


def test_registry_append(spark):
    path = fresh_path(spark, "reg")
    df = spark.createDataFrame([("package", "a"), ("endpoint", "b")], "kind STRING, name STRING")
    sinks.append_registry(df, path)
    sinks.append_registry(df, path)
    assert spark.read.parquet(path).count() == 4


class _Session:
    """The parts of a cluster session that name the shared folder."""

    def __init__(self, named):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self

    master = "spark://head:7077"

    def getCheckpointDir(self):
        return None


def test_shared_dir_is_the_one_the_cluster_names():
    assert shared_dir(_Session("/shared/folder")) == "/shared/folder"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session(None))


def _scorer():
    def score(texts):
        if (texts == "boom").any():
            raise ValueError("no")
        return [len(t) / 10 for t in texts]

    return score


def test_scorer_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "")], "id INT, text STRING").coalesce(1)
    got = {r["id"]: (r["score"], r["error"]) for r in PL.score_partitions(df, _scorer).collect()}
    assert got == {1: (0.3, None), 2: (None, "no"), 3: (0.0, None)}


def test_result_lines(spark):
    df = spark.createDataFrame([("hello", 0.9), ("x" * 120, 0.4), ("t", None)], "text STRING, score DOUBLE")
    got = [r[0] for r in df.select(D.format_result_line()).collect()]
    assert got[0] == 'TOXIC (90.0%) - HIGH confidence\n   Text: "hello"'
    assert got[1].startswith("SAFE (40.0%) - MEDIUM") and got[1].endswith('...\"')
    assert got[2].startswith("Error")


def test_log_defaults(spark):
    df = spark.createDataFrame([("t" * 150, None)], "text STRING, action STRING")
    r = D.decision_log(df).first()
    assert (r["execution_id"], len(r["text_preview"]), r["ml_score"], r["action"], r["enhanced"]) == (
        "unknown", 100, 0.0, "unknown", False,
    )


def test_unknown_modes():
    with pytest.raises(ValueError):
        from textwarden.functions.text import preview

        preview("t", 3, "sometimes")


def folder_rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).selectExpr("id", "CAST(day AS STRING)").collect())


def test_a_second_day_leaves_the_first(spark):
    path = fresh_path(spark, "days")
    day = lambda ids, d: spark.createDataFrame([(i, d) for i in ids], "id INT, day STRING")
    sinks.write_table(day([1, 2], "2024-01-01"), path, ["day"])
    sinks.write_table(day([3], "2024-01-02"), path, ["day"])
    sinks.write_table(day([4], "2024-01-02"), path, ["day"])
    assert folder_rows(spark, path) == [(1, "2024-01-01"), (2, "2024-01-01"), (4, "2024-01-02")]
    sinks.write_table(day([5], "2024-01-03"), path, ["day"], whole=True)
    assert folder_rows(spark, path) == [(5, "2024-01-03")]


def test_a_run_replaces_what_it_wrote_and_nothing_else(spark):
    path = fresh_path(spark, "runs")
    rows = lambda *ids: spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}") for i in ids], "id INT, day STRING")
    got = lambda: {(r["id"], r["run"]) for r in spark.read.parquet(path).collect()}
    sinks.write_run(rows(0, 1, 2), path, "a")
    sinks.write_run(rows(3, 4, 5), path, "b/ü=1")
    assert got() == {(i, "a") for i in range(3)} | {(i, "b/ü=1") for i in (3, 4, 5)}
    for _ in range(2):
        folders = sinks.write_run(rows(3, 4, 5), path, "b/ü=1")
    assert folders.count() == 3
    folders = sinks.write_run(rows(0, 3), path, "a")  # the other two days have no row of it any more
    assert got() == {(0, "a"), (3, "a")} | {(i, "b/ü=1") for i in (3, 4, 5)}
    assert folders.count() == 1 and folders.first()["bytes"] > 0
    sinks.write_run(rows(), path, "a")
    assert got() == {(i, "b/ü=1") for i in (3, 4, 5)}


def test_expired_days_go_as_folders(spark):
    path, as_of = fresh_path(spark, "retention"), dt.date(2024, 5, 1)
    days = [as_of - dt.timedelta(days=n) for n in (0, 6, 7, 8, 29, 30, 31, 89, 90, 91, 400)]
    streams = ["prediction", "model-performance", "alerts", "unknown"]
    rows = [(s, d) for s in streams for d in days] + [("alerts", None), (None, as_of - dt.timedelta(days=900))]
    log = spark.createDataFrame(rows, "stream STRING, day DATE")
    sinks.write_table(log.withColumn("x", F.lit(1)), path, ["stream", "day"])
    gone = sinks.drop_expired(spark, path, as_of)
    keep = {"prediction": 30, "model-performance": 90, "alerts": 7}
    want = {(s, d) for s, d in rows if s in keep and d and d < as_of - dt.timedelta(days=keep[s])}
    assert {(r["stream"], r["day"]) for r in gone.collect()} == want and len(want) == 2 + 5 + 8
    assert all(r["files"] == 1 and r["bytes"] > 0 for r in gone.collect())
    left = spark.read.schema("x INT, stream STRING, day DATE").parquet(path).collect()
    assert {(r["stream"], r["day"]) for r in left} == set(rows) - want
    assert sinks.drop_expired(spark, path, as_of).count() == 0
    assert sinks.drop_expired(spark, fresh_path(spark, "no-log"), as_of).count() == 0


def test_tables_as_streams_are_files_or_folders(spark):
    folder = fresh_path(spark, "tables")
    rows = spark.range(10)
    rows.repartition(3).write.parquet(f"{folder}/many.parquet")
    rows.coalesce(1).write.parquet(f"{folder}/aside")
    (part,) = folders.files_in(spark, f"{folder}/aside")
    fs, place = folders._system(spark, part)
    fs.rename(place, folders._system(spark, f"{folder}/one.parquet")[1])
    for name in ("one", "many"):
        got = run_available(files.read_table_stream(spark, folder, name, "id LONG"), name)
        assert sorted(r["id"] for r in got.collect()) == list(range(10))


def test_what_was_written_on_the_way_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    paths = [fresh_path(spark, "a"), fresh_path(spark, "b"), fresh_path(spark, "never-written")]
    for path in paths[:2]:
        spark.range(3).write.parquet(path)
    assert session.release(spark) == 3 and session.release(spark) == 0
    assert not any(folders.is_folder(spark, p) for p in paths)
