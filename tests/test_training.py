"""Training on texts whose classes differ by their words."""

import random

import pytest
from pyspark.sql import functions as F

from textwarden.operators import terms as TM
from textwarden.plans import moderation as MO
from textwarden.plans import training as TR
from textwarden.session import fresh_path
from textwarden.sources import sinks
from textwarden.sources.files import read_event_stream
from textwarden.streaming import streams as S

SMALL = TR.Settings(max_features=60, max_iter=30, folds=3)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    bad, good = ["awful", "nasty", "rotten"], ["lovely", "gentle", "bright"]
    plain = ["table", "river", "green", "paper", "stone"]
    data = []
    for i in range(240):
        toxic = i % 3 == 0
        words = [r.choice(plain) for _ in range(4)] + [r.choice(bad if toxic else good)]
        r.shuffle(words)
        data.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(data, "doc_id INT, comment_text STRING, toxic INT")


@pytest.fixture(scope="module")
def trained(rows):
    return TR.train_classifier(rows, settings=SMALL)


def test_folds_are_learnt(trained):
    folds = trained[1].collect()
    assert len(folds) == 3 and sum(f["n"] for f in folds) == 240
    assert all(f["accuracy"] > 0.95 and f["roc_auc"] > 0.99 for f in folds)


def test_saved_model_scores_alike(spark, rows, trained):
    path = fresh_path(spark, "model")
    sinks.save_model(trained[0], path)
    cols = ["doc_id", F.round("score", 9).alias("score"), "pred"]
    mine = TR.score_texts(trained[0], rows).select(*cols)
    loaded = TR.score_texts(sinks.load_model(path), rows).select(*cols)
    assert mine.exceptAll(loaded).count() == 0


def test_null_text_is_an_error_not_a_score(spark, trained):
    df = spark.createDataFrame([(1, None), (2, "awful river")], "doc_id INT, comment_text STRING")
    got = {r["doc_id"]: r for r in TR.score_texts(trained[0], df).collect()}
    assert got[1]["score"] is None and got[1]["error"] == "no text" and got[1]["comment_text"] is None
    assert got[2]["score"] > 0.5 and got[2]["error"] is None


def test_moderation_by_model(spark, trained):
    texts = [(1, "awful rotten nasty"), (2, "lovely gentle bright"), (3, "x"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id INT, text STRING")
    scored = TR.score_texts(trained[0], MO.prepare(docs), "cleaned")
    got = {r["doc_id"]: r for r in MO.moderate(scored).collect()}
    assert got[1]["score"] > 0.5 and got[1]["action"] in ("review", "block")
    assert got[2]["action"] == "allow"
    assert (got[3]["outcome"], got[3]["action"], got[3]["final_score"]) == ("too_short", "allow", 0.0)
    assert (got[4]["outcome"], got[4]["action"]) == ("invalid_empty", None)


def test_model_on_a_stream(spark, rows, trained):
    path = fresh_path(spark, "stream")
    rows.select("doc_id", F.col("comment_text").alias("text")).write.parquet(path)
    live = read_event_stream(spark, path, "doc_id INT, text STRING")
    decided = S.moderate_stream(live, lambda df: TR.score_texts(trained[0], df, "cleaned"))
    got = S.run_available(decided.select("doc_id", "score"), "scored")
    want = TR.score_texts(trained[0], rows).select("doc_id", "score")
    assert got.join(want.withColumnRenamed("score", "s"), "doc_id").filter("abs(score - s) < 1e-9").count() == 240


def test_term_join_equals_pipeline(rows, trained):
    coefficients, intercept = TR.model_terms(trained[0])
    by_join = TM.score_linear(TM.doc_terms(rows, "doc_id", "comment_text"), "doc_id", coefficients, intercept)
    both = by_join.join(TR.score_texts(trained[0], rows).select("doc_id", F.col("score").alias("s")), "doc_id")
    assert both.count() == 240
    assert both.agg(F.max(F.abs(F.col("score") - F.col("s")))).first()[0] < 1e-9


def test_regularisation_matches_its_objective(rows, trained):
    """The weights are a minimum of sum(log loss) + |w|^2 / 2: the gradient is nearly zero."""
    import numpy as np

    settings = TR.Settings(max_features=20, max_iter=500, tol=1e-10)
    model = TR.fit_all(rows, settings=settings)
    coefficients, intercept = TR.model_terms(model)
    weights = {r["term"]: r["weight"] for r in coefficients.collect()}
    vocab = TM.tfidf(TM.doc_terms(rows, "doc_id", "comment_text"), "doc_id", coefficients)
    scores = TR.score_texts(model, rows).select("doc_id", "toxic", "score")
    grad = vocab.join(scores, "doc_id").groupBy("term").agg(
        F.sum((F.col("score") - F.col("toxic")) * F.col("weight")).alias("g")
    )
    residual = [r["g"] + weights[r["term"]] for r in grad.collect()]
    assert np.abs(residual).max() < 1e-3


def test_balanced_holdout(rows):
    settings = TR.Settings(max_features=60, max_iter=30, folds=2, min_df=2, max_df=0.95, balanced=True)
    model, folds, held = TR.train_with_holdout(rows, settings=settings)
    assert folds.count() == 2
    assert held.count() == 48
    assert held.filter("pred = toxic").count() == 48


def test_training_run_writes_everything(spark, rows):
    out = fresh_path(spark, "run")
    train, test = rows.filter("doc_id < 180"), rows.filter("doc_id >= 180")
    gate = TR.run_training(spark, train, test, out, settings=SMALL).first()
    assert gate["recommendation"] == "approve" and gate["confidence"] == "high"
    assert spark.read.json(f"{out}/metrics").count() == 5
    package = spark.read.parquet(f"{out}/registry").first()
    assert package["status"] == "PendingManualApproval"
    assert package["payload"]["model_path"] == f"{out}/model"


def test_training_stops_after_failed_validation(spark, rows):
    out = fresh_path(spark, "stopped")
    few = rows.limit(20)
    with pytest.raises(ValueError, match="validation failed"):
        TR.run_training(spark, few, few, out, settings=SMALL)
    assert spark.read.json(f"{out}/validation_report").first()["validation_passed"] is False


def test_folds_are_stored_not_cached(spark, rows, monkeypatch):
    """No table of texts is kept in the executors' memory, and what was stored is gone at the end."""
    from textwarden.sources import folders

    gone = []

    def removed(session, folder):
        gone.append(folder)
        assert {s.getPath().getName() for s in folders._inside(session, folder)} >= {"words", "stats", "vectors"}
        folders.remove(session, folder)

    monkeypatch.setattr(type(rows), "persist", lambda *a, **b: pytest.fail("a table was cached"))
    monkeypatch.setattr(type(rows), "cache", lambda *a, **b: pytest.fail("a table was cached"))
    monkeypatch.setattr(TR, "remove", removed)
    _, metrics = TR.train_classifier(rows, settings=SMALL)
    assert metrics.count() == 3 and len(gone) == 1
    assert not folders.is_folder(spark, gone[0])


def test_a_fold_is_measured_by_its_own_vocabulary(spark):
    """The counts are stored for the terms of all folds; one that a fold's training part lacks weighs nothing."""
    words = ["awful", "lovely", "river", "stone", "paper", "green", "table", "cloud"]
    data = [(i, f"{words[i * 5 % 8]} {words[i * 3 % 7]} only{i} {'rotten' if i % 3 == 0 else 'gentle'}", int(i % 3 == 0)) for i in range(60)]
    rows = spark.createDataFrame(data, "doc_id INT, comment_text STRING, toxic INT")
    settings = TR.Settings(max_features=12, max_iter=200, tol=1e-12, folds=2, c=0.05)
    _, metrics = TR.train_classifier(rows, settings=settings)
    folded = TR.X.stratified_folds(rows, "toxic", "doc_id", 2, settings.seed)
    for fold, got in {r["fold"]: r for r in metrics.collect()}.items():
        model = TR.fit_all(folded.filter(F.col("fold") != fold), settings=settings)
        scored = TR.score_texts(model, folded.filter(F.col("fold") == fold))
        want = TR.E.binary_metrics(scored, "toxic", "pred", "score").first()
        assert [got[c] for c in ("tp", "fp", "fn", "tn")] == [want[c] for c in ("tp", "fp", "fn", "tn")]
        assert abs(got["roc_auc"] - want["roc_auc"]) < 1e-9


def test_the_tasks_of_a_fit_follow_the_entries_of_its_vectors(spark, rows, monkeypatch):
    """Vectors lie in partitions of at most about PART_BYTES, in blocks that are read back some at a time."""
    seen = []
    fit = TR.LogisticRegression.fit

    def counted(self, table):
        seen.append((table.rdd.getNumPartitions(), self.getMaxBlockSizeInMB()))
        return fit(self, table)

    monkeypatch.setattr(TR.LogisticRegression, "fit", counted)
    monkeypatch.setattr(TR, "PART_BYTES", 4000)
    entries = TM.term_stats(TM.doc_terms(rows, "doc_id", "comment_text"), 240).orderBy(F.desc("tf"), "term").limit(60)
    size = entries.agg(F.sum("df")).first()[0] * TR.ENTRY_BYTES
    TR.fit_all(rows, settings=SMALL)
    assert seen == [(-(-size // 4000), TR.BLOCK_MB)] and seen[0][0] > 1


def _watched(spark, rows):
    """The same rows, and how many of them have been read."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    return spark.createDataFrame(rows.rdd.map(seen), rows.schema), read


def test_a_training_reads_its_rows_once(spark, rows):
    watched, read = _watched(spark, rows)
    TR.train_classifier(watched, settings=SMALL)
    assert read.value == 240
    TR.fit_all(watched, settings=SMALL)
    assert read.value == 480


def test_a_holdout_caches_no_texts(rows, monkeypatch):
    monkeypatch.setattr(type(rows), "persist", lambda *a, **b: pytest.fail("a table was cached"))
    settings = TR.Settings(max_features=60, max_iter=5, folds=2, min_df=2, max_df=0.95, balanced=True)
    _, _, held = TR.train_with_holdout(rows, settings=settings)
    # the split rows are stored: scoring them does not read what was given
    assert held.inputFiles() and held.count() == 48


def test_runs_read_stored_rows(spark, rows, tmp_path):
    """The checked runs join texts and labels once, not for every fingerprint and stage."""
    from catalog import model as CM

    rows.select("doc_id", F.col("comment_text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    train, test = CM._split(spark, str(tmp_path))
    assert all("/split-" in f for part in (train, test) for f in part.inputFiles())
    assert (train.count(), test.count()) == (192, 48)
    assert train.unionByName(test).exceptAll(CM.labelled(spark, str(tmp_path))).count() == 0
