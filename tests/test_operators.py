"""Set operators against plain Python over small, skewed tables with NULL groups."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from textwarden.operators import alarms as A
from textwarden.operators import plugins as PL
from textwarden.operators import decisions as D
from textwarden.operators import evaluate as E
from textwarden.operators import metrics as M
from textwarden.operators import ordering as O
from textwarden.operators import quality as Q
from textwarden.operators import registry as R
from textwarden.operators import reports as RP
from textwarden.operators import splits as X
from textwarden.operators import status as ST
from textwarden.operators import terms as TM
from textwarden.session import fresh_path

START = dt.datetime(2024, 1, 1)


def digest(key, seed=42):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    """Two thirds of the rows in one class, and a class of NULLs."""
    r = random.Random(5)
    rows = [(i, r.choice([0, 0, 0, 0, 1, None])) for i in range(700)]
    return rows, spark.createDataFrame(rows, "id INT, label INT")


def ranked(rows):
    out = {}
    for label in {lab for _, lab in rows}:
        ids = sorted((i for i, lab in rows if lab == label), key=lambda i: (digest(i), i))
        out.update({i: (n + 1, len(ids)) for n, i in enumerate(ids)})
    return out


def test_hash_rank(labelled):
    rows, df = labelled
    got = {r["id"]: (r["rank"], r["total"]) for r in O.hash_rank(df, ["label"], "id", digits=1).collect()}
    assert got == ranked(rows)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_stratified_split(labelled, share):
    rows, df = labelled
    want = {i: "test" if r <= int(share * n + 0.5) else "train" for i, (r, n) in ranked(rows).items()}
    got = X.stratified_split(df, "label", "id", share).collect()
    assert {r["id"]: r["split"] for r in got} == want


def test_tiny_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id INT, label STRING")
    got = X.stratified_split(df, "label", "id", 0.2).collect()
    assert {r["split"] for r in got} == {"train"}
    assert X.stratified_folds(df, "label", "id", 5).count() == 3


def test_folds_are_even(labelled):
    rows, df = labelled
    got = X.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1, None):
        sizes = [r["count"] for r in got if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_numbered(spark):
    r = random.Random(9)
    values = [(i, r.choice([1, 1, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(values, "id INT, v INT").repartition(7)
    got = {x["id"]: x["n"] for x in O.numbered(df, [F.desc("v"), "id"]).collect()}
    order = sorted(values, key=lambda x: (-x[1], x[0]))
    assert got == {i: n + 1 for n, (i, _) in enumerate(order)}


def test_running_sums(spark):
    rows = [("a", float(i), i % 7) for i in range(300)] + [(None, float(i), 1) for i in range(50)]
    df = spark.createDataFrame(rows, "g STRING, s DOUBLE, v INT")
    got = {(x["g"], x["s"]): x["before_v"] for x in O.running_sums(df, ["g"], "s", ["v"]).collect()}
    for g in ("a", None):
        total = 0
        for _, s, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, s] == total
            total += v


def test_previous_over_pieces(spark):
    r = random.Random(2)
    rows, t = [], START
    for i in range(400):
        t += dt.timedelta(minutes=r.choice([0, 1, 30, 300]))
        rows.append((i, r.choice(["a", "a", "a", None]), t, r.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "id INT, k STRING, ts TIMESTAMP_NTZ, v STRING")
    got = {x["id"]: (x["has_previous"], x["previous"]) for x in O.with_previous(df, ["k"], ["ts", "id"], "v").collect()}
    last = {}
    for i, k, _, v in sorted(rows, key=lambda x: (x[2], x[0])):
        assert got[i] == ((True, last[k]) if k in last else (False, None))
        last[k] = v


def test_status_changes_and_final(spark):
    steps = ["Executing", "Executing", "Failed", None, None, "Succeeded"]
    rows = [("s", st, f"why {i}", START + dt.timedelta(hours=i), i) for i, st in enumerate(steps)]
    rows += [("t", "Failed", "bad", START, 10)]
    df = spark.createDataFrame(rows, "step STRING, status STRING, failure_reason STRING, ts TIMESTAMP_NTZ, event_id INT")
    assert sorted(r["event_id"] for r in ST.status_changes(df).collect()) == [0, 2, 3, 5, 10]
    final = {r["step"]: (r["status"], r["failure_reason"], r["terminal"]) for r in ST.final_status(df).collect()}
    assert final == {"s": ("Succeeded", None, True), "t": ("Failed", "bad", True)}


def test_alarm_gap_resets(spark):
    # breaches in windows 0 and 1, a gap, then 3, 4 and 5
    rows = [(START + dt.timedelta(minutes=5 * w + 1), "m", 20.0) for w in (0, 1, 3, 4, 5)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP_NTZ, name STRING, value DOUBLE")
    alarm = [("A", "m", "Sum", ">", 10.0, 3, 300)]
    got = A.evaluate_alarms(df, alarm).orderBy("slot").collect()
    assert [r["breach"] for r in got] == [True, True, False, True, True, True]
    assert [r["in_alarm"] for r in got] == [False] * 5 + [True]
    changes = A.alarm_changes(A.evaluate_alarms(df, alarm)).collect()
    assert [(r["alarm"], r["state"]) for r in changes] == [("A", "ALARM")]


def test_default_alarms_of_decisions(spark):
    def on(confidence, action, minutes, environment="Production"):
        rows = [(i, START + dt.timedelta(minutes=i), action, confidence, 3000.0, False, False, 0.0) for i in range(minutes)]
        cols = "doc_id INT, ts TIMESTAMP, action STRING, confidence STRING, latency_ms DOUBLE, routed BOOLEAN, enhanced BOOLEAN, reviewer_latency_ms DOUBLE"
        decisions = spark.createDataFrame(rows, cols)
        points = M.alarm_feed(decisions, decisions.select("doc_id", F.lit(0).alias("label")))
        points = points.withColumn("dims", F.create_map(F.lit("Environment"), F.lit(environment)))
        return {r[0] for r in A.evaluate_alarms(points).filter("in_alarm").select("alarm").distinct().collect()}

    assert on("high", "allow", 60) == {"HighLatency"}
    assert on("medium", "review", 90) == {"HighLatency", "LowConfidence", "HighFalsePositiveRate"}
    # the default alarms watch production only
    assert on("medium", "review", 90, "Test") == set()


def test_points_of_failed_requests(spark):
    rows = [(START, 1.0, "model", True, True, 7.0), (START, 2.0, "input", False, False, None), (START, 3.0, None, True, False, None)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, latency_ms DOUBLE, failure STRING, routed BOOLEAN, enhanced BOOLEAN, reviewer_latency_ms DOUBLE")
    df = df.withColumns({"score": F.lit(0.5), "action": F.lit("review"), "confidence": F.lit("high")})
    got = {r["name"]: (r["points"], r["total"]) for r in M.metric_totals(M.request_metrics(df)).collect()}
    assert got["ModelError"] == got["PredictionError"] == got["ModerationDecision"] == (1, 1.0)
    assert got["SecondOpinionLatency"] == (1, 7.0) and got["SecondOpinionError"] == (1, 1.0)


def test_auc_with_ties_and_hot_score(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 1), r.choice([0.5] * 5 + [0.1, 0.2, 0.9])) for _ in range(600)]
    df = spark.createDataFrame(rows, "label INT, score DOUBLE")
    pos = [s for lab, s in rows if lab == 1]
    neg = [s for lab, s in rows if lab == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df).first()[0] == pytest.approx(want)


def test_report_with_unseen_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "label INT, pred INT")
    rep = {r["class"]: r for r in E.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0 and rep["1"]["f1"] == 0
    assert rep["0"]["precision"] == pytest.approx(1 / 3)
    assert [tuple(r) for r in E.confusion_matrix(df).orderBy("actual").collect()] == [(0, 1, 0, 0), (1, 2, 0, 0)]
    b = E.binary_metrics(df).first()
    assert (b["tp"], b["fp"], b["fn"], b["tn"], b["f1"]) == (0, 0, 2, 1, 0)


def test_unscored_rows_are_counted(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (0, 1, 0.8), (1, None, None)], "label INT, pred INT, score DOUBLE")
    b = E.binary_metrics(df, score="score").first()
    assert (b["n"], b["unscored"], b["tp"], b["fp"], b["fn"], b["tn"]) == (4, 1, 1, 1, 0, 1)
    assert b["accuracy"] == pytest.approx(2 / 3) and b["roc_auc"] == 1.0
    assert [tuple(r) for r in E.confusion_matrix(df).orderBy("actual").collect()] == [(0, 1, 1, 0), (1, 0, 1, 1)]
    assert tuple(E.accuracy(df).first())[:3] == (4, 1, 2)
    assert {r["class"] for r in E.classification_report(df).collect()} == {"0", "1", "macro avg", "weighted avg"}


def test_split_of_many_classes(spark):
    df = spark.range(3000).selectExpr("id", "IF(id < 30, NULL, id % 300) AS c")
    split = X.stratified_split(df, "c", "id", 0.5)
    assert split.count() == 3000
    sizes = split.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert len(sizes) == 301 and all(abs(r["t"] - r["n"] / 2) <= 0.5 for r in sizes)
    folds = X.stratified_folds(df.filter("c IS NULL"), "c", "id", 7).groupBy("fold").count().collect()
    assert len(folds) == 7 and {r["count"] for r in folds} <= {4, 5}


def test_rows_without_time_are_kept(spark):
    rows = [("s", "a", None, 1), ("s", "b", START, 2), ("s", "b", START, 3), (None, "x", None, 4)]
    df = spark.createDataFrame(rows, "step STRING, status STRING, ts TIMESTAMP_NTZ, event_id INT")
    got = {r["event_id"]: r["previous_status"] for r in ST.status_changes(df).collect()}
    assert got == {1: None, 2: "a", 4: None}


def test_two_answers_one_decision(spark):
    scored = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.4)], "doc_id INT, score DOUBLE")
    answers = spark.createDataFrame([(1, "allow", 1), (1, "block", 2), (3, None, 1)], "doc_id INT, action STRING, ts INT")
    got = {r["doc_id"]: (r["action"], r["enhanced"], r["fallback_used"]) for r in D.route_workflow(scored, answers).collect()}
    assert got == {1: ("block", True, False), 2: ("block", False, False), 3: ("review", False, True)}


def test_log_keeps_time_and_mark(spark):
    df = spark.createDataFrame([(1, START, True), (2, None, None)], "doc_id INT, ts TIMESTAMP_NTZ, enhanced BOOLEAN")
    got = {r["doc_id"]: r for r in D.decision_log(df, columns=["doc_id"]).collect()}
    assert got[1]["ts"] == START and got[1]["day"] == START.date() and got[1]["enhanced"] is True
    assert got[2]["ts"] is not None and got[2]["enhanced"] is False


def test_missing_columns_are_reported(spark):
    df = spark.createDataFrame([(1,)], "toxic INT")
    r = Q.validation_report({"train": df, "test": df}).first()
    assert r["validation_passed"] is False and "comment_text" in r["issues"][0]
    assert r["train_samples"] is None


def test_failing_batches_are_halved(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def score(texts):
            seen.add(1)
            if (texts == "bad").any():
                raise ValueError("bad text")
            return texts.str.len().astype(float)

        return score

    df = spark.createDataFrame([(i, "bad" if i == 77 else "good") for i in range(256)], "id INT, text STRING").coalesce(1)
    got = {r["id"]: (r["score"], r["error"]) for r in PL.score_partitions(df, load).collect()}
    assert len(got) == 256 and got[77] == (None, "bad text") and got[76] == (4.0, None)
    assert seen.value <= 2 * 9


def test_reviewers_in_order(spark):
    def first():
        return lambda p: [None if x.startswith("b") else "one" for x in p]

    def second():
        def review(p):
            if (p == "bb").any():
                raise ValueError("no")
            return ["two"] * len(p)

        return review

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "bb")], "doc_id INT, prompt STRING")
    got = {r["doc_id"]: (r["raw"], r["error"], r["reviewer"]) for r in PL.ask_reviewer(df, [first, second]).collect()}
    assert got == {1: ("one", None, 0), 2: ("two", None, 1), 3: (None, "no", None)}


def test_gate_limits(spark):
    df = spark.createDataFrame([(0.8,), (0.81,), (0.85,), (0.86,)], "accuracy DOUBLE")
    got = [tuple(r)[1:] for r in E.evaluation_gate(df).orderBy("accuracy").collect()]
    assert got == [
        (False, "medium", "reject"), (True, "medium", "approve"),
        (True, "medium", "approve"), (True, "high", "approve"),
    ]


def test_validation_issues(spark):
    rows = [("text", 1)] * 98 + [(None, 1)]
    df = spark.createDataFrame(rows, "comment_text STRING, toxic INT")
    r = Q.validation_report({"train": df, "test": df}).first()
    assert not r["validation_passed"]
    assert list(r["issues"]) == [
        "Missing values: train=1, test=1", "Training data too small: 99 samples",
        "Imbalanced dataset: toxic ratio = 1.000",
    ]
    assert r["train_final_samples"] == 98


def test_clean_labelled_drops_null_before_anything(spark):
    df = spark.createDataFrame([(" a ", 1), (None, 1), ("b", None), ("  ", 0)], "comment_text STRING, toxic INT")
    assert [tuple(r) for r in Q.clean_labelled(df).collect()] == [("a", 1)]


def test_terms_by_brute_force(spark):
    texts = {1: "cat dog cat", 2: "dog", 3: "", 4: "the a of", 5: None}
    df = spark.createDataFrame(list(texts.items()), "id INT, t STRING")
    got = {(r["id"], r["term"]): r["tf"] for r in TM.doc_terms(df, "id", "t").collect()}
    assert got == {
        (1, "cat"): 2, (1, "dog"): 1, (1, "cat dog"): 1, (1, "dog cat"): 1, (2, "dog"): 1,
        (3, None): None, (4, None): None, (5, None): None,
    }
    coef = spark.createDataFrame([("dog", 1.0, 2.0)], "term STRING, idf DOUBLE, weight DOUBLE")
    scores = {r["id"]: r["score"] for r in TM.score_linear(TM.doc_terms(df, "id", "t"), "id", coef).collect()}
    assert scores[2] == pytest.approx(1 / (1 + 2.718281828459045**-2))
    assert scores[3] == scores[4] == scores[5] == 0.5


ODD_TEXTS = [(1, "b", "cat dog cat"), (1, "b", "cat dog cat"), (1, None, "dog"), (None, "a", "É dog_1 dog_1\n x\ndog"),
             (None, "a", None), (3, "a", ""), (4, "a", "the a of"), (5, "a", "cat the cat")]


def test_terms_by_key_are_the_same_rows(spark):
    df = spark.createDataFrame(ODD_TEXTS, "id INT, k STRING, t STRING")
    plain = TM.doc_terms(df, "id", "t", keep=["k"])
    by_key = TM.doc_terms(df, "id", "t", keep=["k"], by_key=True)
    assert by_key.schema == plain.schema
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(by_key) == rows(plain) and len(rows(plain)) == 4 + 4 + 1 + 4 + 1 + 1 + 1 + 2


def test_tfidf_cuts_the_texts_once(spark):
    from catalog.terms import tfidf

    folder = fresh_path(spark, "cut-once")
    df = spark.createDataFrame(ODD_TEXTS, "doc_id INT, k STRING, text STRING")
    df.write.parquet(f"{folder}/documents.parquet")
    got = tfidf(spark, folder)
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("regexp_extract_all") == 1 and "ReusedExchange" in final
    raw = {}
    n, df_of = len(ODD_TEXTS), {"cat": 3, "dog": 4, "cat dog": 2, "dog cat": 2, "cat cat": 1, "dog_1": 1}
    idf = lambda t: math.log((n + 1) / (df_of.get(t, 1) + 1)) + 1
    for r in rows:
        raw.setdefault(r["doc_id"], []).append((r["term"], r["tf"], r["tf"] * idf(r["term"]), r["weight"]))
    assert {k: sorted((t, f) for t, f, _, _ in v) for k, v in raw.items()} == {
        1: sorted([("cat", 2), ("dog", 1), ("cat dog", 1), ("dog cat", 1)] * 2 + [("dog", 1)]),
        None: sorted([("dog_1", 2), ("dog", 1), ("dog_1 dog_1", 1), ("dog_1 dog", 1)]),
        5: [("cat", 2), ("cat cat", 1)],
    }
    for v in raw.values():
        norm = math.sqrt(sum(x * x for _, _, x, _ in v))
        assert all(w == pytest.approx(x / norm, abs=1e-6) for _, _, x, w in v)


def test_pass_rates(spark):
    rows = [("core_checks", "t1", "passed", None), ("core_checks", "t2", "failed", "x" * 200)]
    df = spark.createDataFrame(rows, "category STRING, test STRING, status STRING, error STRING")
    rep = {r["category"]: (r["title"], r["rate"], r["status"]) for r in RP.pass_rate_report(df).collect()}
    assert rep == {"core_checks": ("Core Checks", 50.0, "warn"), "overall": ("Overall", 50.0, "bad")}
    assert RP.top_failures(df).first()["error"] == "x" * 100 + "..."


def test_registry_flow(spark):
    rows = [("m1", START), ("m2", START + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "name STRING, at TIMESTAMP_NTZ")
    payload = F.create_map(F.lit("a"), F.lit("1"))
    reg = R.register_model(df, "name", "at", payload).drop("key")
    later = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    reg = reg.unionByName(R.approve_latest(reg, later))
    got = [(r["name"], r["status"]) for r in R.list_models(reg).collect()]
    assert got == [("m2", "Approved"), ("m1", "PendingManualApproval")]
    assert R.latest_pending(reg).first()["name"] == "m1"


def test_latest_model_priority(spark):
    rows = [("standalone", "new", START + dt.timedelta(days=9)), ("pipeline", "old", START)]
    reg = spark.createDataFrame(rows, "kind STRING, name STRING, ts TIMESTAMP_NTZ")
    assert R.latest_model(reg).first()["name"] == "old"


def test_retention(spark):
    rows = [("alerts", START), ("alerts", START + dt.timedelta(days=6)), ("other", START), (None, START)]
    df = spark.createDataFrame(rows, "stream STRING, ts TIMESTAMP_NTZ")
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    assert M.apply_retention(df, as_of, {"alerts": 7}).count() == 3


def test_sampling_is_whole(spark):
    rows = [(i, f"Text {i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id INT, t STRING, label INT")
    out = X.sample_variants(df, "id", "t", "label", n_per_class=100).collect()
    assert len(out) == 200 and sum(r["label"] for r in out) == 100
    assert {(r["label"], r["draw_id"]) for r in out} == {(c, i) for c in (0, 1) for i in range(100)}
    for r in out:
        plain = f"Text {r['id']}"
        forms = (
            {plain.upper(), plain + "!!!", "Really, " + plain.lower()}
            if r["label"] == 1
            else {"Please, " + plain.lower(), plain + " Please.", "I think " + plain.lower()}
        )
        assert r["t"] in (forms if r["varied"] else {plain})


def test_a_large_class_is_not_brought_into_one_task(spark):
    """Nineteen rows of twenty are of one class: folds and splits leave the rows where they are."""
    df = spark.range(0, 2000, numPartitions=4).select(F.col("id"), (F.col("id") % 20 == 0).cast("int").alias("label"))
    for placed in (X.stratified_folds(df, "label", "id", 5), X.stratified_split(df, "label", "id", 0.2)):
        tasks = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) == 4 and max(tasks) == 500


def test_a_scorer_gets_a_few_texts_at_a_time(spark):
    """Its memory follows the texts of a call, not those of Spark's batch; NULL and NaN scores are missing."""
    def load():
        def score(texts):
            if len(texts) > 500:
                raise MemoryError("too many texts at a time")
            # a larger call would be halved, and no longer have the size of a piece
            return [float("nan") if t == "x7" else None if t is None else float(len(texts)) for t in texts]

        return score

    df = spark.range(0, 1600, numPartitions=1).select(
        "id", F.when(F.col("id") != 9, F.concat(F.lit("x"), F.col("id"))).alias("text"), F.timestamp_seconds("id").alias("at")
    )
    got = {r["id"]: r for r in PL.score_partitions(df, load).collect()}
    assert len(got) == 1600 and got[3]["at"] == df.filter("id = 3").first()["at"]
    assert got[7]["score"] is None and got[9]["score"] is None and got[9]["error"] == "no result"
    assert got[0]["score"] == 500.0 and got[1599]["score"] == 100.0 and got[0]["error"] is None
