"""Trained models, and the moderation plan as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog import policy as CP
from catalog import text as CT
from catalog._base import big, documents, fixture_score, query, table
from textwarden.operators import evaluate as E
from textwarden.operators import registry as RG
from textwarden.operators import reports as R
from textwarden.operators import splits as X
from textwarden.operators import terms as TM
from textwarden.plans import moderation as MO
from textwarden.plans import training as TR
from textwarden.session import fresh_path
from textwarden.sources import sinks
from textwarden.sources.files import read_event_stream, read_registry
from textwarden.streaming import streams as S
from textwarden.streaming.swap import score_by_current


def labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("comment_text"))
    return docs.join(labels, "doc_id")


_SQL_MODERATED = CP.SQL_ATTACHED.replace(
    "SELECT doc_id, lang, text, text AS c,",
    f"SELECT doc_id, lang, text, {B.sql_clean('text')} AS c,",
)


def moderated(spark, sf):
    ready = MO.prepare(documents(spark, sf)).withColumn("score", fixture_score())
    return MO.moderate(ready, CP.answers(spark, sf))


@query(
    "moderation",
    f"""WITH {_SQL_MODERATED}, {B.SQL_CLEANED}, {B.SQL_FEATURES}, {CT.SQL_RISK}
    SELECT doc_id, 'scored' AS outcome, features.c AS cleaned, length, word_count, has_repeated_chars,
      CAST(risk_score AS BIGINT) AS risk_score, indicators, round(fs, 4) AS final_score, action, confidence,
      routed, enhanced FROM combined JOIN features USING (doc_id) JOIN risk USING (doc_id)
    WHERE length(features.c) >= 3
    UNION ALL SELECT doc_id, CASE WHEN text = '' THEN 'invalid_empty' WHEN features.c = '' THEN 'empty_after_clean'
      ELSE 'too_short' END, features.c, length, word_count, has_repeated_chars, CAST(risk_score AS BIGINT),
      indicators, CASE WHEN features.c <> '' THEN 0::DOUBLE END, CASE WHEN features.c <> '' THEN 'allow' END,
      CASE WHEN features.c <> '' THEN 'high' END, FALSE, FALSE
      FROM documents JOIN features USING (doc_id) JOIN risk USING (doc_id) WHERE length(features.c) < 3""",
)
def moderation(spark, sf):
    """Every document from raw text to decision."""
    return moderated(spark, sf).select(
        "doc_id", "outcome", "cleaned", big("features.length").alias("length"),
        big("features.word_count").alias("word_count"), "features.has_repeated_chars",
        big("risk.risk_score").alias("risk_score"),
        F.array_join("risk.indicators", ",").alias("indicators"),
        "final_score", "action", "confidence", "routed", "enhanced",
    )


@query(
    "moderation_summary",
    f"""WITH {_SQL_MODERATED}, {B.SQL_CLEANED}, d AS (SELECT CASE WHEN length(cleaned.c) >= 3 THEN action
        WHEN cleaned.c <> '' THEN 'allow' ELSE 'none' END AS action, CASE WHEN length(cleaned.c) >= 3
        THEN confidence WHEN cleaned.c <> '' THEN 'high' ELSE 'none' END AS confidence
      FROM combined JOIN cleaned USING (doc_id))
    SELECT CASE WHEN grouping(action) = 1 THEN 'all' ELSE action END AS action,
      CASE WHEN grouping(confidence) = 1 THEN 'all' ELSE confidence END AS confidence, count(*) AS n
    FROM d GROUP BY CUBE (action, confidence)""",
)
def moderation_summary(spark, sf):
    """Decisions of all documents by action and confidence, with marginals."""
    decided = moderated(spark, sf).select(
        F.coalesce("action", F.lit("none")).alias("action"),
        F.coalesce("confidence", F.lit("none")).alias("confidence"),
    )
    return R.decision_cube(decided)


# what a twin can say of a trained model: which rows it was tried on, and that two ways of scoring agree

_SQL_LABELLED = "l AS (SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id))"
_SQL_RANKED = f"""{_SQL_LABELLED}, h AS (SELECT *, row_number() OVER (PARTITION BY toxic
    ORDER BY md5(doc_id || '-42'), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM l)"""
_IN_FOLD = " + ".join(f"(r > round(CAST(0.{2 * i} AS DOUBLE) * n))::INT" for i in range(1, 5))
_IS_TEST = "r <= round(CAST(0.2 AS DOUBLE) * n)"


def _is_score(c: str):
    return F.coalesce((F.col(c) > 0) & (F.col(c) < 1), F.lit(False))


@query(
    "cross_validation",
    f"""WITH {_SQL_RANKED} SELECT CAST({_IN_FOLD} AS INTEGER) AS fold, count(*) AS n, 0::BIGINT AS unscored,
      CAST(sum(toxic) AS BIGINT) AS positives, TRUE AS has_area FROM h GROUP BY 1""",
)
def cross_validation(spark, sf):
    """The five folds of the plain model: their rows, positives and that each was measured."""
    folds = TR.train_classifier(labelled(spark, sf))[1]
    return folds.select("fold", "n", "unscored", (F.col("tp") + F.col("fn")).alias("positives"),
                        F.col("roc_auc").between(0, 1).alias("has_area"))


@query(
    "balanced_holdout",
    f"WITH {_SQL_RANKED} SELECT doc_id, CAST(toxic AS INTEGER) AS toxic, TRUE AS scored FROM h WHERE {_IS_TEST}",
)
def balanced_holdout(spark, sf):
    """Holdout rows of the balanced model, each with a score."""
    _, _, held = TR.train_with_holdout(labelled(spark, sf))
    return held.select("doc_id", F.col("toxic").cast("int").alias("toxic"), _is_score("score").alias("scored"))


@query(
    "model_agreement",
    "SELECT doc_id, TRUE AS agree FROM documents",
)
def model_agreement(spark, sf):
    """Every document: the pipeline and the term join give the same score."""
    model = TR.fit_all(labelled(spark, sf))
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("comment_text"))
    one = TR.score_texts(model, docs).select("doc_id", F.col("score").alias("a"))
    coefficients, intercept = TR.model_terms(model)
    terms = TM.doc_terms(documents(spark, sf), "doc_id", "text")
    two = TM.score_linear(terms, "doc_id", coefficients, intercept).select("doc_id", F.col("score").alias("b"))
    return one.join(two, "doc_id").select("doc_id", (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("agree"))


@query("model_scores", "SELECT doc_id, TRUE AS scored, NULL::VARCHAR AS error, TRUE AS by_score FROM documents")
def model_scores(spark, sf):
    """Scores of all documents by a model that was saved and loaded."""
    model = TR.fit_all(labelled(spark, sf))
    path = fresh_path(spark, "model")
    sinks.save_model(model, path)
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("comment_text"))
    out = TR.score_texts(sinks.load_model(path), docs)
    by_score = F.col("pred") == (F.col("score") > 0.5).cast("int")
    return out.select("doc_id", _is_score("score").alias("scored"), "error", by_score.alias("by_score"))


@query("model_term_scores", "SELECT doc_id, TRUE AS scored FROM documents")
def model_term_scores(spark, sf):
    """Scores of all documents by a join of their terms with the model's table."""
    coefficients, intercept = TR.model_terms(TR.fit_all(labelled(spark, sf)))
    terms = TM.doc_terms(documents(spark, sf), "doc_id", "text")
    out = TM.score_linear(terms, "doc_id", coefficients, intercept)
    return out.select("doc_id", _is_score("score").alias("scored"))


@query(
    "moderation_by_model",
    f"""WITH {B.SQL_CLEANED} SELECT doc_id, CASE WHEN text = '' THEN 'invalid_empty' WHEN c = '' THEN 'empty_after_clean'
      WHEN length(c) < 3 THEN 'too_short' ELSE 'scored' END AS outcome,
      CASE WHEN c <> '' AND length(c) < 3 THEN 'allow' END AS unscored_action, length(c) >= 3 AS decided FROM cleaned""",
)
def moderation_by_model(spark, sf):
    """Every document from raw text to decision, scored by a trained model."""
    model = TR.fit_all(labelled(spark, sf))
    scored = TR.score_texts(model, MO.prepare(documents(spark, sf)), "cleaned")
    decided = MO.moderate(scored, CP.answers(spark, sf))
    scored_ = F.col("outcome") == "scored"
    return decided.select(
        "doc_id", "outcome", F.when(~scored_, F.col("action")).alias("unscored_action"),
        (scored_ & F.col("action").isNotNull() & F.col("final_score").isNotNull()).alias("decided"),
    )


def _split(spark, sf):
    """Training and test rows, joined and split once and stored: a run reads them many times."""
    split = sinks.stored(X.stratified_split(labelled(spark, sf), "toxic", "doc_id"), fresh_path(spark, "split"))
    return [split.filter(F.col("split") == n).drop("split") for n in ("train", "test")]


@query(
    "training_run",
    f"""WITH {_SQL_RANKED}, s AS (SELECT {_IS_TEST} AS test, toxic, d.text FROM h JOIN documents d USING (doc_id)
      WHERE {B.sql_strip('d.text')} <> '')
    SELECT count(*) FILTER (WHERE NOT test) AS n_train, count(*) FILTER (WHERE test) AS n_test,
      count(*) FILTER (WHERE test AND toxic = 1) AS positives, TRUE AS registered FROM s""",
)
def training_run(spark, sf):
    """Validation, training, evaluation and registration: what the written reports say."""
    train, test = _split(spark, sf)
    out = fresh_path(spark, "training")
    gate = TR.run_training(spark, train, test, out, min_rows=50)
    rows = spark.read.json(f"{out}/validation_report").select(
        F.col("train_final_samples").alias("n_train"), F.col("test_final_samples").alias("n_test")
    )
    matrix = spark.read.json(f"{out}/confusion_matrix").filter("actual = 1")
    matrix = matrix.select((F.col("predicted_0") + F.col("predicted_1") + F.col("unscored")).alias("positives"))
    package = spark.read.parquet(f"{out}/registry")
    accuracy = gate.select(F.col("accuracy").cast("string").alias("accuracy"))
    registered = package.join(accuracy, F.element_at("payload", F.lit("accuracy")) == F.col("accuracy"))
    return E.one_row(rows, matrix, registered.agg((F.count("*") == 1).alias("registered")))


QUICK = TR.Settings(max_features=300, max_iter=5, folds=2)


@query(
    "training_resumed",
    f"""WITH {_SQL_RANKED}, s AS (SELECT {_IS_TEST} AS test FROM h JOIN documents d USING (doc_id)
      WHERE {B.sql_strip('d.text')} <> '')
    SELECT run, stages, (SELECT count(*) FILTER (WHERE NOT test) FROM s) AS n_train, packages FROM (VALUES
      ('first', 'validate,fit,evaluate,register', 1), ('again', '', 1), ('other gate', 'evaluate,register', 2),
      ('other model', 'fit,evaluate,register', 3), ('other test rows', 'validate,evaluate,register', 4)) AS r(run, stages, packages)""",
)
def training_resumed(spark, sf):
    """The stages that five runs into one folder have to do, as their inputs change."""
    train, test = _split(spark, sf)
    out, rows = fresh_path(spark, "resumed"), []
    other = TR.Settings(**{**vars(QUICK), "c": 0.5})
    for run, part, settings, gate in (
        ("first", test, QUICK, 0.8),
        ("again", test, QUICK, 0.8),
        ("other gate", test, QUICK, 0.5),
        ("other model", test, other, 0.5),
        ("other test rows", test.filter("doc_id % 5 <> 0"), other, 0.5),
    ):
        training = TR.Training(spark, train, part, out, settings=settings, min_accuracy=gate, min_rows=10)
        training.run()
        report = spark.read.json(f"{out}/validation_report").select(F.col("train_final_samples").alias("n_train"))
        rows.append((run, ",".join(training.ran), report.first()["n_train"], read_registry(spark, f"{out}/registry").count()))
    return spark.createDataFrame(rows, "run STRING, stages STRING, n_train LONG, packages INT")


@query(
    "stream_model_swap",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS model, TRUE AS agree FROM documents",
)
def stream_model_swap(spark, sf):
    """A stream of documents over which a second model is approved: each row by the model of its batch."""
    docs = documents(spark, sf).select("doc_id", "text")
    source, registry, out, state = (fresh_path(spark, f"swap-{n}") for n in ("source", "registry", "out", "state"))
    models = {}
    for n, (name, part) in enumerate((("first", docs.filter("doc_id % 2 = 0")), ("second", docs.filter("doc_id % 2 <> 0")))):
        models[name] = TR.fit_all(labelled(spark, sf), settings=TR.Settings(max_features=200 + n, max_iter=3))
        path = fresh_path(spark, f"model-{name}")
        sinks.save_model(models[name], path)
        at = F.lit(f"2024-01-0{n + 1} 00:00:00").cast("timestamp_ntz")
        payload = F.create_map(F.lit("model_path"), F.lit(path))
        pending = RG.register_model(spark.range(1), F.lit(name), at, payload).drop("key")
        sinks.append_registry(pending, registry)
        sinks.append_registry(RG.approve_latest(read_registry(spark, registry), at + F.expr("INTERVAL 1 HOUR")), registry)
        part.write.mode("append").parquet(source)
        stream = read_event_stream(spark, source, docs.schema)
        S.finish(score_by_current(stream, registry, out, state))
    batch = [TR.score_texts(m, docs, "text").select("doc_id", F.lit(n).alias("model"), F.col("score").alias("b")) for n, m in models.items()]
    scored = spark.read.parquet(out).select("doc_id", "model", "score")
    both = scored.join(batch[0].unionByName(batch[1]), ["doc_id", "model"])
    return both.select("doc_id", "model", (F.abs(F.col("score") - F.col("b")) < 1e-12).alias("agree"))
