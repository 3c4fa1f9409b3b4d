"""Evaluation of fixture decisions against the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog._base import fixture_score, query, table
from textwarden.operators import evaluate as E
from textwarden.operators import splits as X

# the score is coarse, so that many rows tie
_SQL_GIVEN = f"CASE WHEN l.doc_id % 31 <> 3 THEN {B.SQL_SCORE.replace('doc_id', 'l.doc_id')} END"
SQL_PREDS = f"""preds AS (SELECT l.doc_id, l.toxic AS label, d.lang, {_SQL_GIVEN} AS score,
  CAST({_SQL_GIVEN} > 0.5::DOUBLE AS INTEGER) AS pred
  FROM labels l JOIN documents d USING (doc_id))"""


def predictions(spark, sf):
    """Decisions next to their labels; some texts have no score."""
    given = F.when(F.col("doc_id") % 31 != 3, fixture_score())
    scored = table(spark, sf, "documents").select("doc_id", "lang", given.alias("score"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    both = E.with_labels(scored, labels)
    return both.withColumn("pred", (F.col("score") > 0.5).cast("int"))


@query("with_labels", f"WITH {SQL_PREDS} SELECT doc_id, label, lang, score, CAST(pred AS INTEGER) AS pred FROM preds")
def with_labels(spark, sf):
    return predictions(spark, sf).select("doc_id", "label", "lang", "score", "pred")


@query(
    "confusion_matrix",
    f"""WITH {SQL_PREDS}, c AS (SELECT unnest([0, 1]) AS actual)
    SELECT CAST(actual AS INTEGER) AS actual, count(*) FILTER (WHERE pred = 0) AS predicted_0,
      count(*) FILTER (WHERE pred = 1) AS predicted_1,
      count(*) FILTER (WHERE label IS NOT NULL AND pred IS NULL) AS unscored
    FROM c LEFT JOIN preds ON label = actual GROUP BY actual""",
)
def confusion_matrix(spark, sf):
    return E.confusion_matrix(predictions(spark, sf))


@query(
    "accuracy",
    f"""WITH {SQL_PREDS} SELECT count(*) AS n, count(*) FILTER (WHERE pred IS NULL) AS unscored,
      count(*) FILTER (WHERE label = pred) AS correct,
      round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE pred IS NOT NULL), 6)
      AS accuracy FROM preds""",
)
def accuracy(spark, sf):
    return E.accuracy(predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


_SQL_CLASSES = f"""{SQL_PREDS},
  n AS (SELECT 0 AS class, count(*) FILTER (WHERE label = 0 AND pred IS NOT NULL) AS support,
      count(*) FILTER (WHERE pred = 0) AS chosen,
      count(*) FILTER (WHERE label = 0 AND pred = 0) AS hits FROM preds
    UNION ALL SELECT 1, count(*) FILTER (WHERE label = 1 AND pred IS NOT NULL), count(*) FILTER (WHERE pred = 1),
      count(*) FILTER (WHERE label = 1 AND pred = 1) FROM preds),
  m AS (SELECT class, support, CASE WHEN chosen > 0 THEN hits::DOUBLE / chosen ELSE 0 END AS p,
    CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS r FROM n),
  f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)"""


@query(
    "classification_report",
    f"""WITH {_SQL_CLASSES}, a AS (
      SELECT CAST(class AS VARCHAR) AS class, support, p, r, f FROM f
      UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), avg(p), avg(r), avg(f) FROM f
      UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), sum(p * support) / sum(support),
        sum(r * support) / sum(support), sum(f * support) / sum(support) FROM f)
    SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM a""",
)
def classification_report(spark, sf):
    r = E.classification_report(predictions(spark, sf))
    return r.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SQL_BINARY = """count(*) FILTER (WHERE pred IS NULL) AS unscored, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
  count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn"""

_SQL_RATES = """round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END, 6)
    AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _sql_auc(by: str) -> str:
    return f"""u AS (SELECT p.{by}, sum(CASE WHEN n.score < p.score THEN 1.0::DOUBLE
        WHEN n.score = p.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auc
      FROM preds p JOIN preds n ON p.{by} = n.{by} AND p.label = 1 AND n.label = 0
        AND p.score IS NOT NULL AND n.score IS NOT NULL GROUP BY p.{by})"""


def _rounded(df, *names):
    return df.select("n", "unscored", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in names])


RATES = ("accuracy", "precision", "recall", "f1", "roc_auc")


@query(
    "binary_metrics",
    f"""WITH {SQL_PREDS.replace('l.doc_id, l.toxic', "1 AS one, l.doc_id, l.toxic", 1)},
    {_sql_auc('one')}, b AS (SELECT count(*) AS n, {_SQL_BINARY} FROM preds)
    SELECT n, unscored, tp, fp, fn, tn, {_SQL_RATES}, round((SELECT auc FROM u), 6) AS roc_auc
    FROM b""",
)
def binary_metrics(spark, sf):
    return _rounded(E.binary_metrics(predictions(spark, sf), score="score"), *RATES)


SQL_FOLDED = f"""{SQL_PREDS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM preds),
  folds AS (SELECT *, (r > round(CAST(0.2 AS DOUBLE) * n))::INT + (r > round(CAST(0.4 AS DOUBLE) * n))::INT
    + (r > round(CAST(0.6 AS DOUBLE) * n))::INT + (r > round(CAST(0.8 AS DOUBLE) * n))::INT AS fold FROM ranked)"""


def fold_metrics(spark, sf):
    folded = X.stratified_folds(predictions(spark, sf), "label", "doc_id")
    return E.binary_metrics(folded, score="score", by=["fold"])


_SQL_FOLD_METRICS = f"""{SQL_FOLDED},
  u AS (SELECT p.fold, sum(CASE WHEN n.score < p.score THEN 1.0::DOUBLE
      WHEN n.score = p.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auc
    FROM folds p JOIN folds n ON p.fold = n.fold AND p.label = 1 AND n.label = 0
      AND p.score IS NOT NULL AND n.score IS NOT NULL GROUP BY p.fold),
  b AS (SELECT fold, count(*) AS n, {_SQL_BINARY} FROM folds GROUP BY fold),
  fold_metrics AS (SELECT CAST(fold AS INTEGER) AS fold, n, unscored, tp, fp, fn, tn, {_SQL_RATES},
    round(auc, 6) AS roc_auc FROM b JOIN u USING (fold))"""


@query("fold_metrics", f"WITH {_SQL_FOLD_METRICS} SELECT * FROM fold_metrics")
def fold_metrics_query(spark, sf):
    m = fold_metrics(spark, sf)
    return m.select("fold", "n", "unscored", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in RATES])


@query(
    "cv_summary",
    f"""WITH {_SQL_FOLD_METRICS}, l AS (UNPIVOT (SELECT {", ".join(RATES)} FROM fold_metrics)
      ON {", ".join(RATES)} INTO NAME metric VALUE value)
    SELECT metric, {B.sql_steady("avg(value)")} AS mean, {B.sql_steady("stddev_pop(value)")} AS std_pop,
      {B.sql_steady("2 * stddev_pop(value)")} AS two_std FROM l GROUP BY metric""",
)
def cv_summary(spark, sf):
    s = E.cv_summary(fold_metrics(spark, sf), RATES)
    return s.select("metric", *[B.steady(c).alias(c) for c in ("mean", "std_pop", "two_std")])


_SQL_REPORT = f"""{_SQL_CLASSES}, report AS (SELECT
  (SELECT avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM preds WHERE pred IS NOT NULL) AS accuracy,
  sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
  sum(f * support) / sum(support) AS f1_score FROM f)"""


def evaluation_report(spark, sf):
    """The weighted means of the report in one row, with the accuracy."""
    counts = E.label_counts(predictions(spark, sf))
    weighted = E.report_of(counts).filter(F.col("class") == "weighted avg")
    weighted = weighted.select("precision", "recall", F.col("f1").alias("f1_score"))
    return E.one_row(E.accuracy_of(counts).select("accuracy"), weighted)


@query(
    "evaluation_gate",
    f"""WITH {_SQL_REPORT} SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
      accuracy > 0.4::DOUBLE AS production_ready,
      CASE WHEN accuracy > 0.85::DOUBLE THEN 'high' ELSE 'medium' END AS confidence,
      CASE WHEN accuracy > 0.4::DOUBLE THEN 'approve' ELSE 'reject' END AS recommendation FROM report""",
)
def evaluation_gate(spark, sf):
    gate = E.evaluation_gate(evaluation_report(spark, sf), min_accuracy=0.4)
    names = ("accuracy", "precision", "recall", "f1_score")
    return gate.select(
        *[F.round(c, 6).alias(c) for c in names], "production_ready", "confidence", "recommendation"
    )


@query(
    "metrics_long",
    f"""WITH {_SQL_REPORT}, l AS (UNPIVOT report ON accuracy, precision, recall, f1_score
      INTO NAME metric_name VALUE value) SELECT metric_name, round(value, 6) AS value FROM l""",
)
def metrics_long(spark, sf):
    names = ("accuracy", "precision", "recall", "f1_score")
    long = E.metrics_long(evaluation_report(spark, sf), names)
    return long.withColumn("value", F.round("value", 6))


@query(
    "expectation_accuracy",
    f"""WITH {SQL_PREDS}, g AS (SELECT lang, count(*) AS cases, count(*) FILTER (WHERE score < 0.9::DOUBLE)
        AS succeeded, count(*) FILTER (WHERE score < 0.9::DOUBLE AND label = pred) AS correct
      FROM preds GROUP BY ROLLUP (lang))
    SELECT coalesce(lang, 'all') AS category, cases, succeeded, correct,
      round(CASE WHEN succeeded > 0 THEN correct::DOUBLE / succeeded ELSE 0 END, 6) AS accuracy,
      succeeded > 0 AS passed FROM g""",
)
def expectation_accuracy(spark, sf):
    """Expected and met labels per language; a call above 0.9 counts as failed."""
    preds = predictions(spark, sf).withColumn("ok", F.col("score") < 0.9)
    e = E.expectation_accuracy(preds, "lang", "label", "pred", "ok")
    return e.withColumn("accuracy", F.round("accuracy", 6))
