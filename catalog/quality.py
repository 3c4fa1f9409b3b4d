"""Data quality, unions, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog._base import big, documents, query, table
from textwarden.operators import ordering as O
from textwarden.operators import quality as Q
from textwarden.operators import splits as X
from textwarden.sources.sinks import report_json

SQL_LABELLED = """labelled AS (SELECT d.doc_id, d.lang, d.text AS comment_text,
  l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled(spark, sf):
    """All documents; those without a label keep a NULL."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("comment_text"))
    return docs.join(labels, "doc_id", "left")


def _parts(spark, sf):
    rows = labelled(spark, sf)
    return {
        "train": rows.filter("lang <=> 'en'"),
        "test": rows.filter("NOT lang <=> 'en'"),
    }


_SQL_STATS = f"""WITH {SQL_LABELLED},
  s AS (SELECT CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, * FROM labelled)
  SELECT split, count(*) AS samples,
    CAST(sum(CASE WHEN comment_text IS NULL THEN 1 ELSE 0 END
      + CASE WHEN toxic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_values,
    round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic_ratio,
    count(*) FILTER (WHERE comment_text IS NOT NULL AND toxic IS NOT NULL
      AND {B.sql_strip('comment_text')} <> '') AS final_samples
  FROM s GROUP BY split"""


@query("split_statistics", _SQL_STATS)
def split_statistics(spark, sf):
    stats = Q.split_statistics(X.tagged_union(_parts(spark, sf)))
    return stats.withColumn("toxic_ratio", F.round("toxic_ratio", 6))


_SQL_WIDE = f"""s AS ({_SQL_STATS}),
  w AS (SELECT max(samples) FILTER (WHERE split = 'train') AS train_samples,
    max(samples) FILTER (WHERE split = 'test') AS test_samples,
    max(missing_values) FILTER (WHERE split = 'train') AS train_missing,
    max(missing_values) FILTER (WHERE split = 'test') AS test_missing,
    max(toxic_ratio) FILTER (WHERE split = 'train') AS train_ratio,
    max(final_samples) FILTER (WHERE split = 'train') AS train_final,
    max(final_samples) FILTER (WHERE split = 'test') AS test_final FROM s),
  v AS (SELECT *, NOT (train_missing > train_samples * CAST(0.1 AS DOUBLE)
      OR test_missing > test_samples * CAST(0.1 AS DOUBLE) OR train_samples < 100) AS passed,
    list_filter([
      CASE WHEN train_missing > 0 OR test_missing > 0
        THEN 'Missing values: train=' || train_missing || ', test=' || test_missing END,
      CASE WHEN train_samples < 100 THEN 'Training data too small: ' || train_samples || ' samples' END,
      CASE WHEN train_ratio < 0.01 OR train_ratio > 0.99
        THEN 'Imbalanced dataset: toxic ratio = ' || printf('%.3f', train_ratio) END],
      lambda x: x IS NOT NULL) AS issues FROM w)"""


@query(
    "validation_report",
    f"""WITH {_SQL_WIDE} SELECT passed AS validation_passed, array_to_string(issues, '; ') AS issues,
      train_samples, test_samples, train_missing AS train_missing_values,
      test_missing AS test_missing_values, train_final AS train_final_samples,
      test_final AS test_final_samples FROM v""",
)
def validation_report(spark, sf):
    return Q.validation_report(_parts(spark, sf)).select(
        "validation_passed",
        F.array_join("issues", "; ").alias("issues"),
        "train_samples",
        "test_samples",
        "train_missing_values",
        "test_missing_values",
        "train_final_samples",
        "test_final_samples",
    )


@query(
    "validation_report_json",
    f"""WITH {_SQL_WIDE} SELECT CAST(to_json({{'validation_passed': passed, 'issues': issues,
      'train_samples': train_samples, 'test_samples': test_samples}}) AS VARCHAR) AS json FROM v""",
)
def validation_report_json(spark, sf):
    r = Q.validation_report(_parts(spark, sf))
    return report_json(r.select("validation_passed", "issues", "train_samples", "test_samples"))


@query(
    "validation_of_clean_data",
    f"""WITH l AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    h AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '-42'), doc_id) AS r,
      count(*) OVER (PARTITION BY toxic) AS n FROM l),
    s AS (SELECT CASE WHEN r <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split,
      toxic, text FROM h)
    SELECT count(*) FILTER (WHERE split = 'train') >= 100 AS validation_passed,
      count(*) FILTER (WHERE split = 'train') AS train_samples,
      count(*) FILTER (WHERE split = 'test') AS test_samples,
      round(avg(CAST(toxic AS DOUBLE)) FILTER (WHERE split = 'train'), 6) AS train_toxic_ratio,
      round(avg(CAST(toxic AS DOUBLE)) FILTER (WHERE split = 'test'), 6) AS test_toxic_ratio,
      count(*) FILTER (WHERE split = 'train' AND {B.sql_strip('text')} <> '') AS train_final_samples
    FROM s""",
)
def validation_of_clean_data(spark, sf):
    rows = labelled(spark, sf).filter("toxic IS NOT NULL")
    split = X.stratified_split(rows, "toxic", "doc_id")
    parts = {n: split.filter(F.col("split") == n).drop("split") for n in ("train", "test")}
    return Q.validation_report(parts).select(
        "validation_passed", "train_samples", "test_samples",
        F.round("train_toxic_ratio", 6).alias("train_toxic_ratio"),
        F.round("test_toxic_ratio", 6).alias("test_toxic_ratio"),
        "train_final_samples",
    )


@query(
    "clean_labelled",
    f"""WITH {SQL_LABELLED} SELECT doc_id, {B.sql_strip('comment_text')} AS comment_text, toxic
    FROM labelled WHERE comment_text IS NOT NULL AND toxic IS NOT NULL
      AND {B.sql_strip('comment_text')} <> ''""",
)
def clean_labelled(spark, sf):
    return Q.clean_labelled(labelled(spark, sf)).select("doc_id", "comment_text", "toxic")


@query(
    "labelled_union",
    """SELECT d.doc_id, d.text AS comment_text, 1 AS toxic FROM documents d JOIN labels l
      USING (doc_id) WHERE l.toxic = 1
    UNION ALL SELECT d.doc_id, d.text, 0 FROM documents d JOIN labels l USING (doc_id)
      WHERE l.toxic = 0""",
)
def labelled_union(spark, sf):
    rows = labelled(spark, sf).filter("toxic IS NOT NULL")
    parts = {str(v): rows.filter(F.col("toxic") == v).drop("toxic") for v in (1, 0)}
    both = X.tagged_union(parts, "toxic")
    return both.select("doc_id", "comment_text", F.col("toxic").cast("int").alias("toxic"))


_SQL_RANKED = """WITH h AS (SELECT doc_id, toxic,
    row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '-42'), doc_id) AS r,
    count(*) OVER (PARTITION BY toxic) AS n FROM labels)"""


@query(
    "stratified_split",
    f"""{_SQL_RANKED} SELECT doc_id, toxic,
      CASE WHEN r <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM h""",
)
def stratified_split(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return X.stratified_split(labels, "toxic", "doc_id")


@query(
    "stratified_folds",
    f"""{_SQL_RANKED} SELECT doc_id, toxic, CAST(
      (r > round(CAST(0.2 AS DOUBLE) * n))::INT + (r > round(CAST(0.4 AS DOUBLE) * n))::INT
      + (r > round(CAST(0.6 AS DOUBLE) * n))::INT + (r > round(CAST(0.8 AS DOUBLE) * n))::INT
      AS INTEGER) AS fold FROM h""",
)
def stratified_folds(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return X.stratified_folds(labels, "toxic", "doc_id")


@query(
    "hash_rank",
    """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
      ORDER BY md5(doc_id || '-7'), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS total
    FROM documents""",
)
def hash_rank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return O.hash_rank(docs, ["lang"], "doc_id", 7)


@query(
    "shuffled_rows",
    """SELECT doc_id, toxic, row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) AS n
    FROM labels""",
)
def shuffled_rows(spark, sf):
    """A full shuffle, with the place of every row."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return X.shuffled(labels, "doc_id")


@query(
    "numbered_results",
    "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents",
)
def numbered_results(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return O.numbered(docs, [F.desc("n_chars"), "doc_id"]).select("doc_id", "n")


@query(
    "class_weights",
    """WITH n AS (SELECT toxic, count(*) AS n_class FROM labels GROUP BY toxic)
    SELECT toxic, n_class,
      round(CAST(sum(n_class) OVER () AS DOUBLE) / (2.0::DOUBLE * n_class), 6) AS weight FROM n""",
)
def class_weights(spark, sf):
    w = X.class_weights(table(spark, sf, "labels"), "toxic")
    return w.withColumn("weight", F.round("weight", 6))


def _hex(c: str, digits: int) -> str:
    return f"CAST('0x' || substr({c}, 1, {digits}) AS BIGINT)"


N_DRAWS = 500


@query(
    "sampled_variants",
    f"""WITH l AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '-42'), doc_id) AS r,
      count(*) OVER (PARTITION BY toxic) AS n FROM l),
    i AS (SELECT DISTINCT toxic, n, unnest(range({N_DRAWS})) AS draw_id FROM r),
    d AS (SELECT toxic, n, draw_id, {_hex("md5(toxic || '-' || draw_id || '-row-42')", 12)} % n + 1 AS p,
      {_hex("md5(toxic || '-' || draw_id || '-vary-42')", 8)}::DOUBLE / 4294967296::DOUBLE
        < CASE toxic WHEN 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS varied,
      {_hex("md5(toxic || '-' || draw_id || '-variant-42')", 8)} % 3 AS which FROM i),
    j AS (SELECT d.*, r.doc_id, r.text FROM d JOIN r ON r.toxic = d.toxic AND r.r = d.p)
    SELECT toxic, draw_id, doc_id, varied, CASE WHEN NOT varied THEN text
      WHEN toxic = 1 AND which = 0 THEN upper(replace(text, 'ß', 'ss'))
      WHEN toxic = 1 AND which = 1 THEN text || '!!!' WHEN toxic = 1 THEN 'Really, ' || lower(text)
      WHEN which = 0 THEN 'Please, ' || lower(text) WHEN which = 1 THEN text || ' Please.'
      ELSE 'I think ' || lower(text) END AS text FROM j""",
)
def sampled_variants(spark, sf):
    """The same number of draws with replacement from either class."""
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    out = X.sample_variants(rows, "doc_id", "text", "toxic", N_DRAWS)
    return out.withColumn("draw_id", big("draw_id"))


@query(
    "split_of_many_classes",
    """WITH h AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id
      ORDER BY md5(event_id || '-42'), event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, CASE WHEN r <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
    FROM h""",
)
def split_of_many_classes(spark, sf):
    """Every user is a class of their own."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    return X.stratified_split(events, "user_id", "event_id")
