"""Terms, their statistics, TF-IDF weights and linear scores over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog._base import documents, query, table
from textwarden import constants as K
from textwarden.operators import terms as TM
from textwarden.plans import training as TR

_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)

SQL_TERMS = f"""toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}') AS l FROM documents),
  words AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM toks),
  kept AS (SELECT doc_id, w, i, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM words
    WHERE w NOT IN ({_STOP})),
  grams AS (SELECT doc_id, w AS term FROM kept
    UNION ALL SELECT doc_id, w || ' ' || nxt FROM kept WHERE nxt IS NOT NULL),
  terms AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM documents),
  stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df,
    ln((1 + (SELECT n FROM n))::DOUBLE / (1 + count(*))) + 1 AS idf FROM terms GROUP BY term)"""


def sql_vocabulary(k: int, min_df: int = 1, max_df: float = 1.0) -> str:
    return f"""vocab AS (SELECT * FROM stats WHERE df >= {min_df}
      AND df <= {max_df}::DOUBLE * (SELECT n FROM n) ORDER BY tf DESC, term LIMIT {k})"""


def doc_terms(spark, sf):
    return TM.doc_terms(documents(spark, sf), "doc_id", "text")


def stats(spark, sf):
    n = table(spark, sf, "documents").count()
    return TM.term_stats(doc_terms(spark, sf), n), n


@query(
    "document_terms",
    f"""WITH {SQL_TERMS} SELECT d.doc_id, t.term, t.tf FROM documents d LEFT JOIN terms t USING (doc_id)""",
)
def document_terms(spark, sf):
    return doc_terms(spark, sf)


@query("term_statistics", f"WITH {SQL_TERMS} SELECT term, tf, df, round(idf, 6) AS idf FROM stats")
def term_statistics(spark, sf):
    return stats(spark, sf)[0].withColumn("idf", F.round("idf", 6))


@query("vocabulary", f"WITH {SQL_TERMS}, {sql_vocabulary(10000)} SELECT term, tf, df FROM vocab")
def vocabulary(spark, sf):
    s, n = stats(spark, sf)
    return TM.vocabulary(s, n, 10000).select("term", "tf", "df")


@query(
    "vocabulary_limited",
    f"WITH {SQL_TERMS}, {sql_vocabulary(10000, 2, 0.95)} SELECT term, tf, df FROM vocab",
)
def vocabulary_limited(spark, sf):
    s, n = stats(spark, sf)
    return TM.vocabulary(s, n, 10000, min_df=2, max_df=0.95).select("term", "tf", "df")


@query(
    "first_features",
    f"WITH {SQL_TERMS}, {sql_vocabulary(10000, 2, 0.95)} SELECT term FROM vocab ORDER BY term LIMIT 100",
)
def first_features(spark, sf):
    s, n = stats(spark, sf)
    return TM.first_features(TM.vocabulary(s, n, 10000, 2, 0.95), 100)


def _sql_tfidf(limits: str) -> str:
    return f"""WITH {SQL_TERMS}, {limits}, r AS (SELECT doc_id, term, t.tf, t.tf * v.idf AS raw
        FROM terms t JOIN vocab v USING (term))
      SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight
      FROM r"""


def _weights(spark, sf, *limits):
    terms = TM.doc_terms(documents(spark, sf), "doc_id", "text", by_key=True)
    n = table(spark, sf, "documents").count()
    w = TM.tfidf(terms, "doc_id", TM.vocabulary(TM.term_stats(terms, n), n, *limits))
    return w.withColumn("weight", F.round("weight", 6))


@query("tfidf", _sql_tfidf(sql_vocabulary(10000)))
def tfidf(spark, sf):
    return _weights(spark, sf, 10000)


@query("tfidf_limited", _sql_tfidf(sql_vocabulary(10000, 2, 0.95)))
def tfidf_limited(spark, sf):
    return _weights(spark, sf, 10000, 2, 0.95)


SQL_COEFFICIENTS = f"""{SQL_TERMS}, marked AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df,
    ln((sum(CASE WHEN toxic = 1 THEN tf ELSE 0 END) + 1)::DOUBLE
      / (sum(CASE WHEN toxic = 0 THEN tf ELSE 0 END) + 1)) AS weight,
    ln((1 + (SELECT n FROM n))::DOUBLE / (1 + count(*))) + 1 AS idf
    FROM terms JOIN labels USING (doc_id) GROUP BY term),
  coef AS (SELECT * FROM marked ORDER BY tf DESC, term LIMIT 10000)"""


def coefficients(spark, sf):
    n = table(spark, sf, "documents").count()
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    marked = documents(spark, sf).join(labels, "doc_id")
    odds = TM.log_odds(TM.doc_terms(marked, "doc_id", "text", keep=["toxic"]), "toxic", n)
    # the model's documented max_features
    return odds.orderBy(F.desc("tf"), "term").limit(TR.Settings().max_features)


@query(
    "linear_coefficients",
    f"WITH {SQL_COEFFICIENTS} SELECT term, tf, df, round(weight, 6) AS weight, round(idf, 6) AS idf FROM coef",
)
def linear_coefficients(spark, sf):
    c = coefficients(spark, sf)
    return c.select("term", "tf", "df", F.round("weight", 6).alias("weight"), F.round("idf", 6).alias("idf"))


SQL_LINEAR = f"""{SQL_COEFFICIENTS},
  sums AS (SELECT doc_id, sum(t.tf * c.idf * c.weight) AS dot, sum(t.tf * c.idf * t.tf * c.idf) AS sq
    FROM terms t JOIN coef c USING (term) GROUP BY doc_id),
  linear AS (SELECT doc_id, 1 / (1 + exp(-(coalesce(dot / sqrt(sq), 0) + 0.25::DOUBLE))) AS score
    FROM documents LEFT JOIN sums USING (doc_id))"""


@query(
    "linear_scores",
    f"""WITH {SQL_LINEAR} SELECT doc_id, round(score, 6) AS score, CAST(score > 0.5 AS INTEGER) AS prediction
    FROM linear""",
)
def linear_scores(spark, sf):
    s = TM.score_linear(doc_terms(spark, sf), "doc_id", coefficients(spark, sf), intercept=0.25)
    return s.withColumn("score", F.round("score", 6))
