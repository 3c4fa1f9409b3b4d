"""Text rules over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog._base import big, documents, query, table
from textwarden import constants as K
from textwarden.functions import features as FE
from textwarden.functions import text as T
from textwarden.sources.files import split_lines


@query("clean_text", f"WITH {B.SQL_CLEANED} SELECT doc_id, c AS cleaned FROM cleaned")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned"))


@query(
    "html_unescape",
    f"SELECT page_id, {B.SQL_UNESCAPED_HTML} AS decoded FROM pages",
)
def html_unescape(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", T.html_unescape("html").alias("decoded"))


@query(
    "clean_pages",
    f"""WITH u AS (SELECT page_id, url || ' ' || {B.SQL_UNESCAPED_HTML} AS t FROM pages)
    SELECT page_id, {B.sql_clean('t')} AS cleaned FROM u""",
)
def clean_pages(spark, sf):
    pages = table(spark, sf, "pages")
    both = F.concat("url", F.lit(" "), "html")
    return pages.select("page_id", T.clean_text(both).alias("cleaned"))


@query("strip_urls", f"SELECT page_id, {B.sql_urls('url || chr(32) || html')} AS stripped FROM pages")
def strip_urls(spark, sf):
    both = F.concat("url", F.lit(" "), "html")
    return table(spark, sf, "pages").select("page_id", T.strip_urls(both).alias("stripped"))


@query("strip_emails", f"SELECT doc_id, {B.sql_emails('text')} AS stripped FROM documents")
def strip_emails(spark, sf):
    return documents(spark, sf).select("doc_id", T.strip_emails("text").alias("stripped"))


@query("squeeze_punctuation", f"SELECT doc_id, {B.sql_punct('text')} AS squeezed FROM documents")
def squeeze_punctuation(spark, sf):
    return documents(spark, sf).select("doc_id", T.squeeze_punct("text").alias("squeezed"))


@query("squeeze_space", f"SELECT doc_id, {B.sql_space('text')} AS squeezed FROM documents")
def squeeze_space(spark, sf):
    return documents(spark, sf).select("doc_id", T.squeeze_space("text").alias("squeezed"))


def cleaned(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", "lang", "text", T.clean_text("text").alias("c"))


@query(
    "text_features",
    f"""WITH {B.SQL_CLEANED}, {B.SQL_FEATURES}
    SELECT doc_id, length, word_count, has_caps, has_repeated_chars, exclamation_count,
      question_count, has_numbers, round(avg_word_length, 6) AS avg_word_length FROM features""",
)
def text_features(spark, sf):
    f = cleaned(spark, sf).select("doc_id", FE.text_features("c").alias("f")).select("doc_id", "f.*")
    counts = ("length", "word_count", "exclamation_count", "question_count")
    for c in counts:
        f = f.withColumn(c, big(c))
    return f.withColumn("avg_word_length", F.round("avg_word_length", 6))


@query(
    "listed_words",
    f"WITH {B.SQL_CLEANED} SELECT doc_id, lang, {B.SQL_LISTED.format(c='c')} AS hit FROM cleaned",
)
def listed_words(spark, sf):
    return cleaned(spark, sf).select("doc_id", "lang", T.has_listed_word("c").alias("hit"))


@query(
    "listed_words_by_language",
    f"""WITH {B.SQL_CLEANED}, hits AS (
      SELECT lang, CASE WHEN lang = 'en' THEN {B.SQL_LISTED.format(c='c')}
        WHEN lang = 'de' THEN regexp_matches(c, '(?i)(^|[^\\pL\\pN_])(der|und)($|[^\\pL\\pN_])')
        ELSE FALSE END AS hit FROM cleaned)
    SELECT lang, count(*) AS docs, CAST(count_if(hit) AS BIGINT) AS hits FROM hits GROUP BY lang""",
)
def listed_words_by_language(spark, sf):
    words = {"en": K.LISTED_WORDS, "de": ("der", "und")}
    hit = T.has_listed_word_by("c", "lang", words)
    return (
        cleaned(spark, sf)
        .groupBy("lang")
        .agg(F.count("*").alias("docs"), F.count_if(hit).alias("hits"))
    )


@query(
    "risk_flags",
    f"""WITH src AS (SELECT doc_id, text AS c FROM documents), {B.sql_flags('src')}
    SELECT doc_id, excessive_caps, excessive_punctuation, repeated_chars, very_short, very_long
    FROM flags""",
)
def risk_flags(spark, sf):
    flags = documents(spark, sf).select("doc_id", FE.risk_flags("text").alias("f"))
    return flags.select("doc_id", "f.*")


SQL_RISK = """risk AS (SELECT doc_id,
  (CASE WHEN length > 1000 OR length < 5 THEN 1 ELSE 0 END) + (CASE WHEN has_caps THEN 2 ELSE 0 END)
  + (CASE WHEN has_repeated_chars THEN 1 ELSE 0 END)
  + (CASE WHEN exclamation_count > 3 THEN 1 ELSE 0 END) + (CASE WHEN offensive THEN 3 ELSE 0 END)
    AS risk_score,
  concat_ws(',', CASE WHEN length > 1000 THEN 'very_long_text'
    WHEN length < 5 THEN 'very_short_text' END,
    CASE WHEN has_caps THEN 'excessive_caps' END,
    CASE WHEN has_repeated_chars THEN 'repeated_characters' END,
    CASE WHEN exclamation_count > 3 THEN 'excessive_exclamations' END,
    CASE WHEN offensive THEN 'potential_offensive_language' END) AS indicators
  FROM features)"""


@query(
    "risk_record",
    f"""WITH {B.SQL_CLEANED}, {B.SQL_FEATURES}, {SQL_RISK}
    SELECT doc_id, CAST(risk_score AS BIGINT) AS risk_score, indicators,
      risk_score > 5 AS needs_human_review FROM risk""",
)
def risk_record(spark, sf):
    parts = cleaned(spark, sf).select(
        "doc_id", FE.text_features("c").alias("f"), T.has_listed_word("c").alias("offensive")
    )
    r = parts.select("doc_id", FE.risk_record("f", F.col("offensive")).alias("r"))
    return r.select(
        "doc_id",
        big("r.risk_score").alias("risk_score"),
        F.array_join("r.indicators", ",").alias("indicators"),
        "r.needs_human_review",
    )


@query(
    "previews",
    """SELECT doc_id, substr(text, 1, 100) AS log_preview,
      CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS line_preview,
      substr(text, 1, 100) || '...' AS reason_preview FROM documents""",
)
def previews(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        T.preview("text").alias("log_preview"),
        T.preview("text", 100, "if_longer").alias("line_preview"),
        T.preview("text", 100, "always").alias("reason_preview"),
    )


@query(
    "text_variants",
    """WITH l AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    v AS (SELECT doc_id, toxic, unnest(CASE WHEN toxic = 1
      THEN [upper(replace(text, 'ß', 'ss')), text || '!!!', 'Really, ' || lower(text)]
      ELSE ['Please, ' || lower(text), text || ' Please.', 'I think ' || lower(text)] END) AS variant
      FROM l)
    SELECT doc_id, CAST(toxic AS INTEGER) AS toxic, variant FROM v""",
)
def text_variants(spark, sf):
    labelled = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    kinds = F.when(F.col("toxic") == 1, T.text_variants("text", "toxic")).otherwise(
        T.text_variants("text", "benign")
    )
    return labelled.select("doc_id", "toxic", F.explode(kinds).alias("variant"))


@query(
    "text_lines",
    f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line_no FROM p)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {B.sql_strip('t')} AS text FROM u
    WHERE {B.sql_strip('t')} <> ''""",
)
def text_lines(spark, sf):
    lines = split_lines(documents(spark, sf), "doc_id", "text")
    return lines.select("doc_id", big("line_no").alias("line_no"), "text")


@query(
    "action_labels",
    """SELECT event_id, coalesce(upper(nullif(event_type, 'view')), 'N/A') AS label,
      CASE event_type WHEN 'click' THEN 'Click Event' WHEN 'view' THEN 'View Event'
        WHEN 'signup' THEN 'Signup Event' WHEN 'purchase' THEN 'Purchase Event'
        ELSE 'Error Event' END AS title FROM events""",
)
def action_labels(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        T.action_label(F.nullif("event_type", F.lit("view"))).alias("label"),
        T.title_label(F.concat("event_type", F.lit("_event"))).alias("title"),
    )
