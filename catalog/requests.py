"""Requests, payloads and responses built from the given texts, then decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog._base import big, documents, fixture_score, query, table
from textwarden import constants as K
from textwarden.functions import payload as P
from textwarden.functions import text as T
from textwarden.plans import hooks as H
from textwarden.sources.files import first_existing


def _raw_requests(spark, sf):
    """Requests in the three envelopes: body as text, body as object, no body."""
    c = table(spark, sf, "conversations")
    meta = F.struct(F.col("role").alias("source"), F.col("conv_id").cast("string").alias("user_id"))
    event = F.struct("text", meta.alias("metadata"))
    inner = F.to_json(event)
    raw = (
        F.when(F.col("role") == "user", F.to_json(F.struct(inner.alias("body"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(event.alias("body"))))
        .otherwise(F.to_json(F.struct(meta.alias("metadata"))))
    )
    return c.select("conv_id", "turn", raw.alias("raw"))


@query(
    "decode_requests",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS text,
      role AS source, CAST(conv_id AS VARCHAR) AS user_id FROM conversations""",
)
def decode_requests(spark, sf):
    raw = _raw_requests(spark, sf)
    m = P.request_metadata("raw")
    return raw.select(
        "conv_id", "turn", P.request_text("raw").alias("text"),
        m["source"].alias("source"), m["user_id"].alias("user_id"),
    )


def _payloads(spark, sf):
    """One body per document; the language picks the content type and shape."""
    docs = documents(spark, sf)
    lang = F.col("lang")
    body = (
        F.when(lang == "de", F.to_json(F.struct("text")))
        .when(lang == "fr", F.to_json(F.split("text", "\n")))
        .otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n")))
    )
    kind = (
        F.when(lang == "en", "text/csv")
        .when(lang.isin("de", "fr"), "application/json")
        .otherwise("text/plain")
    )
    return docs.select("doc_id", body.alias("body"), kind.alias("content_type"))


def _decoded(spark, sf, mode):
    p = _payloads(spark, sf)
    items = P.payload_texts("body", "content_type", mode)
    return p.select("doc_id", F.posexplode(items).alias("pos", "text")).select(
        "doc_id", big("pos").alias("pos"), "text"
    )


def _sql_payload(csv: str, other: str) -> str:
    return f"""WITH p AS (SELECT doc_id, CASE lang WHEN 'en' THEN {csv}
      WHEN 'de' THEN [text] WHEN 'fr' THEN string_split(text, chr(10)) ELSE {other} END AS l
      FROM documents)
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS text FROM p"""


@query(
    "decode_payloads",
    _sql_payload(f"[{B.sql_strip('text')}]", "['  ' || text || chr(10)]"),
)
def decode_payloads(spark, sf):
    return _decoded(spark, sf, "single")


@query(
    "decode_payload_lines",
    _sql_payload(
        "list_filter(list_transform(string_split(text, chr(10)), lambda x: "
        + B.sql_strip("x")
        + "), lambda x: x <> '')",
        f"[{B.sql_strip('text')}]",
    ),
)
def decode_payload_lines(spark, sf):
    return _decoded(spark, sf, "lines")


@query(
    "decode_bytes",
    "SELECT doc_id, text AS decoded, length(text) AS chars FROM documents",
)
def decode_bytes(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("body"))
    decoded = docs.select("doc_id", P.decoded_bytes("body").alias("decoded"))
    return decoded.withColumn("chars", big(F.length("decoded")))


@query(
    "score_responses",
    f"""SELECT doc_id, CASE WHEN lang = 'es' OR doc_id % 11 IN (3, 4) THEN NULL ELSE {B.SQL_SCORE} END AS score
    FROM documents""",
)
def score_responses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", fixture_score().alias("s"))
    which = F.col("doc_id") % 11
    text = F.when(which == 3, "NaN").when(which == 4, "Infinity").otherwise(F.col("s").cast("string"))
    lang = F.col("lang")
    response = (
        F.when(lang == "en", F.concat(F.lit("["), text, F.lit("]")))
        .when(lang == "de", F.concat(F.lit('{"predictions": ['), text, F.lit("]}")))
        .when(lang == "fr", F.concat(F.lit(" "), text, F.lit("\n")))
        .otherwise(F.concat(F.lit('{"error": "'), text, F.lit('"}')))
    )
    return docs.select("doc_id", P.parse_score_response(response).alias("score"))


@query(
    "format_predictions",
    """WITH s AS (SELECT doc_id, lang, list_transform(string_split(text, chr(10)),
      lambda x: CAST(length(x) % 100 AS DOUBLE) / 100) AS l FROM documents),
    t AS (SELECT doc_id, lang, len(l) AS n, list_transform(l, lambda x: CAST(x AS VARCHAR)) AS l FROM s)
    SELECT doc_id, CASE WHEN lang = 'en' THEN array_to_string(l, ',') WHEN n = 1 THEN l[1]
      ELSE '[' || array_to_string(l, ', ') || ']' END AS body FROM t""",
)
def format_predictions(spark, sf):
    """Scores of the lines of a text, answered in the wanted format."""
    docs = documents(spark, sf)
    scores = F.transform(F.split("text", "\n"), lambda x: (F.length(x) % 100).cast("double") / 100.0)
    accept = F.when(F.col("lang") == "en", "text/csv").otherwise("application/json")
    return docs.select("doc_id", P.format_scores(scores, accept).alias("body"))


@query(
    "answered_requests",
    f"""WITH r AS (SELECT doc_id, lang, {B.sql_strip('text')} AS whole, list_filter(list_transform(string_split(text, chr(10)),
        lambda x: {B.sql_strip('x')}), lambda x: x <> '') AS lines FROM documents),
    t AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN lines WHEN 1 THEN lines WHEN 2 THEN [whole] ELSE [whole] END AS l FROM r),
    s AS (SELECT doc_id, lang, list_transform(l, lambda x: CASE WHEN contains(x, '@') THEN NULL
      ELSE CAST(CAST(length(x) % 100 AS DOUBLE) / 100 AS VARCHAR) END) AS l FROM t)
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n_texts, CASE
      WHEN lang = 'en' THEN array_to_string(list_transform(l, lambda x: coalesce(x, '')), ',')
      WHEN len(l) = 1 THEN coalesce(l[1], 'null')
      ELSE '[' || array_to_string(list_transform(l, lambda x: coalesce(x, 'null')), ', ') || ']' END AS body FROM s""",
)
def answered_requests(spark, sf):
    """Documents as requests of four kinds, decoded, scored text by text and answered in the order of their texts."""
    docs = documents(spark, sf)
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip_space), lambda x: x != "")
    kind = F.col("doc_id") % 4
    requests = docs.select(
        "doc_id",
        F.when(kind == 0, F.col("text")).when(kind == 1, F.to_json(lines)).when(kind == 2, F.to_json(F.struct(T.strip_space("text").alias("text"))))
        .otherwise(F.col("text")).alias("body"),
        F.when(kind == 0, "text/csv").when(kind == 3, "text/plain").otherwise("application/json").alias("content_type"),
        F.when(F.col("lang") == "en", "text/csv").otherwise("application/json").alias("accept"),
    )

    def score(rows):
        return rows.withColumn("score", F.when(~F.contains("text", F.lit("@")), (F.length("text") % 100).cast("double") / 100.0))

    return H.answer_requests(requests, score, "doc_id")


_SQL_OUTCOME = f"""WITH {B.SQL_CLEANED}
    SELECT doc_id, CASE WHEN text = '' THEN 'invalid_empty' WHEN c = '' THEN 'empty_after_clean'
      WHEN length(c) < 3 THEN 'too_short' ELSE 'scored' END AS online,
      CASE WHEN {B.sql_strip('text')} = '' THEN 'invalid_empty'
      WHEN length({B.sql_strip('text')}) > 1000 THEN 'invalid_too_long'
      WHEN c = '' THEN 'empty_after_clean' WHEN length(c) < 3 THEN 'too_short' ELSE 'scored' END
      AS demo FROM cleaned"""


@query("request_outcomes", _SQL_OUTCOME)
def request_outcomes(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", T.clean_text("text").alias("c"))
    return docs.select(
        "doc_id",
        P.classify_request("text", "c").alias("online"),
        P.classify_request("text", "c", max_len=K.DEMO_MAX_LENGTH).alias("demo"),
    )


@query(
    "short_line_bypass",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
    c AS (SELECT doc_id, {B.sql_clean('t')} AS c, t FROM p),
    o AS (SELECT CASE WHEN t = '' THEN 'invalid_empty' WHEN c = '' THEN 'empty_after_clean'
      WHEN length(c) < 3 THEN 'too_short' ELSE 'scored' END AS outcome FROM c)
    SELECT outcome, count(*) AS lines,
      CASE WHEN outcome = 'too_short' THEN 'allow' END AS action,
      CASE WHEN outcome = 'too_short' THEN 0.0::DOUBLE END AS score,
      CASE WHEN outcome = 'too_short' THEN '{K.TOO_SHORT_REASON}' END AS reason
    FROM o GROUP BY outcome""",
)
def short_line_bypass(spark, sf):
    """Every line as a request of its own; short ones are allowed without a score."""
    lines = documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("t"))
    done = lines.select("t", T.clean_text("t").alias("c"))
    out = done.select(P.classify_request("t", "c").alias("outcome"))
    short = F.col("outcome") == "too_short"
    return out.groupBy("outcome").agg(F.count("*").alias("lines")).select(
        "outcome",
        "lines",
        F.when(short, "allow").alias("action"),
        F.when(short, F.lit(0.0)).alias("score"),
        F.when(short, K.TOO_SHORT_REASON).alias("reason"),
    )


@query(
    "first_existing",
    """SELECT source AS name, min(doc_id) AS priority FROM documents WHERE n_chars > 500
    GROUP BY source""",
)
def first_found(spark, sf):
    """Per source, the first of its documents that the listing of long texts holds."""
    docs = table(spark, sf, "documents")
    key = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    listing = docs.filter("n_chars > 500").select(key.alias("key"))
    wanted = docs.select(F.col("source").alias("name"), F.col("doc_id").alias("priority"), key.alias("key"))
    return first_existing(listing, wanted).select("name", "priority")
