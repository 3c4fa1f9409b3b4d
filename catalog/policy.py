"""Decision policies, second opinions and their combination, for every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import _base as B
from catalog._base import documents, fixture_score, query, table
from textwarden import constants as K
from textwarden.functions import features as FE
from textwarden.functions import policy as P
from textwarden.functions import scores as S
from textwarden.functions import text as T
from textwarden.functions.verdicts import parse_verdicts as parse
from textwarden.operators import decisions as D

SCORED = f"scored AS (SELECT doc_id, lang, text, text AS c, {B.SQL_SCORE} AS score FROM documents)"


def scored(spark, sf):
    """Documents with the fixture score and the flags of the raw text."""
    docs = documents(spark, sf).withColumn("score", fixture_score())
    return docs.select("doc_id", "lang", "text", "score", FE.risk_flags("text").alias("flags"))


def scores_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fixture_score().alias("score"))


#: Scores of which some are missing, or no finite numbers: for a policy that is the same.
SQL_ODD = f"CASE WHEN doc_id % 97 BETWEEN 5 AND 7 THEN NULL ELSE {B.SQL_SCORE} END"


def odd_scores(spark, sf):
    which = F.col("doc_id") % 97
    odd = F.when(which == 5, float("nan")).when(which == 6, None).when(which == 7, float("inf"))
    return table(spark, sf, "documents").select("doc_id", odd.otherwise(fixture_score()).alias("score"))


def answers(spark, sf):
    """Raw reviewer answers for all labelled documents, in eight shapes."""
    labels = table(spark, sf, "labels")
    num = F.concat(F.lit("0."), F.lpad(((F.col("doc_id") * 7) % 100).cast("string"), 2, "0"))
    # quoted, it is no number, whatever it spells
    quoted = F.when(F.col("doc_id") % 3 == 0, "NaN").when(F.col("doc_id") % 3 == 1, "Infinity").otherwise(num)
    act = F.when(F.col("toxic") == 1, "block").when(F.col("quality") == 0, "review").otherwise("allow")
    fields = F.concat(
        F.lit('"contextual_toxicity_score": '), num, F.lit(', "recommended_action": "'), act, F.lit('"')
    )
    more = F.concat(
        F.lit(', "confidence": "low", "reasoning": "case '),
        F.col("doc_id").cast("string"),
        F.lit('", "harm_categories": ["harassment", "threats"]'),
    )
    full = F.concat(F.lit("{"), fields, more, F.lit("}"))
    shape = F.col("doc_id") % 8
    raw = (
        F.when(shape == 0, full)
        .when(shape == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit(" ```\n"), full, F.lit("\n```\n")))
        .when(shape == 3, F.concat(F.lit('{"contextual_toxicity_score": '), num, F.lit("}")))
        .when(
            shape == 4,
            F.concat(F.lit('{"contextual_toxicity_score": "'), quoted, F.lit('"'), more, F.lit("}")),
        )
        .when(
            shape == 5,
            F.concat(
                F.lit('{"contextual_toxicity_score": 1.7, "recommended_action": "ban"'), more, F.lit("}")
            ),
        )
        .when(shape == 6, F.concat(F.lit("{"), fields, more))
        .otherwise(F.concat(F.lit("{"), fields, more, F.lit(', "is_false_positive": true}')))
    )
    return labels.select("doc_id", raw.alias("raw"))


SQL_ANSWERS = """nums AS (SELECT doc_id, '0.' || lpad(CAST((doc_id * 7) % 100 AS VARCHAR), 2, '0') AS num,
    CASE WHEN toxic = 1 THEN 'block' WHEN quality = 0 THEN 'review' ELSE 'allow' END AS act FROM labels),
  f AS (SELECT doc_id, num, '"contextual_toxicity_score": ' || num || ', "recommended_action": "'
      || act || '"' AS fields, ', "confidence": "low", "reasoning": "case ' || doc_id
      || '", "harm_categories": ["harassment", "threats"]' AS more FROM nums),
  answers AS (SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN '{' || fields || more || '}'
    WHEN 1 THEN '```json' || chr(10) || '{' || fields || more || '}' || chr(10) || '```'
    WHEN 2 THEN ' ```' || chr(10) || '{' || fields || more || '}' || chr(10) || '```' || chr(10)
    WHEN 3 THEN '{"contextual_toxicity_score": ' || num || '}'
    WHEN 4 THEN '{"contextual_toxicity_score": "' || CASE doc_id % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' ELSE num END
      || '"' || more || '}'
    WHEN 5 THEN '{"contextual_toxicity_score": 1.7, "recommended_action": "ban"' || more || '}'
    WHEN 6 THEN '{' || fields || more
    ELSE '{' || fields || more || ', "is_false_positive": true}' END AS raw FROM f)"""

SQL_BODY = f"""body AS (SELECT doc_id, CASE
    WHEN starts_with({B.sql_strip('raw')}, '```json') THEN substr({B.sql_strip('raw')}, 8,
      greatest(length({B.sql_strip('raw')}) - 10, 0))
    WHEN starts_with({B.sql_strip('raw')}, '```') THEN substr({B.sql_strip('raw')}, 4,
      greatest(length({B.sql_strip('raw')}) - 6, 0))
    ELSE {B.sql_strip('raw')} END AS b FROM answers)"""

SQL_SPARE = """CASE WHEN s > 0.8::DOUBLE THEN 'block' WHEN s > 0.6::DOUBLE THEN 'review' ELSE 'allow' END AS
    spare_action, CASE WHEN s > 0.8::DOUBLE THEN 'medium' WHEN s > 0.6::DOUBLE THEN 'low'
    ELSE 'medium' END AS spare_confidence"""

SQL_VERDICTS = f"""{SQL_ANSWERS}, {SQL_BODY},
  j AS (SELECT doc_id, {B.SQL_SCORE} AS s, b, json_valid(b) AND b <> '' AS ok,
    CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS v FROM body),
  verdicts AS (SELECT doc_id, s, ok, CASE WHEN NOT ok THEN s
      WHEN NOT json_exists(v, '$.contextual_toxicity_score') THEN 0.5::DOUBLE
      WHEN json_type(v, '$.contextual_toxicity_score') = 'VARCHAR' THEN s
      ELSE greatest(0::DOUBLE, least(1::DOUBLE, CAST(v->>'$.contextual_toxicity_score' AS DOUBLE))) END
      AS v_score,
    CASE WHEN NOT ok THEN spare_action WHEN v->>'$.recommended_action' IN ('allow', 'review', 'block')
      THEN v->>'$.recommended_action' ELSE 'review' END AS v_action,
    CASE WHEN NOT ok THEN spare_confidence ELSE coalesce(v->>'$.confidence', 'medium') END AS v_confidence,
    CASE WHEN NOT ok THEN 'Second opinion failed: JSON parse error. Using ML model score.'
      ELSE coalesce(v->>'$.reasoning', '{K.MISSING_REASONING}') END AS v_reasoning,
    CASE WHEN ok AND json_exists(v, '$.harm_categories') THEN 'harassment, threats' ELSE 'unknown' END
      AS v_categories,
    ok AND coalesce(v->>'$.is_false_positive', 'false') = 'true' AS v_false_positive
    FROM (SELECT *, {SQL_SPARE} FROM j))"""


@query(
    "latest_verdicts",
    "SELECT conv_id, arg_max(text, turn) AS raw FROM conversations GROUP BY conv_id",
)
def latest_verdicts(spark, sf):
    """The newest of several answers: every turn answers for its conversation."""
    c = table(spark, sf, "conversations").withColumnRenamed("text", "raw")
    return D.latest_verdicts(c, "conv_id", "turn")


@query("strip_fences", f"WITH {SQL_ANSWERS}, {SQL_BODY} SELECT doc_id, b AS body FROM body")
def strip_fences(spark, sf):
    return answers(spark, sf).select("doc_id", T.strip_fence("raw").alias("body"))


@query(
    "parse_verdicts",
    f"""WITH {SQL_VERDICTS} SELECT doc_id, v_score AS score, v_action AS action,
      v_confidence AS confidence, v_reasoning AS reasoning, v_categories AS categories, ok AS enhanced,
      v_false_positive AS is_false_positive, CASE WHEN NOT ok THEN 'JSON parse error' END AS error,
      round(CASE WHEN ok THEN abs(v_score - s) ELSE 0::DOUBLE END, 6) AS score_difference FROM verdicts""",
)
def parse_verdicts(spark, sf):
    raw = answers(spark, sf).withColumn("s", fixture_score())
    v = parse(raw, "raw", "s", "v")
    return v.select(
        "doc_id", "v.score", "v.action", "v.confidence", "v.reasoning",
        F.array_join("v.harm_categories", ", ").alias("categories"),
        "v.enhanced", "v.is_false_positive", "v.error",
        F.round("v.score_difference", 6).alias("score_difference"),
    )


def _ladder(block, block_conf, review, review_conf, allow_conf) -> str:
    return f"""SELECT doc_id, CASE WHEN s IS NULL THEN 'review' WHEN s > {block}::DOUBLE THEN 'block'
      WHEN s > {review}::DOUBLE THEN 'review' ELSE 'allow' END AS action,
      CASE WHEN s IS NULL THEN 'medium' WHEN s > {block}::DOUBLE THEN '{block_conf}'
      WHEN s > {review}::DOUBLE THEN '{review_conf}'
      ELSE '{allow_conf}' END AS confidence, {review}::DOUBLE AS threshold, s > 0.5::DOUBLE AS is_toxic
    FROM (SELECT doc_id, {SQL_ODD} AS s FROM documents)"""


def _register_ladder(policy: str, sql: str) -> None:
    @query(f"policy_{policy}", sql)
    def run(spark, sf):
        decided = odd_scores(spark, sf).select("doc_id", P.decide("score", policy).alias("d"))
        return decided.select("doc_id", "d.*")


_register_ladder("demo", _ladder(0.7, "high", 0.5, "medium", "high"))
_register_ladder("ml_only", _ladder(0.7, "high", 0.5, "medium", "high"))
_register_ladder("reviewer_unavailable", _ladder(0.8, "medium", 0.6, "low", "medium"))
_register_ladder(
    "binary",
    f"""SELECT doc_id, CASE WHEN s IS NULL THEN 'review' WHEN s > 0.5::DOUBLE THEN 'toxic' ELSE 'safe' END AS action,
      CASE WHEN s IS NULL THEN 'LOW' WHEN abs(s - 0.5::DOUBLE) > 0.3::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
      0.5::DOUBLE AS threshold, s > 0.5::DOUBLE AS is_toxic
    FROM (SELECT doc_id, {SQL_ODD} AS s FROM documents)""",
)

_FALLBACK = """CASE WHEN score IS NULL THEN 'review' WHEN score > 0.8::DOUBLE THEN 'block' WHEN score > thr THEN 'review' ELSE 'allow' END AS
      action, CASE WHEN score IS NULL THEN 'medium' WHEN score > 0.8::DOUBLE THEN 'high' WHEN score > thr THEN 'medium'
      WHEN score < 0.2::DOUBLE THEN 'high' ELSE 'medium' END AS confidence"""


@query(
    "policy_online_fallback",
    f"""WITH t AS (SELECT doc_id, {SQL_ODD} AS score, 0.5::DOUBLE AS thr FROM documents)
    SELECT doc_id, {_FALLBACK}, thr AS threshold, score > thr AS is_toxic FROM t""",
)
def policy_online_fallback(spark, sf):
    d = odd_scores(spark, sf).select("doc_id", P.decide("score", "online_fallback").alias("d"))
    return d.select("doc_id", "d.*")


@query(
    "policy_online_fallback_adjusted",
    f"""WITH {SCORED}, {B.sql_flags('scored')}, t AS (SELECT *, greatest(0.3::DOUBLE,
      least(0.8::DOUBLE, 0.5::DOUBLE - (CASE WHEN excessive_caps THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
      - (CASE WHEN excessive_punctuation THEN 0.05::DOUBLE ELSE 0::DOUBLE END)
      - (CASE WHEN repeated_chars THEN 0.05::DOUBLE ELSE 0::DOUBLE END))) AS thr
      FROM (SELECT * REPLACE ({SQL_ODD} AS score) FROM flags))
    SELECT doc_id, {_FALLBACK}, thr AS threshold, score > thr AS is_toxic FROM t""",
)
def policy_online_fallback_adjusted(spark, sf):
    rows = scored(spark, sf).drop("score").join(odd_scores(spark, sf), "doc_id")
    d = rows.select("doc_id", P.decide("score", "online_fallback", "flags", adjust=True).alias("d"))
    return d.select("doc_id", "d.*")


@query(
    "score_functions",
    f"""SELECT doc_id, greatest(0.3::DOUBLE, least(0.8::DOUBLE, s)) AS clamped,
      s > 0.3::DOUBLE AND s < 0.8::DOUBLE AS borderline_open,
      s > 0.3::DOUBLE AND s <= 0.8::DOUBLE AS borderline_closed, s > 0.5::DOUBLE AS toxic,
      CASE WHEN abs(s - 0.5::DOUBLE) > 0.3::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
      round(abs(s - n_chars / 10000.0::DOUBLE), 6) AS difference,
      round(0.6::DOUBLE * (n_chars % 100) / 100 + 0.4::DOUBLE * s, 4) AS blended,
      CASE WHEN n_chars % 7 > 0 THEN CAST(n_chars AS DOUBLE) / (n_chars % 7) ELSE 0::DOUBLE END AS ratio,
      printf('%.1f%%', s * 100) AS percent,
      CASE WHEN s * 100 >= 80 THEN 'ok' WHEN s * 100 >= 50 THEN 'warn' ELSE 'bad' END AS bucket
    FROM (SELECT doc_id, n_chars, {B.SQL_SCORE} AS s FROM documents)""",
)
def score_functions(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", fixture_score().alias("s"))
    tenth = F.col("n_chars") / F.lit(10000.0)
    mixed = F.lit(0.6) * (F.col("n_chars") % 100) / 100 + F.lit(0.4) * F.col("s")
    return rows.select(
        "doc_id",
        S.clamp("s", 0.3, 0.8).alias("clamped"),
        S.borderline("s").alias("borderline_open"),
        S.borderline("s", hi_closed=True).alias("borderline_closed"),
        S.is_toxic("s").alias("toxic"),
        S.distance_confidence("s").alias("confidence"),
        F.round(S.score_difference("s", tenth), 6).alias("difference"),
        F.round(mixed, 4).alias("blended"),
        S.safe_ratio("n_chars", F.col("n_chars") % 7).alias("ratio"),
        S.percent_text("s").alias("percent"),
        S.status_bucket(F.col("s") * 100).alias("bucket"),
    )


@query(
    "review_requests",
    f"""WITH {SCORED}, {B.sql_flags('scored')}
    SELECT doc_id, 'Judge whether the text below is harmful in its context.' || chr(10) || chr(10)
      || 'Text: "' || text || '"' || chr(10) || chr(10) || 'Model score: ' || printf('%.3f', score)
      || ' (0.0 = safe, 1.0 = toxic)' || chr(10) || 'Risk flags: {{' || chr(10)
      || '  "excessive_caps": ' || excessive_caps || ',' || chr(10)
      || '  "excessive_punctuation": ' || excessive_punctuation || ',' || chr(10)
      || '  "repeated_chars": ' || repeated_chars || ',' || chr(10)
      || '  "very_short": ' || very_short || ',' || chr(10)
      || '  "very_long": ' || very_long || chr(10) || '}}' || chr(10) || chr(10)
      || 'Weigh intent, real-world harm, irony, cultural context, audience and the chance of a false'
      || ' alarm. Answer with one JSON object with the fields: contextual_toxicity_score,'
      || ' recommended_action, confidence, reasoning, harm_categories, context_factors, is_sarcasm,'
      || ' is_false_positive, severity_level, target_audience_risk, cultural_sensitivity,'
      || ' explanation_for_user.' AS prompt
    FROM flags WHERE score > 0.3::DOUBLE AND score < 0.8::DOUBLE""",
)
def review_requests(spark, sf):
    return D.render_review_requests(scored(spark, sf))


SQL_ATTACHED = f"""{SQL_VERDICTS}, {SCORED}, {B.sql_flags('scored')},
  attached AS (SELECT f.doc_id, f.text, score, excessive_caps, excessive_punctuation,
    score > 0.3::DOUBLE AND score < 0.8::DOUBLE AS routed, v.doc_id IS NOT NULL AS answered, v.* EXCLUDE doc_id
    FROM flags f LEFT JOIN verdicts v ON v.doc_id = f.doc_id
      AND score > 0.3::DOUBLE AND score < 0.8::DOUBLE),
  own AS (SELECT *, coalesce(ok, FALSE) AS enhanced,
    CASE WHEN answered THEN v_action WHEN routed THEN
      CASE WHEN score > 0.8::DOUBLE THEN 'block' WHEN score > 0.6::DOUBLE THEN 'review' ELSE 'allow' END
      ELSE CASE WHEN score > 0.7::DOUBLE THEN 'block' WHEN score > 0.5::DOUBLE THEN 'review'
        ELSE 'allow' END END AS r_action,
    CASE WHEN answered THEN v_confidence WHEN routed THEN
      CASE WHEN score > 0.8::DOUBLE THEN 'medium' WHEN score > 0.6::DOUBLE THEN 'low' ELSE 'medium' END
      ELSE CASE WHEN score > 0.7::DOUBLE THEN 'high' WHEN score > 0.5::DOUBLE THEN 'medium'
        ELSE 'high' END END AS r_confidence,
    CASE WHEN answered THEN v_reasoning
      WHEN routed THEN 'Second opinion failed: no answer. Using ML model score.'
      WHEN score > 0.7::DOUBLE THEN '{K.MODEL_ONLY_REASONS["block"]}'
      WHEN score > 0.5::DOUBLE THEN '{K.MODEL_ONLY_REASONS["review"]}'
      ELSE '{K.MODEL_ONLY_REASONS["allow"]}' END AS r_reasoning,
    coalesce(v_categories, 'unknown') AS r_categories,
    coalesce(v_false_positive, FALSE) AS r_false_positive FROM attached),
  final AS (SELECT *, (CASE WHEN enhanced THEN 0.6::DOUBLE * v_score + 0.4::DOUBLE * score ELSE score END)
    + (CASE WHEN excessive_caps THEN 0.05::DOUBLE ELSE 0::DOUBLE END)
    + (CASE WHEN excessive_punctuation THEN 0.03::DOUBLE ELSE 0::DOUBLE END) AS fs FROM own),
  combined AS (SELECT *, CASE WHEN r_false_positive THEN 'allow'
      WHEN fs > 0.8::DOUBLE OR r_action = 'block' THEN 'block'
      WHEN fs > 0.5::DOUBLE OR r_action = 'review' THEN 'review' ELSE 'allow' END AS action,
    CASE WHEN r_false_positive OR fs > 0.8::DOUBLE OR r_action = 'block' THEN 'high'
      WHEN fs > 0.5::DOUBLE OR r_action = 'review' THEN r_confidence ELSE 'high' END AS confidence
    FROM final)"""


def attached(spark, sf):
    return D.attach_verdicts(scored(spark, sf), answers(spark, sf))


@query(
    "attach_verdicts",
    f"""WITH {SQL_ATTACHED} SELECT doc_id, score, routed, enhanced, r_action AS action,
      r_confidence AS confidence, r_reasoning AS reasoning, r_categories AS categories FROM own""",
)
def attach_verdicts(spark, sf):
    return attached(spark, sf).select(
        "doc_id", "score", "routed", "enhanced", "verdict.action", "verdict.confidence",
        "verdict.reasoning", F.array_join("verdict.harm_categories", ", ").alias("categories"),
    )


@query(
    "two_answers",
    f"""WITH {SQL_ATTACHED} SELECT doc_id, score, routed, enhanced, r_action AS action,
      r_reasoning AS reasoning FROM own""",
)
def two_answers(spark, sf):
    """Every answered document has an older answer too: it stays one row, the newer answer counts."""
    new = answers(spark, sf).withColumn("ts", F.lit(2))
    old = new.select("doc_id", F.lit('{"contextual_toxicity_score": 0.999, "reasoning": "old"}').alias("raw"), F.lit(1).alias("ts"))
    both = D.attach_verdicts(scored(spark, sf), new.unionByName(old), ts="ts")
    return both.select("doc_id", "score", "routed", "enhanced", "verdict.action", "verdict.reasoning")


@query(
    "combine_verdicts",
    f"""WITH {SQL_ATTACHED} SELECT doc_id, round(fs, 4) AS final_score, action, confidence, routed,
      enhanced FROM combined""",
)
def combine_verdicts(spark, sf):
    return D.decide_combined(attached(spark, sf)).select(
        "doc_id", "final_score", "action", "confidence", "routed", "enhanced"
    )


@query(
    "decide_enhanced",
    f"""WITH {SQL_ATTACHED} SELECT doc_id, round(fs, 4) AS final_score, action, confidence,
      round(fs, 4) > 0.5::DOUBLE AS is_toxic, 0.5::DOUBLE AS threshold,
      CASE WHEN action = 'review' THEN '{K.REVIEW_REASON}' || CASE WHEN r_categories <> 'unknown'
          THEN ' (Potential concerns: ' || r_categories || ')' ELSE '' END
        WHEN action = 'block' THEN '{K.BLOCK_REASON}' || ' (Analysis: ' || substr(r_reasoning, 1, 100)
          || '...)' END AS reason FROM combined""",
)
def decide_enhanced(spark, sf):
    return D.decide_enhanced(attached(spark, sf)).select(
        "doc_id", "final_score", "action", "confidence", "is_toxic", "threshold", "reason"
    )


@query(
    "decide_enhanced_with_fallback",
    f"""WITH {SQL_ATTACHED}, x AS (SELECT c.*, d.lang = 'en' AS online FROM combined c
      JOIN documents d USING (doc_id))
    SELECT doc_id, round(CASE WHEN online THEN fs ELSE score END, 4) AS final_score,
      CASE WHEN online THEN action WHEN score > 0.8::DOUBLE THEN 'block'
        WHEN score > 0.5::DOUBLE THEN 'review' ELSE 'allow' END AS action,
      CASE WHEN online THEN confidence WHEN score > 0.8::DOUBLE THEN 'high'
        WHEN score > 0.5::DOUBLE THEN 'medium' WHEN score < 0.2::DOUBLE THEN 'high' ELSE 'medium' END
        AS confidence FROM x""",
)
def decide_enhanced_with_fallback(spark, sf):
    """Reviewers online for English only; other rows keep the threshold policy."""
    rows = attached(spark, sf).withColumn("online", F.col("lang") == "en")
    return D.decide_enhanced(rows, "online").select("doc_id", "final_score", "action", "confidence")


SQL_ROUTED = f"""{SQL_VERDICTS}, {SCORED},
  routed AS (SELECT s.doc_id, s.text, s.score, s.score > 0.3::DOUBLE AND s.score <= 0.8::DOUBLE AS b,
    CASE WHEN s.score > 0.3::DOUBLE AND s.score <= 0.8::DOUBLE THEN v.v_action END AS va
    FROM scored s LEFT JOIN (SELECT * FROM verdicts WHERE ok) v USING (doc_id)),
  workflow AS (SELECT doc_id, text, score,
    CASE WHEN score > 0.8::DOUBLE THEN 'high' WHEN b THEN 'borderline' ELSE 'low' END AS branch,
    CASE WHEN b AND va IS NULL THEN NULL WHEN score > 0.8::DOUBLE OR va = 'block' THEN 'BLOCKED'
      WHEN va = 'review' THEN 'REVIEW' ELSE 'ALLOWED' END AS final_decision,
    CASE WHEN b AND va IS NULL THEN 'review' WHEN score > 0.8::DOUBLE OR va = 'block' THEN 'block'
      WHEN va = 'review' THEN 'review' ELSE 'allow' END AS action,
    CASE WHEN b AND va IS NULL OR va = 'review' THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN b AND va IS NULL THEN '{K.ROUTE_REASONS["fallback"]}'
      WHEN score > 0.8::DOUBLE OR va = 'block' THEN '{K.ROUTE_REASONS["block"]}'
      WHEN va = 'review' THEN '{K.ROUTE_REASONS["review"]}' ELSE '{K.ROUTE_REASONS["allow"]}' END
      AS reasoning, b AND va IS NULL AS fallback_used, va IS NOT NULL AS enhanced FROM routed)"""


def routed(spark, sf):
    """Workflow decisions; broken answers count as failed."""
    rows = documents(spark, sf).select("doc_id", "text", fixture_score().alias("score"))
    parsed = answers(spark, sf).withColumn("s", fixture_score())
    v = parse(parsed, "raw", "s", "v")
    action = F.when(F.col("v.enhanced"), F.col("v.action"))
    return D.route_workflow(rows, v.select("doc_id", action.alias("action")))


SQL_LOGGED = "(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 500))"
SQL_LOGGED_AT = B.sql_stamp(SQL_LOGGED)


def logged(spark, sf):
    """Workflow decisions with a time and an execution."""
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") % 500).cast("int"))
    return (
        routed(spark, sf)
        .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hours)
        .withColumn("execution_id", F.concat(F.lit("run-"), F.col("doc_id").cast("string")))
    )


@query("route_workflow", f"WITH {SQL_ROUTED} SELECT * EXCLUDE text FROM workflow")
def route_workflow(spark, sf):
    return routed(spark, sf).drop("text")


@query(
    "decision_log",
    f"""WITH {SQL_ROUTED} SELECT doc_id, 'run-' || doc_id AS execution_id,
      substr(text, 1, 100) AS text_preview, score AS ml_score, action, confidence, reasoning,
      enhanced, {SQL_LOGGED_AT} AS ts, strftime({SQL_LOGGED}, '%Y-%m-%d') AS day FROM workflow""",
)
def decision_log(spark, sf):
    log = D.decision_log(logged(spark, sf), columns=["doc_id"])
    return log.withColumn("ts", B.stamp("ts")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "blocked_alerts",
    f"""WITH {SQL_ROUTED} SELECT doc_id, '{K.ALERT_SUBJECT}' AS subject, reasoning AS message
    FROM workflow WHERE final_decision = 'BLOCKED'""",
)
def blocked_alerts(spark, sf):
    return D.blocked_alerts(routed(spark, sf), ["doc_id"])


@query(
    "result_lines",
    f"""SELECT doc_id, CASE WHEN s > 0.5::DOUBLE THEN 'TOXIC' ELSE 'SAFE' END || ' ('
      || printf('%.1f%%', s * 100) || ') - ' || CASE WHEN abs(s - 0.5::DOUBLE) > 0.3::DOUBLE
      THEN 'HIGH' ELSE 'MEDIUM' END || ' confidence' || chr(10) || '   Text: "'
      || CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END || '"' AS line
    FROM (SELECT doc_id, text, {B.SQL_SCORE} AS s FROM documents)""",
)
def result_lines(spark, sf):
    rows = documents(spark, sf).withColumn("score", fixture_score())
    return rows.select("doc_id", D.format_result_line().alias("line"))


@query(
    "result_json",
    f"""SELECT doc_id, text, s AS toxicity_score, s > 0.5::DOUBLE AS is_toxic, 'success' AS status
    FROM (SELECT doc_id, text, {B.SQL_SCORE} AS s FROM documents)""",
)
def result_json(spark, sf):
    """Results written as JSON and read back."""
    rows = documents(spark, sf).withColumn("score", fixture_score())
    out = rows.select("doc_id", D.format_result_json().alias("j"))
    schema = "text STRING, toxicity_score DOUBLE, is_toxic BOOLEAN, status STRING"
    return out.select("doc_id", F.from_json("j", schema).alias("r")).select("doc_id", "r.*")
