"""Requests in, answers out: the four hooks of a model server as one plan.

Bodies are decoded into texts, texts are scored as rows of their own, and the scores go back
to their request in order, as one answer in the format it asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.payload import decoded_bytes, format_scores, payload_texts


def request_rows(
    requests: DataFrame, key: str = "request_id", body: str = "body", content_type: str = "content_type",
    accept: str = "accept", mode: str = "lines",
) -> DataFrame:
    """(key, accept, position, text): one row per text of every request; a request without texts has one without."""
    raw = decoded_bytes(body) if dict(requests.dtypes)[body] == "binary" else F.col(body)
    texts = payload_texts("__body", content_type, mode)
    rows = requests.withColumn("__body", raw).withColumn("__texts", texts)
    return rows.select(key, F.col(accept).alias("accept"), F.posexplode_outer("__texts").alias("position", "text"))


def answer_requests(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "request_id", **names: str
) -> DataFrame:
    """key, n_texts and body (the answer) of every request; ``score`` adds the column score to rows with a text.

    ``key`` names one request each.  Only key, position and score are shuffled, never a text; the
    scores of a request are put in the order of its texts.  A text that got no score is null in a
    JSON answer and empty in a CSV one, so the others keep their places.
    """
    rows = request_rows(requests, key, **names)
    scored = score(rows).select(key, "accept", "position", F.col("score").cast("double").alias("score"))
    has_text = F.col("position").isNotNull()
    ordered = F.sort_array(F.collect_list(F.when(has_text, F.struct("position", "score"))))
    # one row per request before and after: the format is the same in all its rows
    answers = scored.groupBy(key).agg(F.first("accept").alias("accept"), ordered.alias("__s"))
    scores = F.transform("__s", lambda s: s["score"])
    return answers.select(key, F.size("__s").alias("n_texts"), format_scores(scores, "accept").alias("body"))
