"""Request, payload, response and outcome columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions._base import col
from textwarden.functions.scores import number
from textwarden.functions.text import strip_space


def request_text(raw: Column | str) -> Column:
    """Text of a request: in ``body`` (a JSON string or an object) or at the top level.

    A request without text, or whose text is no string, gives the empty text.
    """
    raw = col(raw)
    body = F.get_json_object(raw, "$.body")
    inner = F.when(body.isNull(), raw).otherwise(body)
    # read as a variant, which keeps the kind of a value: only strings are texts
    value = F.try_variant_get(F.try_parse_json(inner), "$.text", "variant")
    is_text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(True))
    return F.coalesce(F.when(is_text, F.get_json_object(inner, "$.text")), F.lit(""))


def request_metadata(raw: Column | str) -> Column:
    """Metadata of a request as a map of strings, NULL where there is none."""
    raw = col(raw)
    body = F.get_json_object(raw, "$.body")
    inner = F.when(body.isNull(), raw).otherwise(body)
    return F.from_json(F.get_json_object(inner, "$.metadata"), "map<string,string>")


def payload_texts(body: Column | str, content_type: Column | str, mode: str = "single") -> Column:
    """Texts in a request body as an array, by content type.

    ``single`` takes a CSV body as one text; ``lines`` takes one text per
    non-empty line and turns a JSON object without text into its own JSON.
    """
    if mode not in ("single", "lines"):
        raise ValueError(f"unknown mode: {mode}")
    b, kind = col(body), col(content_type)
    is_array = F.json_array_length(b).isNotNull()
    items = F.from_json(b, "array<string>")
    text = F.get_json_object(b, "$.text")
    has_text = F.array_contains(F.json_object_keys(b), "text")
    is_object = F.json_object_keys(b).isNotNull()
    scalar = F.get_json_object(b, "$")
    if mode == "single":
        csv = F.array(strip_space(b))
        obj = F.array(F.when(has_text, text).otherwise(F.lit("")))
        other = F.array(b)
    else:
        lines = F.transform(F.split(b, "\n"), strip_space)
        csv = F.filter(lines, lambda x: x != "")
        obj = F.array(F.when(has_text, text).otherwise(scalar))
        other = F.array(strip_space(b))
    as_json = F.when(is_array, items).when(is_object, obj).otherwise(F.array(scalar))
    return F.when(kind == "text/csv", csv).when(kind == "application/json", as_json).otherwise(other)


def decoded_bytes(body: Column | str) -> Column:
    """A binary body as UTF-8 text."""
    return F.decode(col(body), "UTF-8")


def parse_score_response(c: Column | str) -> Column:
    """Score from ``[s]``, ``{"predictions": [s]}`` or ``s``; NULL where there is no finite number."""
    c = col(c)
    text = F.coalesce(
        F.get_json_object(c, "$[0]"), F.get_json_object(c, "$.predictions[0]"), strip_space(c)
    )
    return number(text.try_cast("double"))


def format_scores(scores: Column | str, accept: Column | str) -> Column:
    """An array of scores as JSON, or comma-joined where CSV is asked for.

    A single score is written without brackets.  A missing one keeps its place: null in JSON,
    nothing between the commas.
    """
    s = col(scores)
    as_text = F.transform(s, lambda x: x.cast("string"))
    joined = F.array_join(as_text, ",", "")
    listed = F.concat(F.lit("["), F.array_join(as_text, ", ", "null"), F.lit("]"))
    as_json = F.when(F.size(s) == 1, F.coalesce(as_text[0], F.lit("null"))).otherwise(listed)
    return F.when(col(accept) == "text/csv", joined).otherwise(as_json)


def classify_request(
    text: Column | str,
    cleaned: Column | str,
    max_len: int | None = None,
    min_len: int = K.MIN_SCORED_LENGTH,
) -> Column:
    """What happens to a request: rejected, too short to score, or scored."""
    t, cl = col(text), col(cleaned)
    out = F.when(F.coalesce(t, F.lit("")) == "", "invalid_empty")
    if max_len is not None:
        out = out.when(strip_space(t) == "", "invalid_empty")
        out = out.when(F.length(strip_space(t)) > max_len, "invalid_too_long")
    return (
        out.when(cl == "", "empty_after_clean")
        .when(F.length(strip_space(cl)) < min_len, "too_short")
        .otherwise("scored")
    )
