"""Fixed schemas of the tables the engine reads and writes."""

LABELLED = "comment_text STRING, toxic INT"
REQUEST = "text STRING, metadata MAP<STRING,STRING>"
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING"
)
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
METRIC = "ts TIMESTAMP_NTZ, name STRING, value DOUBLE, unit STRING, dims MAP<STRING,STRING>"
REGISTRY = (
    "kind STRING, name STRING, payload MAP<STRING,STRING>, status STRING, ts TIMESTAMP_NTZ"
)
STEP_EVENT = (
    "step STRING, status STRING, failure_reason STRING, ts TIMESTAMP_NTZ, event_id BIGINT"
)
