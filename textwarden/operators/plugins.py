"""Scorers and reviewers that live outside Spark, run per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

CALL_ROWS = 500  # texts of one call, and of what is held beside Spark's own batch


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark's batches, cut; only a piece's texts become Python strings, one piece at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, CALL_ROWS):
            yield batch.slice(start, CALL_ROWS)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def score_partitions(
    df: DataFrame, load: Callable[[], Callable[[pd.Series], Iterable]], text: str = "text"
) -> DataFrame:
    """Add ``score`` and ``error`` from a scorer that is loaded once per partition.

    ``load`` returns a function from a batch of texts to its scores.  A batch
    that fails is halved; a text that fails alone gets no score and an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for piece in _pieces(batches):
            got = _call(scorer, _column(piece, text).to_pandas(), "score")
            score = pa.Array.from_pandas(pd.Series(got["score"]), type=pa.float64())
            error = pa.array(got["error"], pa.string())
            yield pa.RecordBatch.from_arrays([*piece.columns, score, error], [*piece.schema.names, "score", "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join([*fields, "score DOUBLE", "error STRING"]))


def ask_reviewer(
    requests: DataFrame,
    load: Callable[[], Callable[[pd.Series], Iterable]] | Sequence[Callable[[], Callable[[pd.Series], Iterable]]],
    key: str = "doc_id",
) -> DataFrame:
    """Raw answers to rendered review requests, NULL with an error where none came.

    ``load`` is one reviewer or a list of them in order: the next is asked for
    what the one before could not answer.  ``reviewer`` is the place in the list
    of the one that answered; the error is that of the last one asked.
    """
    loads = list(load) if isinstance(load, Sequence) else [load]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reviewers = [one() for one in loads]
        for batch in batches:
            prompts = batch["prompt"].reset_index(drop=True)
            raw, error, by = [None] * len(prompts), [None] * len(prompts), [None] * len(prompts)
            left = list(range(len(prompts)))
            for place, reviewer in enumerate(reviewers):
                said = _call(reviewer, prompts[left], "raw") if left else {"raw": [], "error": []}
                for i, answer, problem in zip(left, said["raw"], said["error"]):
                    raw[i], error[i], by[i] = answer, problem, place if answer is not None else None
                left = [i for i in left if raw[i] is None]
            yield batch[[key]].assign(raw=raw, error=error, reviewer=pd.array(by, dtype="Int32"))

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, "prompt").mapInPandas(
        run, f"`{key}` {kind}, raw STRING, error STRING, reviewer INT"
    )


def _call(fn: Callable[[pd.Series], Iterable], texts: pd.Series, name: str) -> dict:
    """Results and errors of a batch.  A batch that fails is halved until its bad texts are alone.

    So one bad text costs a few smaller calls, not one call per text.  A result
    of None is an error too.
    """
    values, errors = [], []
    todo = [texts]
    while todo:
        part = todo.pop()
        try:
            got = list(fn(part))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} texts")
        except Exception as e:
            if len(part) > 1:
                half = len(part) // 2
                todo += [part.iloc[half:], part.iloc[:half]]
                continue
            got, problems = [None] * len(part), [str(e) or type(e).__name__] * len(part)
        else:
            problems = ["no result" if v is None else None for v in got]
        values += got
        errors += problems
    return {name: values, "error": errors}
