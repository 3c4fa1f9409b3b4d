"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are word n-grams of two readings of a text: the words as they stand, lower-cased,
and their shapes, in which runs of letters of one case and runs of digits are one mark and
everything else stays.  A feature's value is its share of the n-grams, so long and short
texts weigh alike, and a score is a mean of weights: a sparse dot product taken straight
from the hashes.

Training takes a bounded sample of the labelled rows (SAMPLE, chosen by hash), dealt into
shards.  Each shard runs FTRL-proximal over its rows, coordinate by coordinate, and the
shards' weights are averaged.  The model's size is that of the hash space.

Null and empty texts score by the intercept; rows without label are not learnt from; a
text with several labels is learnt with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textwarden.llm.words import Hasher, mixed, pieces

SPACE = 1 << 18  # hash buckets; the intercept follows them
SAMPLE = 20_000  # labelled rows learnt from, at most
SHARDS = 8
EPOCHS = 8
SCALE = 16.0  # of the features' shares
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3


def _shapes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with every run of letters or digits cut to one mark, and the texts' new cuts."""
    c = _SHAPE[data]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != c[:-1]) | (c[1:] > 3)
    keep[cuts[(cuts < len(c))]] = True
    return c[keep], np.r_[0, np.cumsum(keep)][cuts]


def feature_rows(texts: pa.Array, hasher: Hasher) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of every text, with repeats."""
    for _, data, cuts in pieces(texts):
        words, begin = hasher.words(data, cuts)
        marks, at = hasher.words(*_shapes(data, cuts))
        # both readings have the same words; n-grams across texts are cut off below
        kinds = [_bucket(words, 1), _bucket(_pairs(words), 2), _bucket(marks, 3), _bucket(_pairs(marks), 4)]
        kinds.append(_bucket(_pairs(_pairs(marks)), 5))
        same = np.full(max(0, len(words) - 1), 6, np.uint64)  # a word said twice
        kinds.append(_bucket(np.where(words[1:] == words[:-1], same, same + np.uint64(1)), 6))
        short = (0, 1, 0, 1, 2, 1)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield np.concatenate([k[a : max(a, b - s)] for k, s in zip(kinds, short)])


def _pairs(h: np.ndarray) -> np.ndarray:
    return h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:] if len(h) > 1 else h[:0]


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(h + np.uint64(kind)) & np.uint64(SPACE - 1)).astype(np.int64)


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (label, buckets, values) rows in their order; the weights."""
    z, n, w = (np.zeros(SPACE + 1) for _ in range(3))
    for _ in range(epochs):
        for label, at, x in rows:
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))
            g = (p - label) * x
            old = np.sqrt(n[at])
            n[at] += g * g
            new = np.sqrt(n[at])
            z[at] += g - (new - old) / ALPHA * w[at]
            zi = z[at]
            w[at] = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + new) / ALPHA + L2))
    return w


def features(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and values of every text; the intercept comes last."""
    for b in feature_rows(texts, hasher):
        at, n = np.unique(b, return_counts=True)
        yield np.r_[at, SPACE], np.r_[n * (SCALE / max(1, len(b))), 1.0]


def sample(labelled: DataFrame, key: str, label: str) -> DataFrame:
    """(key, y): at most SAMPLE labelled rows, chosen by a hash of the key."""
    rows = labelled.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(key).alias("__key"), (F.col(label) > 0).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("__key"), "__key", "y").limit(SAMPLE)


def train(docs: DataFrame, key: str, text: str, labelled: DataFrame, label_key: str, label: str) -> np.ndarray:
    """Weights of all buckets and the intercept."""
    chosen = F.broadcast(sample(labelled, label_key, label))  # at most SAMPLE narrow rows
    kept = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(chosen, F.col("__id") == F.col("__key"))
    order = F.xxhash64(F.col("__id"), F.lit("order"))
    kept = kept.select(F.pmod(order, F.lit(SHARDS)).cast("int").alias("shard"), order.alias("at"), "y", "text")

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("y", "ascending"), ("text", "ascending")])
        labels = table.column("y").to_pylist()
        texts = table.column("text").combine_chunks()
        w = learn([(y, *f) for y, f in zip(labels, features(texts, Hasher()))])
        at = np.flatnonzero(w)
        # and a row that says that this shard has learnt
        return pa.table({"bucket": pa.array(np.r_[-1, at]), "w": pa.array(np.r_[1.0, w[at]])})

    parts = kept.groupBy("shard").applyInArrow(shard, "bucket long, w double")
    rows = parts.groupBy("bucket").agg(F.sum("w").alias("w")).toArrow()  # SPACE + 2 at most
    buckets, sums = rows.column("bucket").to_numpy(), rows.column("w").to_numpy()
    w, own = np.zeros(SPACE + 1), buckets >= 0
    # shards without a labelled row have learnt nothing, and say nothing
    w[buckets[own]] = sums[own] / max(1.0, sums[~own].sum())
    return w


def score(docs: DataFrame, key: dict[str, str], text: str, weights: np.ndarray) -> DataFrame:
    """Columns ``key`` (new name: column) and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.select(*[F.col(c).alias(n) for n, c in key.items()], F.col(text).alias("__text"))
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(), shared.value
        for batch in batches:
            dots = [w[b].mean() if len(b) else 0.0 for b in feature_rows(batch.column(width), hasher)]
            logit = np.clip(np.array(dots) * SCALE + w[SPACE], -35, 35)
            cols = [*batch.columns[:width], pa.array(1 / (1 + np.exp(-logit)), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:width], "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:width], *StructType.fromDDL("score double").fields]))
