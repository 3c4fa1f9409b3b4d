"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are whole numbers here, so that products are exact.  They are grouped by length
into buckets, and buckets into blocks of bounded size; queries into blocks as well.

1.  Every query is scored against a few blocks, those of the longest vectors first.  Its
    k-th best score there bounds its final k-th score from below.
2.  A bucket of largest length l needs a cosine of at least bound / (|query| * l).  Where
    that is over 1 the whole bucket is pruned for the query, before anything is shipped.
3.  In each other block a query takes its candidates by length (the vectors at least
    bound / |query| long) or by coordinate (in the query's largest coordinate, the interval
    that the local cosine threshold allows), whichever leaves fewer, and their products
    are verified.  The k best of each block meet in the last step.

Null vectors and vectors with null or non-finite components take no part.  Vectors of
other lengths are filled up with zeros.  Rows without id take no part.  (LEMP: Teflioudi,
Gemulla, Mykytiuk, 2015.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.store import stored

BLOCK = 4096  # vectors of a block
QUERY_BLOCK = 512
PER_OCTAVE = 4  # length buckets of a doubling
EXACT = 2.0**53  # whole numbers below it are exact in floating point
COORDINATE = 0.3  # local cosine threshold from which on a coordinate is looked at, besides the length
SLACK = 1e-9  # bounds are taken a little too wide, so that rounding prunes nothing


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where a component is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale))
    return F.when(F.col(vector).isNotNull() & ~bad, whole)


def in_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Adds bucket (by length) and block (at most about ``size`` vectors); ``vectors``: id, v."""
    length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.withColumn("length", F.sqrt(length2))
    bucket = F.when(F.col("length") > 0, F.floor(F.log2("length") * PER_OCTAVE)).otherwise(F.lit(-1)).cast("int")
    rows = stored(rows.withColumn("bucket", bucket), "vectors")
    # one row per bucket: at most PER_OCTAVE per binary digit of a length
    counts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(counts), "bucket")
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows, filled up with zeros."""
    column = column.combine_chunks()
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), max(sizes, default=0)), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where no partial sum can leave its exact range."""
    width = min(rows.shape[1], len(query))
    rows, query = rows[:, :width], query[:width]
    if not width or not len(rows):
        return np.zeros(len(rows), np.int64)
    top = float(np.abs(rows).max()) * float(np.abs(query).astype(float).sum())
    if top < EXACT:
        return (rows.astype(float) @ query.astype(float)).astype(np.int64)
    wide = rows.astype(object) @ query.astype(object)
    return np.array([min(max(x, 1 - 2**63), 2**63 - 1) for x in wide], np.int64)


def candidates(lengths: np.ndarray, unit: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray | slice:
    """Rows that may reach the bound.  ``lengths`` fall; ``unit``: the rows over their lengths."""
    norm = float(np.sqrt((query.astype(float) ** 2).sum()))
    if not np.isfinite(bound) or bound <= 0 or not norm or not len(lengths):
        return slice(None)
    end = int(np.searchsorted(-lengths, -(bound / norm) * (1 - SLACK), "right"))
    t = min(1.0, bound / (norm * lengths[0]) * (1 - SLACK))
    f = int(np.abs(query).argmax())
    if t < COORDINATE or f >= unit.shape[1]:
        return slice(0, end)
    # the angles to the axis of f differ by at most the angle that the threshold allows
    own, wide = np.arccos(np.clip(query[f] / norm, -1, 1)), np.arccos(t)
    low, high = np.cos(min(np.pi, own + wide)) - SLACK, np.cos(max(0.0, own - wide)) + SLACK
    return np.flatnonzero((unit[:end, f] >= low) & (unit[:end, f] <= high))


def best_of_block(k: int):
    """The k best of a block for each query of a query block: query, id, score."""

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if queries.num_rows and vectors.num_rows:
            lengths = vectors.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            rows, lengths = _matrix(vectors.column("v"))[order], lengths[order]
            ids = vectors.column("id").to_numpy()[order]
            unit = rows / np.maximum(lengths, 1e-300)[:, None]
            asked, bounds = _matrix(queries.column("v")), queries.column("bound").to_numpy(zero_copy_only=False)
            for qid, q, bound in zip(queries.column("id").to_pylist(), asked, bounds):
                at = candidates(lengths, unit, q, float(bound))
                scores, names = products(rows[at], q), ids[at]
                other = names != qid
                scores, names = scores[other], names[other]
                top = np.lexsort((names, -scores))[:k]
                out_q += [qid] * len(top)
                out_id += names[top].tolist()
                out_s += scores[top].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()),
                         "score": pa.array(out_s, pa.int64())})

    return run


def _matched(queries: DataFrame, vectors: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Best rows per query and block, for the (query, bucket, block) rows of ``targets``.

    A group holds one block of vectors and one block of queries, both of bounded size.
    """
    asked = targets.join(queries, "id").select("id", "v", "bound", "query_block", "bucket", "block")
    pairs = targets.join(queries.select("id", "query_block"), "id").select("query_block", "bucket", "block").distinct()
    shown = vectors.join(pairs, ["bucket", "block"]).select("id", "v", "length", "query_block", "bucket", "block")
    keys = ["query_block", "bucket", "block"]
    return (
        asked.groupBy(*keys).cogroup(shown.groupBy(*keys))
        .applyInArrow(best_of_block(k), "query_id long, id long, score long")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score: the k largest inner products per query, ties to the smaller id.

    ``vectors`` and ``queries``: id long, v array<long>.  A query is not its own answer.
    Repeated ids are repeated candidates; of several queries with one id one is asked.
    """
    rows = stored(in_blocks(vectors.filter("id IS NOT NULL AND v IS NOT NULL"), BLOCK), "vector-blocks")
    # at most a few hundred rows per million vectors: what the pruning looks at
    blocks = stored(rows.groupBy("bucket", "block").agg(F.max("length").alias("longest"), F.count("*").alias("n")), "blocks")
    asked = queries.filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    count = asked.count()
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // QUERY_BLOCK)))).cast("int"))
    length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = stored(asked.withColumn("norm", F.sqrt(length2)), "queries")
    none = F.lit(float("-inf"))
    # a block of the longest vectors gives every query its first bound
    first = blocks.filter(F.col("n") > k).orderBy(F.desc("longest"), "bucket", "block").select("bucket", "block").first()
    at = first or (None, None)
    seeds = asked.select("id", F.lit(at[0]).cast("int").alias("bucket"), F.lit(at[1]).cast("int").alias("block"))
    seeded = stored(_matched(asked.withColumn("bound", none), rows, seeds, k), "seeded")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = seeded.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
    bounds = kth.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound"))
    asked = stored(asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", none)), "bounded")
    # the stated query set against the blocks of all buckets that can reach its bound
    lengths = blocks.groupBy("bucket").agg(F.max("longest").alias("longest")).collect()  # PER_OCTAVE per octave
    known = [F.struct(F.lit(b).alias("bucket"), F.lit(x).alias("longest")) for b, x in sorted(lengths)]
    known = F.array(*known) if known else F.array().cast("array<struct<bucket:int,longest:double>>")
    reached = F.filter(known, lambda b: F.col("norm") * b["longest"] * (1 + SLACK) >= F.col("bound"))
    targets = asked.select("id", F.explode(reached).alias("b")).select("id", "b.bucket")
    targets = targets.join(blocks.select("bucket", "block"), "bucket")
    found = _matched(asked, rows, targets, k)
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id"), "score")
