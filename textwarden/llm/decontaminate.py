"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item leaks into a document if enough of the item's distinct shingles stand in the
document.  The search follows LSH Ensemble (Zhu et al., 2016): documents are partitioned
by size, and in each partition the containment threshold becomes a Jaccard threshold for
the partition's largest size, which says how many MinHash values must be compared to miss
a pair with a chance of MISS at most.

*   Documents are first cut down to shingles that some item may have, by a bit table of
    fixed size.  That changes no containment, and it makes a long document as small as
    what it shares with the benchmark.
*   Documents with the same remaining shingles are searched once.
*   Where a document partition is so much larger than an item that more than BANDS values
    would be needed, the shingles themselves are compared: an item gives as many as it
    may lack and one more, so none is missed.

Whatever the search finds is verified on whole shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.store import by_batch, sliced, stored
from textwarden.llm.words import Hasher, distinct, list_array, mixed, shingle_rows

TABLE_BITS = 24  # size of the bit table of benchmark shingles, as a power of two
BANDS = 128  # MinHash values of a set
MISS = 1e-9  # chance that a pair over the threshold shares none of them


def item_sets(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(item_id, tokens, n) of all items that have a word."""
    kept = items.select(F.col(key).alias("item_id"), F.col(text).alias("__text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [distinct(h) for h in shingle_rows(batch.column(1), width, Hasher())]
        return pa.RecordBatch.from_arrays([batch.column(0), list_array(rows)], ["item_id", "tokens"])

    sets = by_batch(kept, make, f"item_id {kept.schema['item_id'].dataType.simpleString()}, tokens array<long>")
    return sets.withColumn("n", F.size("tokens")).filter("n > 0")


def bit_table(items: DataFrame) -> np.ndarray:
    """True where the low bits of some item's shingle point; 2**TABLE_BITS entries."""
    slot = F.col("t").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bits = items.select(F.explode("tokens").alias("t")).select(
        F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(t & 63 AS INT))").alias("bit")
    )
    words = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(TABLE_BITS - 6) rows at most
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def remaining(docs: DataFrame, key: str, text: str, width: int, table: np.ndarray) -> DataFrame:
    """(doc_id, set_key, tokens): the shingles that items may have, of the documents that have any."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, maybe, mask = Hasher(), np.unpackbits(shared.value).view(bool), np.int64((1 << TABLE_BITS) - 1)
        for batch in sliced(batches):
            at, keys, rows = [], [], []
            for i, h in enumerate(shingle_rows(batch.column(1), width, hasher)):
                t = distinct(h[maybe[h & mask]])
                if len(t):
                    at.append(i)
                    keys.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                    rows.append(t)
            if rows:
                ids = batch.column(0).take(pa.array(at))
                cols = [ids, pa.array(keys, pa.binary()), list_array(rows)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "set_key", "tokens"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, set_key binary, tokens array<long>")


def bands(upper: int, n: int, percent: int) -> int:
    """MinHash values to compare between sets of at most ``upper`` and an item of ``n`` shingles.

    Containment c of the item means a Jaccard similarity of at least c / (upper / n + 1 - c).
    """
    c = percent / 100
    s = min(1.0, c / (upper / n + 1 - c))
    return 1 if s >= 1 else math.ceil(math.log(MISS) / math.log(1 - s))


def plan(sizes: list[int], percent: int, largest: int) -> tuple[dict[int, int], dict[int, dict[int, int]]]:
    """What each document partition (power of two) compares.

    The first map gives the MinHash values its documents need, the second per item size
    class the values the items need; 0 stands for comparing shingles.
    """
    docs, items = {}, {}
    for p in range(largest + 1):
        need = {}
        for q in sizes:
            # items of class q have 2**q shingles at least, and cannot leak into much smaller sets
            if (1 << q) * percent <= (1 << p) * 100:
                b = bands(1 << p, 1 << q, percent)
                need[q] = b if b <= BANDS else 0
        docs[p], items[p] = max(need.values(), default=0), need
    return docs, items


def minhashes(tokens: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` hash functions over a set."""
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at : at + 4096].view(np.uint64)
        out = np.minimum(out, mixed(part[:, None] ^ seeds[None, :]).min(axis=0))
    return out.view(np.int64)


def probes(sets: DataFrame, key: str, wanted) -> DataFrame:
    """(key, part, band, value) rows: what a set shows in the partitions it takes part in.

    ``wanted(n)`` lists (part, MinHash values, shingles); band -1 holds shingles.
    """
    kept = sets.select(key, "tokens")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, part, band, value = [], [], [], []
        offsets = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy()
        for i in range(batch.num_rows):
            t = flat[offsets[i] : offsets[i + 1]]
            shows = wanted(len(t))
            sketch = minhashes(t, max((m for _, m, _ in shows), default=0))
            for p, m, k in shows:
                value += [sketch[:m], t[:k]]
                band += [np.arange(m, dtype=np.int32), np.full(k, -1, np.int32)]
                part.append(np.full(m + k, p, np.int32))
                at.append(np.full(m + k, i))
        if not at:
            return None
        ids = batch.column(0).take(pa.array(np.concatenate(at)))
        cols = [ids, *(pa.array(np.concatenate(c)) for c in (part, band, value))]
        return pa.RecordBatch.from_arrays(cols, [key, "part", "band", "value"])

    kind = kept.schema[key].dataType.simpleString()
    return by_batch(kept, make, f"{key} {kind}, part int, band int, value long")


def leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    width: int = 5, percent: int = 80,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every row and item whose containment reaches the threshold.

    A text of fewer words than a shingle is one shingle; texts without words leak nowhere.
    Rows without id are found too; repeated rows and items are listed as often as they stand.
    """
    sets = stored(item_sets(items, item_key, item_text, width), "items")
    # an item with all its copies is searched once
    one = sets.withColumn("item_key", F.sha2(F.concat_ws(",", "tokens"), 256))
    unique = stored(one.groupBy("item_key").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n")), "items")
    rest = stored(remaining(docs, key, text, width, bit_table(unique)), "leak-rows")
    classes = stored(rest.groupBy("set_key").agg(F.first("tokens").alias("tokens")), "leak-sets")
    log2 = lambda c: F.ceil(F.log2(F.size(c))).cast("int")
    largest = classes.agg(F.max(log2("tokens"))).first()[0]
    sizes = sorted(r[0] for r in unique.select(F.floor(F.log2("n")).cast("int")).distinct().collect())  # 31 at most
    by_doc, by_item = plan(sizes, percent, -1 if largest is None else largest)

    def of_doc(n: int) -> list[tuple[int, int, int]]:
        p = (n - 1).bit_length()
        return [(p, by_doc[p], n if 0 in by_item[p].values() else 0)] if by_item[p] else []

    def of_item(n: int) -> list[tuple[int, int, int]]:
        q, lacks = n.bit_length() - 1, n - (n * percent + 99) // 100
        return [(p, by_item[p][q], 0 if by_item[p][q] else lacks + 1) for p in by_item if q in by_item[p]]

    found = (
        probes(classes, "set_key", of_doc).join(probes(unique, "item_key", of_item), ["part", "band", "value"])
        .select("set_key", "item_key").distinct()
    )
    found = found.join(classes, "set_key").join(
        unique.select("item_key", F.col("tokens").alias("item_tokens"), F.col("n").alias("n_item")), "item_key"
    )
    shared = F.size(F.array_intersect("tokens", "item_tokens"))
    found = found.select("set_key", "item_key", shared.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
    found = found.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return (
        rest.select("doc_id", "set_key").join(found, "set_key").join(one.select("item_id", "item_key"), "item_key")
        .select("doc_id", "item_id", "n_shared", "n_item")
    )


def clean(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, **how) -> DataFrame:
    """The rows of ``docs`` into which no item leaks; rows that share an id go together.

    Rows are matched by their id; a row without id goes if another one without id leaks.
    """
    found = leaks(docs, key, text, items, item_key, item_text, **how).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stored(found, "leaks"), F.col(key).eqNullSafe(F.col("__id")), "left_anti")
