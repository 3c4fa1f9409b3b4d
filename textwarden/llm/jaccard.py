"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters.

A document is the set of its distinct word shingles.  Two documents link if the sizes of
their sets' intersection and union have at least the given ratio.

1.  Equal sets form a class; its smallest document stands for it from then on.
2.  Shingles are ordered rare first: the most frequent ones of the corpus come last, by
    frequency, the others before them by hash.  Two sets that link share a shingle among
    their first ones (their prefix), so only prefixes are joined; of shingles that stand in
    exactly the same prefixes one is enough.
3.  A pair that meets must pass the length filter, the positional filter (what may still
    follow the shared shingle) and the suffix filter: the token space is cut into fixed
    bins, and every shingle that only one of the two sets has changes the parity of one
    bin, so the bins whose parity differs bound the symmetric difference from below.
    A short sketch of parities travels with the prefixes; pairs that pass it are held
    against sketches that grow with the sets, at a thirtieth of a set's size.
4.  Each remaining pair is verified once, on whole sets.

Linked documents need not all meet: documents of one component are not compared again.
So a round first compares every document of a shared shingle only with one hub, the
document whose prefix the others share most; a group of thousands of near copies is
joined by as many pairs as it has documents.  A last round then compares, for every shared
shingle, all documents that are still in different components.  Components are exact.

The order needs to be the same everywhere, nothing more: the table of frequent shingles
has a fixed size, and what it lacks costs time, not links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.components import components
from textwarden.llm.store import by_batch, discard, sliced, stored
from textwarden.llm.words import Hasher, distinct, list_array, shingle_rows

FREQUENT = 1 << 16  # shingles in the table of the frequent ones
PER_TASK = 1 << 14  # of these, candidates that one task names
AGAIN = 3  # occurrences among the rows of a task from which on a shingle is a candidate
BINS = 256  # whose parities make the sketch of a set, 64 to a number
SKETCH = tuple(f"s{i}" for i in range(BINS // 64))
PARITIES = 1  # bins per shingle, at least, of the sketches that grow with the sets
HUB_ROUNDS = 1
EARLY = 8  # shingles by which a pair that has met is known
SEMI_IDS = 1 << 20  # ids up to which the wanted texts are found by a broadcast; beyond, by a shuffle


def prefix_length(n: np.ndarray | int, percent: int):
    """Shingles of which two linking sets share at least one."""
    return n - (n * percent + 99) // 100 + 1


def frequent_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """The most frequent shingles of the corpus, rarest first; at most FREQUENT of them."""

    def most(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(values) > size:
            at = np.argpartition(counts, -size)[-size:]
            values, counts = values[at], counts[at]
        return values, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, times = Hasher(), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in sliced(batches):
            rows = list(shingle_rows(batch.column(0), width, hasher))
            values, counts = np.unique(np.concatenate(rows), return_counts=True)
            # what occurs once here and is not known yet is left out, or all of it would be kept
            keep = (counts > 1) | np.isin(values, known)
            values, where = np.unique(np.r_[known, values[keep]], return_inverse=True)
            counts = np.bincount(where, np.r_[times, counts[keep]], len(values)).astype(np.int64)
            known, times = most(values, counts, 4 * PER_TASK)
        known, times = most(known[times >= AGAIN], times[times >= AGAIN], PER_TASK)
        if len(known):
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(times)], ["token", "n"])

    counted = docs.select(text).mapInArrow(run, "token long, n long")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    tokens = top.toArrow().column("token").to_numpy()  # at most FREQUENT rows
    return tokens[::-1].copy()


def signatures(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, digest of the set, prefix in order, sketch (parity per bin of the token space)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, width))
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ranked = Hasher(), frequent.value
        by_value = np.argsort(ranked)
        sorted_ = ranked[by_value]
        maybe = np.zeros(1 << 20, bool)  # most shingles are ruled out by one look
        maybe[sorted_ & 0xFFFFF] = True
        for batch in sliced(batches):
            sizes, digests, prefixes, odd = [], [], [], []
            for h in shingle_rows(batch.column(1), width, hasher):
                t = distinct(h)
                n = len(t)
                sizes.append(n)
                digests.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                odd.append(np.bincount(t & (BINS - 1), minlength=BINS) & 1)
                heavy = maybe[t & 0xFFFFF]
                if heavy.any():
                    at = np.minimum(np.searchsorted(sorted_, t[heavy]), len(sorted_) - 1)
                    found = sorted_[at] == t[heavy]
                    heavy[heavy] = found
                    last = ranked[np.sort(by_value[at[found]])]
                    t = np.r_[t[~heavy], last]
                prefixes.append(t[: prefix_length(n, percent)] if n else t)
            sketch = np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 list_array(prefixes), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)],
                ["doc_id", "n", "digest", "prefix", *SKETCH],
            )

    kind = kept.schema["doc_id"].dataType.simpleString()
    sketch = ", ".join(f"{s} long" for s in SKETCH)
    return kept.mapInArrow(run, f"doc_id {kind}, n long, digest binary, prefix array<long>, {sketch}")


def sets_of(docs: DataFrame, key: str, text: str, width: int, ids: DataFrame) -> DataFrame:
    """(id, tokens, n, parity): the whole shingle sets of the wanted documents, from their texts."""
    kept = docs.select(F.col(key).alias("id"), F.col(text).alias("__text")).join(some(ids), "id", "left_semi")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [distinct(h) for h in shingle_rows(batch.column(1), width, Hasher())]
        cols = [batch.column(0), list_array(rows), pa.array([len(r) for r in rows], pa.int64()),
                pa.array([parity(r) for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["id", "tokens", "n", "parity"])

    kind = kept.schema["id"].dataType.simpleString()
    return by_batch(kept, make, f"id {kind}, tokens array<long>, n long, parity binary")


def parity(tokens: np.ndarray) -> bytes:
    """The parity of the number of shingles in every bin; the number of bins is a power of two."""
    bins = max(64, 1 << (len(tokens) * PARITIES - 1).bit_length())
    return np.packbits(np.bincount(tokens & (bins - 1), minlength=bins) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bins of different parity; the sketch with more bins is folded to those of the other."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches of their sets do not rule out."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        allowed = n - 2 * -(-n * percent // (100 + percent))
        off = [apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        return batch.select([0, 1]).filter(pa.array(np.array(off, np.int64) <= allowed))

    return by_batch(both, make, both.select("a", "b").schema)


def least_overlap(n: Column, percent: int) -> Column:
    """Common shingles that sets of n shingles together need to link."""
    return F.ceil(n * percent / (100 + percent))


def may_link(x: str, y: str, percent: int, sketch: bool) -> Column:
    """Length, positional and, with the sketch, suffix filter for a shared shingle; x and y say whose columns."""
    nx, ny, px, py = (F.col(f"{s}{c}") for c in ("n", "pos") for s in (x, y))
    least = least_overlap(nx + ny, percent)
    length = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    left = F.least(nx - px, ny - py)  # the shingle itself and what follows it
    if not sketch:
        return length & (left >= least)
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in SKETCH])
    return length & (left >= least) & (apart <= nx + ny - least * 2)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets (id, tokens, n, parity)."""
    near = stored(close(pairs, sets, percent), "jaccard-close")
    sets = sets.select("id", "tokens").join(some(ends(near)), "id", "left_semi")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    union = F.size("a_tokens") + F.size("b_tokens") - shared
    return both.filter(shared * 100 >= union * percent).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of the pairs, stored."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return stored(ids, "jaccard-ids")


def some(ids: DataFrame) -> DataFrame:
    """Ids to look for: sent to all tasks up to SEMI_IDS of them, beyond that met in a shuffle."""
    return F.broadcast(ids) if ids.limit(SEMI_IDS + 1).count() <= SEMI_IDS else ids


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Every document of a shared shingle with the shingle's hub, if their components differ."""
    rows = rows.drop("early", *SKETCH)
    carried = ("n", "pos", "component")
    first = F.max(F.struct("central", F.negate("id").alias("low"), *carried))
    hubs = rows.groupBy("token").agg(first.alias("h"))
    hubs = hubs.select("token", F.negate("h.low").alias("h_id"), *[F.col(f"h.{c}").alias(f"h_{c}") for c in carried])
    near = (F.col("component") != F.col("h_component")) & may_link("", "h_", percent, sketch=False)
    met = rows.drop("central").join(hubs, "token").filter(near)
    return met.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct()


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of two documents at a kept shingle that they share: in different components and past the filters.

    A pair that shares one of the shingles carried in ``early`` has met there and is passed over.
    """
    rows = rows.drop("central")
    new = ~F.arrays_overlap("x.early", "y.early")
    near = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    met = rows.alias("x").join(
        rows.alias("y"), (F.col("x.token") == F.col("y.token")) & near & may_link("x.", "y.", percent, sketch=True) & new
    )
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All documents of a shared shingle that are in different components and pass the filters."""
    return _meetings(rows, percent).distinct()


def posting_lists(rows: DataFrame) -> DataFrame:
    """(token, met, many): of the shingles that stand in exactly the same documents, the first in the order.

    ``rows`` has id, n, pos and token.  Shingles of one list bring the same pairs.  The first
    one has the smallest place in every document, so the filters let pass what they let pass
    for any other.  A list of at least two documents is named by its length and two 64-bit
    hashes of its documents, added up in halves that cannot overflow.
    """
    sums = {f"h{i}": F.xxhash64(*names) for i, names in enumerate((("id", "n"), ("n", "id")))}
    halves = [f(c).alias(f"{n}_{k}") for n, c in sums.items() for k, f in (
        ("hi", lambda c: F.sum(F.shiftright(c, 32))), ("lo", lambda c: F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF)))))]
    met = rows.groupBy("token").agg(F.count("*").alias("met"), F.sum("pos").alias("place"), *halves).filter("met > 1")
    name = [c for c in met.columns if c not in ("token", "place")]
    lists = met.groupBy(*name).agg(F.min_by("token", "place").alias("token"), F.count("*").alias("many"))
    return lists.select("token", "met", "many")


def shared_tokens(leaders: DataFrame) -> DataFrame:
    """(token, id, pos, n, sketch, early, central): prefix shingles that at least two documents have, one per posting list.

    ``early`` has the first of a document's shingles, EARLY at most, as far as they come before
    this one.  The filters let pass at an earlier shingle what they let pass at a later one, so
    two documents need not be compared where an earlier shingle is known to be in both.
    ``central`` is the part of a document's prefix that others share, in documents met per
    shingle; among near copies it is highest for the one the others were made from.
    """
    rows = leaders.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "token"))
    # most shingles stand in one document only: these go before anything wide is made of them
    met = rows.groupBy("token").agg(F.count("*").alias("met")).filter("met > 1").select("token")
    several = stored(rows.join(met, "token"), "jaccard-several")
    shared = stored(several.drop("n").join(posting_lists(several), "token"), "jaccard-shared")
    discard(several)
    of_doc = leaders.select(F.col("doc_id").alias("id"), "n", *SKETCH).dropDuplicates(["id"])
    own = shared.groupBy("id").agg(
        F.sum(F.col("met") * F.col("many")).alias("met"),
        F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, EARLY).alias("first"),
    )
    sums = own.join(of_doc, "id").select("id", "n", *SKETCH, "first", (F.col("met") / F.col("n")).alias("central"))
    rows = shared.drop("met", "many").join(sums, "id")
    early = F.transform(F.filter("first", lambda e: e["pos"] < F.col("pos")), lambda e: e["token"])
    out = stored(rows.withColumn("early", early).drop("first"), "jaccard-tokens")
    discard(shared)
    return out


def jaccard_components(leaders: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, component) of all class leaders that link with another."""
    tokens = shared_tokens(leaders)
    rows = tokens.withColumn("component", F.col("id"))
    groups = leaders.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).limit(0)
    links = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
    tested = None
    for step in range(HUB_ROUNDS + 1):
        pairs = (_hub_pairs if step < HUB_ROUNDS else _all_pairs)(rows, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "jaccard-candidates")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not pairs.isEmpty():
            ids = ends(pairs)
            sets = stored(sets_of(docs, key, text, width, ids), "jaccard-sets")
            groups = components(verified(pairs, sets, percent).unionByName(links))
            links = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
            discard(ids, sets)
        if step < HUB_ROUNDS:
            labelled = rows.drop("component").join(groups, "id", "left")
            labelled = labelled.withColumn("component", F.coalesce("component", "id"))
            # a shingle whose documents are all in one component has nothing left to compare
            open_ = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            rows = stored(labelled.join(open_.filter("lo < hi").select("token"), "token"), "jaccard-open")
            discard(tokens)
            tokens = rows
    discard(tokens)
    return groups


def classed(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures of all rows, the classes of equal sets (n, digest, leader) and their leaders' signatures."""
    rows = stored(signatures(docs, key, text, width, percent), "jaccard-docs")
    classes = rows.filter("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("leader"))
    classes = stored(classes.filter("leader IS NOT NULL"), "jaccard-classes")
    # the copies, which others stand for: fewer and narrower than the rows with their prefixes
    copies = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "digest").join(classes, ["n", "digest"])
    copies = copies.filter("doc_id <> leader").select("doc_id").distinct()
    copies = stored(copies.join(classes.select(F.col("leader").alias("doc_id")), "doc_id", "left_anti"), "jaccard-copies")
    leaders = rows.filter("n > 0 AND doc_id IS NOT NULL").join(some(copies), "doc_id", "left_anti")
    leaders = stored(leaders.select("doc_id", "n", "prefix", *SKETCH), "jaccard-leaders")
    return rows, classes, leaders


def jaccard_join(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links, itself included) per row.

    Rows without words have no shingle and link with nothing.  Rows without id take the
    component of their class if a row with an id shares it, else none.  Repeated rows link
    with each other; ids are taken to name one document each.
    """
    rows, classes, leaders = classed(docs, key, text, width, percent)
    groups = jaccard_components(leaders, docs, key, text, width, percent)
    discard(leaders)
    labelled = classes.join(groups, classes["leader"] == groups["id"], "left")
    labelled = labelled.select("n", "digest", F.coalesce("component", "leader").alias("component"))
    return rows.select("doc_id", "n", "digest").join(labelled, ["n", "digest"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def leader_links(leaders: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(a, b) with a < b: all pairs of class leaders that link, each candidate verified once."""
    tokens = shared_tokens(leaders)
    pairs = stored(_all_pairs(tokens.withColumn("component", F.col("id")), percent), "jaccard-candidates")
    discard(tokens)
    ids = ends(pairs)
    sets = stored(sets_of(docs, key, text, width, ids), "jaccard-sets")
    links = stored(verified(pairs, sets, percent), "jaccard-links")
    discard(ids, sets, pairs)
    return links


def members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(leader, doc_id) of every document that has words, its leader's own row included."""
    with_id = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "digest")
    return with_id.join(classes, ["n", "digest"]).select("leader", "doc_id").distinct()


def jaccard_pairs(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """All links as (a, b, kind): ``link`` between the leaders of two classes, a < b, and
    ``copy`` between the leader of a class and another document of it.

    Any two documents link if their leaders are the same or have a link; naming all of them
    would repeat a class's links for each of its copies.
    """
    rows, classes, leaders = classed(docs, key, text, width, percent)
    links = leader_links(leaders, docs, key, text, width, percent).withColumn("kind", F.lit("link"))
    copies = members(rows, classes).filter("leader <> doc_id")
    return links.unionByName(copies.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"), F.lit("copy").alias("kind")))


def link_counts(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and n_links (other documents with an id that it links with) per row.

    Rows without id have a count only if a row with an id shares their set.
    """
    rows, classes, leaders = classed(docs, key, text, width, percent)
    links = leader_links(leaders, docs, key, text, width, percent)
    sizes = stored(members(rows, classes).groupBy("leader").agg(F.count("*").alias("size")), "jaccard-sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(sizes.withColumnRenamed("leader", "b"), "b").groupBy("a").agg(F.sum("size").alias("met"))
    reach = sizes.join(met, sizes["leader"] == met["a"], "left")
    reach = reach.select("leader", (F.col("size") + F.coalesce("met", F.lit(0))).alias("reach"))
    labelled = classes.join(reach, "leader").select("n", "digest", "reach")
    own = F.col("doc_id").isNotNull().cast("long")
    return rows.select("doc_id", "n", "digest").join(labelled, ["n", "digest"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("reach") - own).cast("long").alias("n_links"),
    )
