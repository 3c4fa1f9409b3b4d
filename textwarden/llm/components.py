"""Connected components of a large graph by alternating large and small stars.

Every round moves each node's neighbours to its smallest neighbour; a node with many
neighbours costs one row per neighbour, no more.  Rounds grow with the logarithm of the
longest chain (Kiveris et al., Connected Components in MapReduce and Beyond, 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.store import discard, stored


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v): every v of a node u is tied to the smallest of u and its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its smallest node.

    Nodes without a link to another are not listed.  Null ends are left out.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = before = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        if before is not None:
            discard(before)
        seen, before = state, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: only larger neighbours move to the smallest
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = stored(_star(large), "edges")
