"""Fitted weights meet their targets; the draw follows them."""

import pytest
from pyspark.sql import functions as F

from textwarden.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, lang string, weight string, tokens string, p string"


def docs_of(spark, n):
    rows = [
        (i, "w " * (1 + i % 40), "hot" if i % 3 == 0 else f"s{i % 7}", ("en", "de", None)[i * i % 5 % 3], "a", "b", "c")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


DIMS = {"source": F.col, "lang": F.col}


def dims():
    return {n: c(n) for n, c in DIMS.items()}


def test_marginals_meet_their_targets(spark):
    docs = docs_of(spark, 3000)
    sums = docs.groupBy("source", "lang").agg(F.sum(M.token_weight("text")).alias("tokens"))
    targets = {d: M.tempered(sums, d, 0.5) for d in DIMS}
    fitted = M.rake(sums, targets, sweeps=30)
    assert M.residual(fitted, targets) < 1e-9
    assert abs(fitted.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    cells = M.inclusion(fitted, 0.5).collect()
    assert max(c["p"] for c in cells) <= 1 and min(c["p"] for c in cells) > 0
    # the expected sample has the target mix
    kept = sum(c["p"] * c["tokens"] for c in cells)
    for value, share in {r["value"]: r["share"] for r in targets["lang"].collect()}.items():
        assert abs(sum(c["p"] * c["tokens"] for c in cells if c["lang"] == value) / kept - share) < 1e-6


def test_given_targets_and_missing_ones(spark):
    sums = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 60), ("b", "y", 0), ("c", "x", 5)],
                                 "source string, lang string, tokens long")
    share = lambda rows: spark.createDataFrame(rows, "value string, share double")
    targets = {"source": share([("a", 0.6), ("b", 0.4), ("none", 9.0)]), "lang": share([("x", 0.7), ("y", 0.3)])}
    got = {(r["source"], r["lang"]): r["weight"] for r in M.rake(sums, targets, 40).collect()}
    assert got[("c", "x")] == 0 and got[("b", "y")] == 0
    assert abs(got[("a", "y")] - 0.3) < 1e-6 and abs(got[("b", "x")] - 0.4) < 1e-6 and abs(got[("a", "x")] - 0.3) < 1e-6


def test_sample_follows_the_probabilities(spark):
    docs = docs_of(spark, 6000)
    kept = M.mixed_sample(docs, "doc_id", "text", dims(), cells_of=M.calibrated_cells)
    assert kept.columns == docs.columns
    narrow = docs.select(*[c.alias(n) for n, c in dims().items()], M.token_weight("text").alias("tokens"))
    cells = M.calibrated_cells(narrow.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    expected = M.with_chance(docs, dims(), cells).agg(F.sum("__p")).first()[0]
    assert abs(kept.count() - expected) < 5 * expected**0.5
    again = M.mixed_sample(docs.union(docs), "doc_id", "text", dims(), sweeps=4)  # repeated rows go together
    assert again.count() == 2 * again.distinct().count()


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "a", "en"), (2, "x " * 50_000, "a", "en"), (2, "x " * 50_000, "a", "en")]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert M.mixed_sample(df, "doc_id", "text", dims()).filter("text IS NULL").count() == 0
    none = M.mixed_sample(df.limit(0), "doc_id", "text", dims())
    assert none.count() == 0 and none.columns == df.columns
    assert M.mixed_sample(df.filter("text IS NULL"), "doc_id", "text", dims()).count() == 0


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" a\tb c\x1fd ", 2), ("a", 1)])
def test_token_weight(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(M.token_weight("t")).first()[0] == n


def test_a_rare_cell_costs_the_others_nothing(spark):
    cells = [("hot", l, 40_000 // k) for k, l in ((1, "en"), (4, "de"))]
    cells += [(f"s{i}", l, 3000 + 100 * i) for i in range(6) for l in ("en", "de")]
    rare = [*cells, ("rare", "de", 5)]
    kept = []
    for rows in (cells, rare):
        got = M.sized_cells(spark.createDataFrame(rows, "source string, lang string, tokens long"), sweeps=4).collect()
        total = sum(r["tokens"] for r in got)
        kept.append(sum(r["p"] * r["tokens"] for r in got) / total)
        assert all(0 < r["p"] <= 1 for r in got)
        by = {(r["source"], r["lang"]): r["p"] for r in got}
        assert by[("hot", "en")] < 0.9  # the one with more than its share
    assert kept[0] > 0.6 and abs(kept[0] - kept[1]) < 0.01
    assert by[("rare", "de")] == 1


def test_given_size_and_what_stays_unequal(spark):
    rows = [("a", "x", 100), ("a", "y", 900), ("b", "x", 700), ("b", "y", 200), ("c", "x", 5), ("c", None, 0)]
    sums = spark.createDataFrame(rows, "source string, lang string, tokens long")
    for size in (300, 10_000):
        got = M.sized_cells(sums, alpha=0.0, size=size, sweeps=2).collect()
        assert abs(sum(r["weight"] for r in got) - min(size, 1905)) < 1e-6
        assert all(abs(r["weight"] - r["p"] * r["tokens"]) < 1e-4 for r in got)
    # equal shares of a and b are met beside c, which has less than a third
    got = M.sized_cells(sums, alpha=0.0, size=1200, sweeps=12).collect()
    of = lambda d, v: sum(r["weight"] for r in got if r[d] == v)
    assert of("source", "c") > 4.999 and abs(of("source", "a") - 597.5) < 0.5 and abs(of("lang", "x") - 600) < 0.5
    # equal sources need no draw
    even = spark.createDataFrame([("a", "x", 50), ("b", "x", 50)], "source string, lang string, tokens long")
    assert [r["p"] for r in M.sized_cells(even, sweeps=2).collect()] == [1.0, 1.0]


def test_sized_draw_follows_the_probabilities(spark):
    docs = docs_of(spark, 6000)
    kept = M.mixed_sample(docs, "doc_id", "text", dims(), cells_of=M.sized_cells, sweeps=4)
    assert kept.columns == docs.columns and kept.count() > 0.8 * docs.count()
    none = M.mixed_sample(docs.limit(0), "doc_id", "text", dims(), cells_of=M.sized_cells, sweeps=1)
    assert none.count() == 0


def test_one_document_of_a_new_source_changes_next_to_nothing(spark):
    docs = docs_of(spark, 3000).withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("text")))
    new = spark.createDataFrame([(9999, "five words are in it", "new", "en", "a", "b", "c")], SCHEMA)
    shares = []
    for rows in (docs, docs.union(new)):
        tokens = M.token_weight("text")
        kept = M.mixed_sample(rows, "doc_id", "text", dims(), sweeps=4)
        shares.append(kept.agg(F.sum(tokens)).first()[0] / rows.agg(F.sum(tokens)).first()[0])
    assert abs(shares[0] - shares[1]) < 0.01 and shares[0] > 0.5
