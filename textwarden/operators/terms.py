"""Terms of texts, their statistics, TF-IDF weights and linear scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.functions.text import ngrams, tokens


def text_terms(
    df: DataFrame,
    text: str,
    n: tuple[int, int] = (1, 2),
    stop_words: Iterable[str] = K.STOP_WORDS,
) -> DataFrame:
    """Add ``terms``: the n-grams of each text without stop words."""
    with_tokens = df.withColumn("__tokens", tokens(text, stop_words))
    return with_tokens.withColumn("terms", ngrams("__tokens", n)).drop("__tokens")


def doc_terms(
    df: DataFrame,
    key: str,
    text: str,
    n: tuple[int, int] = (1, 2),
    stop_words: Iterable[str] = K.STOP_WORDS,
    keep: Iterable[str] = (),
    by_key: bool = False,
) -> DataFrame:
    """One row per document and term with its count ``tf`` and the kept columns.

    The terms of a text are sorted and counted inside the row, so no shuffle is
    needed.  A text without terms gives one row with a NULL term.

    ``by_key`` is for a plan that reads the table twice: the texts are shuffled by
    their key once they are counted, one row each.  Spark does equal shuffles of a
    plan once, so the texts are cut once, and a window by key needs no other one.
    """
    keys = [key, *keep]
    counts = term_counts(text_terms(df.select(*keys, text), text, n, stop_words), keys, "terms")
    if by_key:
        # joined, and in order, the terms take half the space; none of them holds a line end
        counts = counts.withColumn("__term", F.array_join("__term", "\n")).repartition(key)
        counts = counts.withColumn("__term", F.split("__term", "\n"))
    return _term_rows(counts, keys)


def counted_terms(df: DataFrame, keys: Iterable[str], terms: str) -> DataFrame:
    """One row per text and distinct term of an array of terms, with its count ``tf``."""
    keys = list(keys)
    return _term_rows(term_counts(df, keys, terms), keys)


def term_counts(df: DataFrame, keys: Iterable[str], terms: str) -> DataFrame:
    """Each text with its distinct terms in order, ``__term``, and their counts, ``__tf``."""
    keys = list(keys)
    rows = df.select(*keys, F.sort_array(terms).alias("__t"))
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("__t"), F.lit(1))),
        lambda i: (i == 1) | (F.get("__t", i - 1) != F.get("__t", i - 2)),
    )
    rows = rows.select(*keys, "__t", F.when(F.size("__t") > 0, starts).alias("__s"))
    ends = F.concat(F.slice("__s", F.lit(2), F.size("__s")), F.array(F.size("__t") + 1))
    return rows.select(
        *keys,
        F.transform("__s", lambda a: F.get("__t", a - 1)).alias("__term"),
        F.zip_with("__s", ends, lambda a, b: b - a).alias("__tf"),
    )


def _term_rows(counts: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.arrays_zip(F.col("__term").alias("term"), F.col("__tf").alias("tf"))
    rows = counts.select(*keys, F.inline_outer(pairs).alias("term", "tf"))
    return rows.withColumn("tf", F.col("tf").cast("bigint"))


def term_stats(terms: DataFrame, n_docs: int) -> DataFrame:
    """Corpus frequency, document frequency and smoothed idf of every term.

    The input has one row per document and term, so one count per term is its
    document frequency: no distinct, one shuffle of pre-summed rows.
    """
    return (
        terms.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        .withColumn("idf", smooth_idf(F.lit(int(n_docs)), F.col("df")))
    )


def smooth_idf(n_docs: Column, df: Column) -> Column:
    one = F.lit(1.0)
    return F.log((n_docs + one) / (df + one)) + one


def vocabulary(
    stats: DataFrame, n_docs: int, max_features: int = 10000, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """The most frequent terms within the document-frequency limits, ties by term."""
    within = (F.col("df") >= min_df) & (F.col("df") <= float(max_df) * n_docs)
    return stats.filter(within).orderBy(F.desc("tf"), F.asc("term")).limit(max_features)


def first_features(vocab: DataFrame, k: int = 100) -> DataFrame:
    """The first terms in alphabetical order."""
    return vocab.select("term").orderBy("term").limit(k)


def tfidf(terms: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """Length-normalised tf * idf per document and vocabulary term.

    The vocabulary has at most max_features rows; the window by document needs
    one shuffle of the terms that are left, or none where they lie by document.
    """
    known = terms.join(vocab.select("term", "idf"), "term")
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))
    return known.select(key, "term", "tf", (raw / norm).alias("weight"))


def score_linear(
    terms: DataFrame, key: str, coefficients: DataFrame, intercept: float = 0.0
) -> DataFrame:
    """Probability of a linear model over normalised tf-idf, per document.

    ``coefficients`` has term, idf and weight.  Product and length are summed in
    one aggregation that shuffles one partial row per document; a text without
    known terms gets the probability of the intercept.
    """
    joined = terms.join(coefficients.select("term", "idf", "weight"), "term", "left")
    raw = F.col("tf") * F.col("idf")
    sums = joined.groupBy(key).agg(
        F.sum(raw * F.col("weight")).alias("__dot"), F.sum(raw * raw).alias("__sq")
    )
    margin = F.coalesce(F.col("__dot") / F.sqrt("__sq"), F.lit(0.0)) + F.lit(float(intercept))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return sums.select(key, score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


def log_odds(terms: DataFrame, label: str, n_docs: int) -> DataFrame:
    """Smoothed log-odds of every term between the two classes, with its idf.

    ``terms`` is a doc_terms table that kept the label: labels join the texts
    before these are cut into terms, not after.
    """
    of_class = lambda v: F.sum(F.when(F.col(label) == v, F.col("tf")).otherwise(0)) + F.lit(1.0)
    return (
        terms.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            F.sum("tf").alias("tf"),
            F.count("*").alias("df"),
            F.log(of_class(1) / of_class(0)).alias("weight"),
        )
        .withColumn("idf", smooth_idf(F.lit(int(n_docs)), F.col("df")))
    )
