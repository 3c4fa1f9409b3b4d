"""The corpus pipeline: documents through five stages, each written before the next reads it.

1.  Language: documents that no learned language, and no mixture of them, explains go.
2.  Near duplicates: the smallest id of each group of five-word shingle sets that are alike
    to four fifths or more stays.
3.  Decontamination: documents that hold a benchmark item go.
4.  Secrets: live credentials are replaced by a mark; copied examples stay.
5.  Mixture: of sources, languages and topics with more than their target share, documents
    are drawn; the others are kept whole.

Every stage returns the columns of documents.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import textwarden
from textwarden.llm import decontaminate, jaccard, language, mixing, secrets
from textwarden.llm.store import release, stored, written
from textwarden.sources.files import read_table

# functions that run in Python workers travel with the task, wherever the driver was started
cloudpickle.register_pickle_by_value(textwarden)


EVIDENCE = 20.0
FOREIGN = 0.9


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows of which no language can be told: texts that are null or have no letter, and
    those that no mixture of languages explains: less likely under the best one, by e to the
    EVIDENCE, than under a background in which all n-grams are alike, and with FOREIGN of it
    or more going to the background when that is offered beside the languages.

    The model learns from all labelled rows of the input; without any it rejects nothing else.
    """
    model = language.train(docs, "text", "lang")
    names = {f"__{i}": n for i, n in enumerate(docs.columns)}
    told = language.identify(docs, names, "text", model)
    known = ~F.col("lang_pred").eqNullSafe(F.lit(language.UNKNOWN))
    explained = F.coalesce(F.col("gain") >= -EVIDENCE, F.lit(True)) | (F.col("foreign") < FOREIGN)
    return told.filter(known & explained).select(*[F.col(i).alias(n) for i, n in names.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document whose id names its group; of rows repeated under one id, one.

    Rows without words are in no group and stay, as do rows without id.
    """
    before = set(written())
    groups = jaccard.jaccard_join(docs, "doc_id", "text")
    gone = stored(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    # what the join has written on its way is not needed any more
    release(spark, [path for path in written() if path not in before and path != gone.stored_at])
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = kept.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    twice = stored(twice, "repeated-ids")
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents into which a benchmark item leaks."""
    return decontaminate.clean(docs, "doc_id", "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live credentials in the texts; n_chars follows."""
    clean = secrets.redact(docs, "doc_id", "text", owner="source", repo="lang")
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").contains(secrets.MARK), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def to_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by probabilities for the size at which no value exceeds its target share of all."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of("text")}
    return mixing.mixed_sample(docs, "doc_id", "text", dims, cells_of=mixing.sized_cells).select(*docs.columns)


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixture", to_target_mix),
]

#: Training and components are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
