"""Training, cross-validation, evaluation and registration of the text classifier.

The model is a pipeline of built-in stages, so fitting and scoring stay in the
JVM: tokens, stop words, n-grams, counts over a fixed vocabulary, idf weights,
length normalisation, logistic regression.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import evaluate as E
from textwarden.operators import quality as Q
from textwarden.operators import registry as R
from textwarden.operators import splits as X
from textwarden.operators import terms as TM
from textwarden.plans.stages import Stages, table_fingerprint
from textwarden.session import fresh_path, materialized
from textwarden.sources import sinks
from textwarden.sources.files import read_registry
from textwarden.sources.folders import read_text, remove, write_text

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
PART_BYTES = 32 << 20  # of vectors that a task of a fit has
ENTRY_BYTES = 12  # of a vector: a place and a value
BLOCK_MB = 0.25  # of vectors that a fit caches, or reads back from disk, in one object


@dataclass(frozen=True)
class Settings:
    """Model settings; balanced, min_df and max_df make the stricter variant."""

    max_features: int = 10000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 1
    max_df: float = 1.0
    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4
    balanced: bool = False
    folds: int = 5
    fits_at_once: int = 3
    seed: int = 42
    stop_words: tuple[str, ...] = field(default=K.STOP_WORDS, repr=False)


BALANCED = Settings(min_df=2, max_df=0.95, balanced=True)


def _word_stages(s: Settings, text: str) -> list:
    """Stages from a text to its words that are no stop words."""
    return [
        RegexTokenizer(
            inputCol=text, outputCol="__words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True
        ),
        StopWordsRemover(inputCol="__words", outputCol="__kept", stopWords=list(s.stop_words)),
    ]


def _term_stages(s: Settings) -> list:
    """Stages from the words of a text to its array of terms."""
    stages: list = []
    lo, hi = s.ngram_range
    grams = ["__kept"] if lo == 1 else []
    for n in range(max(lo, 2), hi + 1):
        stages.append(NGram(n=n, inputCol="__kept", outputCol=f"__n{n}"))
        grams.append(f"__n{n}")
    stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(grams)}) AS __terms FROM __THIS__"))
    return stages


def _counting(spark: SparkSession, terms: Iterable[str], counts: str = "__counts") -> CountVectorizerModel:
    """The stage that counts the terms of a collected vocabulary.

    It is fitted on one row that holds the vocabulary, which hands it over in one piece.
    """
    terms = list(terms)
    listed = spark.createDataFrame([(terms,)], "__terms ARRAY<STRING>")
    return CountVectorizer(vocabSize=len(terms), inputCol="__terms", outputCol=counts).fit(listed)


def _weighting(counting: CountVectorizerModel, vocab: list) -> list:
    """Stages from counts to the normalised tf-idf vector of a vocabulary.

    The idf weights follow the order that the counting stage chose; a term it counts that is
    not in the vocabulary weighs nothing.
    """
    idf = {r["term"]: r["idf"] for r in vocab}
    weights = Vectors.dense([idf.get(t, 0.0) for t in counting.vocabulary])
    return [
        ElementwiseProduct(scalingVec=weights, inputCol="__counts", outputCol="__weighted"),
        Normalizer(p=2.0, inputCol="__weighted", outputCol="features_vector"),
    ]


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt evenly over the tasks, however the table's files are cut.

    Cutting texts into terms costs far more than moving them.
    """
    return rows.repartition(key)


@contextmanager
def _folder(spark: SparkSession):
    """A way to store tables that are read many times, as files that go at the end."""
    path = fresh_path(spark, "training-tables")
    try:
        yield lambda df, name: sinks.stored(df, f"{path}/{name}")
    finally:
        remove(spark, path)


def _words(rows: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """The rows, dealt evenly, with their words instead of the text, and a number of their own."""
    words = PipelineModel(_word_stages(s, text)).transform(_spread(rows, key))
    others = [c for c in rows.columns if c != text]
    return words.select(F.monotonically_increasing_id().alias("__row"), *others, "__kept")


def _fold_stats(terms: DataFrame, s: Settings) -> DataFrame:
    """Term and document frequency of every term, in all and per fold, in one shuffle.

    ``terms`` has the terms of each text as the pipeline cut them.
    """
    counted = TM.counted_terms(terms, ["fold"], "__terms")
    per_fold = [
        agg
        for i in range(s.folds)
        for agg in (
            F.sum(F.when(F.col("fold") == i, F.col("tf")).otherwise(0)).alias(f"tf_{i}"),
            F.count_if(F.col("fold") == i).alias(f"df_{i}"),
        )
    ]
    sums = counted.filter("term IS NOT NULL").groupBy("term").agg(*per_fold)
    whole = lambda c: reduce(lambda a, b: a + b, [F.col(f"{c}_{i}") for i in range(s.folds)])
    return sums.select("*", whole("tf").alias("tf"), whole("df").alias("df"))


def _vocabulary(stats: DataFrame, n_docs: int, s: Settings, without: int | None = None) -> list:
    """The vocabulary of all rows, or of all but one fold; max_features rows at most."""
    if without is not None:
        stats = stats.select(
            "term",
            (F.col("tf") - F.col(f"tf_{without}")).alias("tf"),
            (F.col("df") - F.col(f"df_{without}")).alias("df"),
        ).filter("df > 0")
    top = TM.vocabulary(stats, n_docs, s.max_features, s.min_df, s.max_df)
    return top.select("term", "df", TM.smooth_idf(F.lit(n_docs), F.col("df")).alias("idf")).collect()


def _fit(
    counted: DataFrame, counting: CountVectorizerModel, vocab: list, classes: dict, label: str, s: Settings
) -> list:
    """The weighting stages with the regression fitted on rows that have their counts.

    ``classes`` has the number of rows of each class.
    """
    n = sum(classes.values())
    # every iteration is a job over all partitions: let their number follow the vectors' size
    parts = math.ceil(sum(r["df"] for r in vocab) * ENTRY_BYTES / PART_BYTES)
    dealt = counted.select("__row", label, "__counts").repartition(max(1, parts), "__row")
    stages = _weighting(counting, vocab)
    vectors = PipelineModel(stages).transform(dealt)
    lr = LogisticRegression(
        featuresCol="features_vector",
        labelCol=label,
        regParam=1.0 / (s.c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=s.max_iter,
        tol=s.tol,
        family="binomial",
        maxBlockSizeInMB=BLOCK_MB,
    )
    if s.balanced:
        weight = reduce(
            lambda w, kv: w.when(F.col(label) == kv[0], n / (2.0 * kv[1])), classes.items(), F
        )
        vectors, lr = vectors.withColumn("__weight", weight), lr.setWeightCol("__weight")
    return [*stages, lr.fit(vectors.select(label, "features_vector", *(["__weight"] if s.balanced else [])))]


def _class_sizes(rows: DataFrame, label: str, *by: str) -> list:
    return rows.groupBy(label, *by).agg(F.count("*").alias("n")).collect()


def _predict(stages: list, rows: DataFrame) -> DataFrame:
    out = PipelineModel(stages).transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "pred", F.col("prediction").cast("int")
    )


def train_classifier(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "comment_text",
    label: str = "toxic",
    settings: Settings = Settings(),
) -> tuple[PipelineModel, DataFrame]:
    """The model fitted on all rows and one row of metrics per fold.

    Texts are cut into words once and counted once, both stored as files; the
    vocabularies of all folds come from one aggregation.  Only vocabularies and
    coefficients, max_features entries each, reach the driver.
    """
    s, spark = settings, df.sparkSession
    rows = df.select(key, text, F.col(label).cast("int").alias(label))
    threaded = inheritable_thread_target(spark)
    with _folder(spark) as stored, ThreadPool(s.fits_at_once) as pool:
        # the given rows are read once; folds and all that follows come from the files
        words = stored(_words(rows, key, text, s), "words")
        folded = X.stratified_folds(words, label, key, s.folds, s.seed)
        terms = PipelineModel(_term_stages(s)).transform(folded)
        stats = stored(_fold_stats(terms, s), "stats")
        sizes = _class_sizes(folded, label, "fold")
        wanted = [*range(s.folds), None]

        def classes_without(fold: int | None) -> dict:
            found: dict = {}
            for r in sizes:
                if r["fold"] != fold:
                    found[r[label]] = found.get(r[label], 0) + r["n"]
            return found

        def vocabulary_without(fold: int | None) -> list:
            return _vocabulary(stats, sum(classes_without(fold).values()), s, fold)

        vocabs = dict(zip(wanted, pool.map(threaded(vocabulary_without), wanted)))
        # the texts are counted once for all folds, by the terms of any, and once for the final model
        of_folds = sorted({r["term"] for i in range(s.folds) for r in vocabs[i]})
        counting = {i: c for c in [_counting(spark, of_folds)] for i in range(s.folds)}
        counting[None] = _counting(spark, [r["term"] for r in vocabs[None]])
        both = PipelineModel([counting[0], counting[None].copy().setOutputCol("__final")]).transform(terms)
        vectors = stored(both.select("__row", label, "fold", "__counts", "__final"), "vectors")

        def fit_without(fold: int | None) -> list:
            if fold is None:
                train = vectors.select("__row", label, F.col("__final").alias("__counts"))
            else:
                train = vectors.filter(F.col("fold") != fold)
            return _fit(train, counting[fold], vocabs[fold], classes_without(fold), label, s)

        # the fits are independent jobs, some at a time; each caches its own vectors
        *fitted, final = pool.map(threaded(fit_without), wanted)
        parts = [_predict(m, vectors.filter(F.col("fold") == i)) for i, m in enumerate(fitted)]
        tested = reduce(DataFrame.unionByName, [p.select("fold", label, "pred", "score") for p in parts])
        # one row per fold; storing them frees the tables
        metrics = materialized(E.binary_metrics(tested, label, "pred", "score", ["fold"]))
    return PipelineModel([*_word_stages(s, text), *_term_stages(s), counting[None], *final]), metrics


def train_with_holdout(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "comment_text",
    label: str = "toxic",
    settings: Settings = BALANCED,
    test_size: float = 0.2,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Model of all rows, fold metrics of the training part, holdout predictions.

    A first model is fitted and cross-validated on the training part and scored
    on the rest; the second one is fitted on all rows.  The split rows are stored in the
    shared folder, where the predictions are read from.
    """
    split = X.stratified_split(df.select(key, text, label), label, key, test_size, settings.seed)
    split = sinks.stored(split, fresh_path(df.sparkSession, "split"))
    train = split.filter("split = 'train'").drop("split")
    first, metrics = train_classifier(train, key, text, label, settings)
    held = score_texts(first, split.filter("split = 'test'"), text)
    return fit_all(split, key, text, label, settings), metrics, held


def fit_all(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "comment_text",
    label: str = "toxic",
    settings: Settings = Settings(),
) -> PipelineModel:
    """The model fitted on all rows, without cross-validation."""
    s, spark = settings, df.sparkSession
    rows = df.select(key, text, F.col(label).cast("int").alias(label))
    with _folder(spark) as stored:
        words = stored(_words(rows, key, text, s), "words")
        terms = PipelineModel(_term_stages(s)).transform(words)
        classes = {r[label]: r["n"] for r in _class_sizes(words, label)}
        n = sum(classes.values())
        vocab = _vocabulary(TM.term_stats(TM.counted_terms(terms, [], "__terms"), n), n, s)
        counting = _counting(spark, [r["term"] for r in vocab])
        final = _fit(counting.transform(terms), counting, vocab, classes, label, s)
    return PipelineModel([*_word_stages(s, text), *_term_stages(s), counting, *final])


def score_texts(model: PipelineModel, df: DataFrame, text: str = "comment_text") -> DataFrame:
    """Add ``score``, ``pred`` and ``error``, batch or stream; a NULL text has only the error.

    The row travels as one column, so no stage can touch its other columns.
    """
    source = _flat(model)[0].getInputCol()
    packed = df.select(F.struct("*").alias("__row"), F.coalesce(text, F.lit("")).alias(source))
    out = _predict([model], packed)
    known = F.col("__row")[text].isNotNull()
    return out.select(
        "__row.*",
        F.when(known, F.col("score")).alias("score"),
        F.when(known, F.col("pred")).alias("pred"),
        F.when(~known, "no text").alias("error"),
    )


def model_terms(model: PipelineModel) -> tuple[DataFrame, float]:
    """Vocabulary, idf and coefficients of a model as a table, and its intercept."""
    spark = SparkSession.builder.getOrCreate()
    stages = _flat(model)
    vocab = next(s for s in stages if isinstance(s, CountVectorizerModel)).vocabulary
    idf = next(s for s in stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray()
    lr = stages[-1]
    rows = list(zip(vocab, map(float, idf), map(float, lr.coefficients.toArray())))
    return spark.createDataFrame(rows, "term STRING, idf DOUBLE, weight DOUBLE"), float(lr.intercept)


def _flat(model: PipelineModel) -> list:
    return [x for s in model.stages for x in (_flat(s) if isinstance(s, PipelineModel) else [s])]


def evaluate_model(model: PipelineModel, df: DataFrame, text: str, label: str) -> dict[str, DataFrame]:
    """Accuracy, classification report and confusion matrix of a labelled table.

    The texts are scored once: all three come from the stored counts.
    """
    counts = materialized(E.label_counts(score_texts(model, df, text), label, "pred"))
    return {
        "accuracy": E.accuracy_of(counts),
        "report": E.report_of(counts),
        "confusion": E.confusion_of(counts),
    }


def run_training(
    spark: SparkSession,
    train: DataFrame,
    test: DataFrame,
    out: str,
    key: str = "doc_id",
    settings: Settings = Settings(),
    min_accuracy: float = 0.8,
    min_rows: int = 100,
) -> DataFrame:
    """Validate, train, evaluate and register; returns the gate row.

    Each stage runs only after the one before succeeded, and reads what that one wrote.  All
    results are written below ``out``: validation, model, folds, metrics, evaluation, registry.
    A run that was stopped goes on with the stage that was not finished; a run with other
    tables or settings repeats the stages that depend on them, see Stages.
    """
    return Training(spark, train, test, out, key, settings, min_accuracy, min_rows).run()


class Training:
    """The stages of a training run; ``ran`` has the names of those that were not done before."""

    def __init__(
        self,
        spark: SparkSession,
        train: DataFrame,
        test: DataFrame,
        out: str,
        key: str = "doc_id",
        settings: Settings = Settings(),
        min_accuracy: float = 0.8,
        min_rows: int = 100,
    ):
        self.spark, self.out, self.key, self.settings = spark, out.rstrip("/"), key, settings
        self.given, self.min_accuracy, self.min_rows = {"train": train, "test": test}, min_accuracy, min_rows
        self.text, self.label = Q.REQUIRED
        self.stages = Stages(spark, self.out)

    @property
    def ran(self) -> list[str]:
        return self.stages.ran

    def run(self) -> DataFrame:
        settings, stages = asdict(self.settings), self.stages
        prints = {name: table_fingerprint(df) for name, df in self.given.items()}
        stages.run("validate", self._validate, min_rows=self.min_rows, **prints)
        stages.run("fit", self._fit, train=prints["train"], key=self.key, settings=settings)
        stages.run("evaluate", self._evaluate, after=("fit",), test=prints["test"], min_accuracy=self.min_accuracy)
        stages.run("register", self._register, after=("evaluate",))
        return self._gate()

    def _cleaned(self, name: str) -> DataFrame:
        return Q.clean_labelled(self.given[name])

    def _validate(self) -> None:
        report = Q.validation_report(self.given, self.min_rows)
        sinks.write_report(report, f"{self.out}/validation_report")
        verdict = self.spark.read.schema(report.schema).json(f"{self.out}/validation_report").first()
        if not verdict["validation_passed"]:
            raise ValueError(f"validation failed: {list(verdict['issues'])}")

    def _fit(self) -> None:
        model, folds = train_classifier(self._cleaned("train"), self.key, self.text, self.label, self.settings)
        sinks.save_model(model, f"{self.out}/model")
        sinks.write_table(folds, f"{self.out}/folds")

    def _evaluate(self) -> None:
        model, folds = sinks.load_model(f"{self.out}/model"), self.spark.read.parquet(f"{self.out}/folds")
        cv = E.cv_summary(folds, METRICS).filter("metric = 'accuracy'")
        tested = evaluate_model(model, self._cleaned("test"), self.text, self.label)
        trained = E.accuracy(score_texts(model, self._cleaned("train"), self.text), self.label, "pred")
        weighted = tested["report"].filter(F.col("class") == "weighted avg")
        row = E.one_row(
            tested["accuracy"].select("accuracy"),
            weighted.select("precision", "recall", F.col("f1").alias("f1_score")),
            cv.select(F.col("mean").alias("cv_mean_accuracy"), F.col("std_pop").alias("cv_std_accuracy")),
            trained.select(F.col("accuracy").alias("train_accuracy")),
        )
        gate = E.evaluation_gate(row, self.min_accuracy)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gate.schema)
        sinks.write_report(gate, f"{self.out}/evaluation")
        write_text(self.spark, f"{self.out}/evaluation_schema", schema)
        long = E.metrics_long(self._gate(), ("accuracy", "precision", "recall", "f1_score", "cv_mean_accuracy"))
        sinks.write_report(long, f"{self.out}/metrics")
        sinks.write_report(tested["report"], f"{self.out}/classification_report")
        sinks.write_report(tested["confusion"], f"{self.out}/confusion_matrix")

    def _gate(self) -> DataFrame:
        schema = read_text(self.spark, f"{self.out}/evaluation_schema")
        return self.spark.read.schema(schema).json(f"{self.out}/evaluation")

    def _register(self) -> None:
        """Append the package once: one that this evaluation has led to already is not appended again."""
        of_run = self.stages.prints["evaluate"]
        known = read_registry(self.spark, f"{self.out}/registry")
        if not known.filter(F.col("payload")["fingerprint"] == of_run).isEmpty():
            return
        used = {k: str(v) for k, v in asdict(self.settings).items() if k != "stop_words"}
        payload = F.create_map(
            *[F.lit(x) for kv in used.items() for x in kv],
            F.lit("model_path"), F.lit(f"{self.out}/model"),
            F.lit("accuracy"), F.col("accuracy").cast("string"),
            F.lit("recommendation"), F.col("recommendation"),
            F.lit("fingerprint"), F.lit(of_run),
        )
        now = F.current_timestamp().cast("timestamp_ntz")
        package = R.register_model(self._gate(), F.lit(self.out.rsplit("/", 1)[-1]), now, payload)
        sinks.append_registry(package, f"{self.out}/registry")
