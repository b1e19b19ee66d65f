"""Binary models on feature frames: preprocessing, split, training and evaluation with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.columns import hash_fraction, numeric_columns
from riskloom.functions.ordered import bracketed_quantiles, running_totals
from riskloom.operators.metrics import decision_metrics, ranking_metrics
from riskloom.session import materialise
from riskloom.settings import ModelJob

LABEL = "label"
# a text column of more distinct values is no category: every one of them would be held by the driver and tasks
MAX_CATEGORIES = 10_000
# features that also define the transaction label
LEAKING = ("source_is_alerted", "destination_is_alerted")


@dataclass(frozen=True)
class Preprocessor:
    """Median / mode imputation, scaling and one-hot encoding, fitted on training rows."""

    model: PipelineModel
    numeric: tuple[str, ...]
    categories: tuple[str, ...]
    modes: dict[str, str]
    medians: dict[str, float]

    def _typed(self, df: DataFrame) -> DataFrame:
        casts = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(self.medians[c])) for c in self.numeric}
        fills = {c: F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.categories}
        return df.withColumns({**casts, **fills})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._typed(df))


def fit_preprocessor(train: DataFrame, columns: Sequence[str]) -> Preprocessor:
    """An unknown category falls in the dropped slot of the encoder: all zeros."""
    typed = numeric_columns(train.select(*columns))
    text = [c for c in columns if c not in typed]
    medians, modes = exact_medians(train, typed), column_modes(train, text)
    stages = []
    parts = []
    if typed:
        stages += [
            VectorAssembler(inputCols=typed, outputCol="_numbers"),
            StandardScaler(withMean=True, withStd=True, inputCol="_numbers", outputCol="_scaled"),
        ]
        parts.append("_scaled")
    if text:
        indexed = [f"{c}__index" for c in text]
        encoded = [f"{c}__onehot" for c in text]
        stages += [
            StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
        parts += encoded
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    draft = Preprocessor(None, tuple(typed), tuple(text), modes, medians)
    fitted = Pipeline(stages=stages).fit(draft._typed(train))
    return Preprocessor(fitted, tuple(typed), tuple(text), modes, medians)


def exact_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The median of every numeric column, all columns in one pass; 0 where all is missing."""
    found = bracketed_quantiles(train, {c: [0.5] for c in columns})
    return {c: 0.0 if found[c][0] is None else found[c][0] for c in columns}


def column_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent text of every column (ties to the smaller), in one pass; "" where all is missing."""
    if not columns:
        return {}
    long = train.select(*columns).unpivot([], list(columns), "feature", "value").where("value IS NOT NULL")
    counts = materialise(long.groupBy("feature", "value").agg(F.count("*").alias("n")), "categories")
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    rows = counts.groupBy("feature").agg(best.alias("mode"), F.count("*").alias("values")).collect()  # one per column
    wide = {r["feature"]: r["values"] for r in rows if r["values"] > MAX_CATEGORIES}
    if wide:
        raise ValueError(f"too many distinct values for categories (at most {MAX_CATEGORIES}): {wide}")
    return dict.fromkeys(columns, "") | {r["feature"]: r["mode"] for r in rows}


def in_test(key: Column, settings: ModelJob = ModelJob()) -> Column:
    """Split by a seeded hash of the row key: every class is thinned by the same rate, nothing is
    shuffled, and a row stays on its side when data is added."""
    return hash_fraction(key, settings.seed, "split") < settings.test_size


def split(df: DataFrame, key: str, settings: ModelJob = ModelJob()) -> tuple[DataFrame, DataFrame]:
    test = in_test(F.col(key), settings)
    return df.where(~test), df.where(test)


def stratified_parts(
    df: DataFrame, key: str, *, label: str = LABEL, settings: ModelJob = ModelJob(), validation_size: float = 0.0
) -> DataFrame:
    """Adds ``part``: test, validation or train, with exact shares in every class.

    Rows of a class are ranked by the seeded hash of their key; the first ``test_size`` of them, rounded, are the
    test part, the next ``validation_size`` the validation part. The ranks are prefix sums over sliced hash values,
    so no task orders a whole class. Rows with equal keys stay together, at most that many rows off the share. Rows
    without a label are a class of their own.
    """
    rows = df.withColumn("_fraction", hash_fraction(F.col(key), settings.seed, "split"))
    counts = materialise(rows.groupBy(label, "_fraction").agg(F.count("*").alias("_n")), "fractions")
    totals = counts.groupBy(F.col(label).alias("_of")).agg(F.sum("_n").alias("_total"))
    upto = running_totals(counts, [label], "_fraction", ["_n"], stored=True).withColumnRenamed(label, "_class")
    placed = upto.join(totals, F.col("_class").eqNullSafe(F.col("_of")))
    test, later = settings.test_size, settings.test_size + validation_size
    part = F.when(F.col("_n_upto") <= F.round(F.col("_total") * test), "test")
    part = part.when(F.col("_n_upto") <= F.round(F.col("_total") * later), "validation").otherwise("train")
    parts = materialise(placed.select("_class", F.col("_fraction").alias("_place"), part.alias("part")), "parts")
    same = F.col(label).eqNullSafe(F.col("_class")) & (F.col("_fraction") == F.col("_place"))
    return rows.join(parts, same).drop("_fraction", "_class", "_place")


def with_class_weight(df: DataFrame, multiplier: float = 1.0, *, label: str = LABEL) -> DataFrame:
    """Weight 1 for negatives, negatives / positives * multiplier for positives."""
    ratio = df.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)), F.lit(1.0)))
    weighted = df.withColumn("_ratio", ratio.scalar())
    weight = F.when(F.col(label) == 1, F.col("_ratio") * multiplier).otherwise(1.0)
    return weighted.withColumn("class_weight", weight).drop("_ratio")


def logistic_regression(train_rows: int, settings: ModelJob = ModelJob(), weight: str | None = None):
    # L2 with inverse strength 1: the penalty is shared by all rows
    model = LogisticRegression(
        featuresCol="features",
        labelCol=LABEL,
        regParam=1.0 / max(train_rows, 1),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=settings.max_iter,
    )
    return model.setWeightCol(weight) if weight else model


def random_forest(settings: ModelJob = ModelJob()):
    """Tasks keep the node that each row has reached in each tree: deep trees are not sent to them and walked again for
    every level. The trees are the same."""
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=LABEL,
        numTrees=settings.num_trees,
        maxDepth=settings.max_depth,
        featureSubsetStrategy="sqrt",
        seed=settings.seed,
        cacheNodeIds=True,
    )


def with_score(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("score", vector_to_array("probability")[1])


@dataclass(frozen=True)
class Trained:
    preprocessor: Preprocessor
    model: object

    def score(self, df: DataFrame) -> DataFrame:
        return with_score(self.model.transform(self.preprocessor.transform(df)))


def require_two_classes(df: DataFrame, label: str) -> None:
    if df.agg(F.countDistinct(label)).first()[0] < 2:
        raise ValueError(f"the rows have one value of {label} only: nothing to tell apart")


def fit(
    frame: DataFrame,
    columns: Sequence[str],
    key: str,
    *,
    kind: str = "logistic_regression",
    settings: ModelJob = ModelJob(),
    weight: str | None = None,
) -> Trained:
    """One model on the training side of the frame."""
    train, _ = split(frame, key, settings)
    preprocessor = fit_preprocessor(train, columns)
    keep = ["features", LABEL, *([weight] if weight else [])]
    prepared = materialise(preprocessor.transform(train).select(*keep), "train")
    estimator = (
        logistic_regression(prepared.count(), settings, weight)
        if kind == "logistic_regression"
        else random_forest(settings)
    )
    return Trained(preprocessor, estimator.fit(prepared))


def train_binary_models(
    frame: DataFrame,
    *,
    key: str,
    target: str = LABEL,
    drop_columns: Sequence[str] = (),
    settings: ModelJob = ModelJob(),
    kinds: Sequence[str] = ("logistic_regression", "random_forest"),
) -> DataFrame:
    """One row of test metrics per model. ``key`` identifies rows for the split. Rows without a label are left out."""
    require_two_classes(frame, target)
    columns = [c for c in frame.columns if c not in {key, target, LABEL, *drop_columns}]
    labelled = frame.withColumn(LABEL, F.col(target).cast("double")).select(key, LABEL, *columns)
    labelled = labelled.where(F.col(LABEL).isNotNull())
    parts = materialise(stratified_parts(labelled, key, settings=settings), "labelled")
    train, test = (parts.where(F.col("part") == name).drop("part") for name in ("train", "test"))
    preprocessor = fit_preprocessor(train, columns)
    # both models read the prepared rows several times
    prepared = materialise(preprocessor.transform(train).select("features", LABEL), "train")
    held_out = materialise(preprocessor.transform(test).select("features", LABEL), "test")
    train_rows = prepared.count()
    rows = []
    for kind in kinds:
        estimator = (
            logistic_regression(train_rows, settings) if kind == "logistic_regression" else random_forest(settings)
        )
        scored = with_score(estimator.fit(prepared).transform(held_out)).select(LABEL, "score", "prediction")
        scored = materialise(scored, "scored")
        ranking = ranking_metrics(scored).select(F.struct("average_precision", "roc_auc")).scalar()
        rows.append(
            decision_metrics(scored)
            .withColumn("_ranking", ranking)
            .select(
                F.lit(kind).alias("model"),
                "_ranking.average_precision",
                "precision",
                "recall",
                "f1",
                "_ranking.roc_auc",
                F.lit(train_rows).cast("bigint").alias("train_rows"),
                F.col("rows").alias("test_rows"),
            )
        )
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def train_transaction_model(features: DataFrame, *, drop_leaking: bool = True, **options) -> DataFrame:
    dropped = ["source_account_id", "destination_account_id", "label_source", *(LEAKING if drop_leaking else ())]
    return train_binary_models(features, key="transaction_id", drop_columns=dropped, **options)


def train_party_model(features: DataFrame, **options) -> DataFrame:
    return train_binary_models(features, key="party_id", **options)


def train_node_model(features: DataFrame, *, label_column: str = "is_fraud", **options) -> DataFrame:
    """Account-tabular, graph-node (the graph bundle's node features) and combined (those and the embedding)
    tracks: they differ in the frame only. Rows without a label are left out."""
    if label_column not in features.columns:
        raise KeyError(f"the features have no label column {label_column}")
    dropped = [c for c in (label_column, "fraud_step") if c in features.columns]
    return train_binary_models(features, key="node_id", target=label_column, drop_columns=dropped, **options)


def train_embedding_model(
    embeddings: DataFrame, node_features: DataFrame, *, label_column: str = "is_fraud", **options
) -> DataFrame:
    labelled = embeddings.join(node_features.select("node_id", label_column), "node_id", "left")
    return train_node_model(labelled, label_column=label_column, **options)
