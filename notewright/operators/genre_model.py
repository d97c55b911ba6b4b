"""Genre classifier on the statistics table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.operators.windows import best_row, hash_order
from notewright.schemas import STATISTICS_FIELDS

# First eight hex digits of the hash below this value: one tenth of all hashes.
TEST_BOUND = "1999999a"

# All numbers of the statistics table.
FEATURES = [name for name, kind in STATISTICS_FIELDS.items() if kind in ("INT", "BIGINT", "DOUBLE")]
CATEGORICAL = "lyrics_bool"
TARGET = "genre"


def with_split(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Flag about a tenth of the rows as test rows, by key, the same in any partitioning."""
    return rows.withColumn("is_test", hash_order(F.col(key), seed) < TEST_BOUND)


def prepare(rows: DataFrame, predict_only: bool = False) -> DataFrame:
    """One row per md5, feature columns only, numbers and strings forced; for fitting also the target and a split.

    Rows without a target are not fitted on. Missing numbers stay null until ``imputed``.
    """
    kept = ["md5", *FEATURES, CATEGORICAL] + ([] if predict_only else [TARGET])
    unique = best_row(rows.select(*kept), ["md5"], [F.struct(*[F.col(c) for c in kept if c != "md5"])])
    coerced = unique.withColumns({c: F.col(c).cast("double") for c in FEATURES}).withColumn(
        CATEGORICAL, F.col(CATEGORICAL).cast("string")
    )
    return coerced if predict_only else with_split(coerced.where(F.col(TARGET).isNotNull()), "md5")


def means(training: DataFrame) -> dict[str, float]:
    """Mean of every feature over the training rows; 0 where none has a value."""
    found = training.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    return {c: found[c] or 0.0 for c in FEATURES}


def imputed(rows: DataFrame, by: dict[str, float]) -> DataFrame:
    """Missing numbers replaced by the training means."""
    return rows.na.fill(by)


def encoders() -> list[StringIndexer]:
    """Sorted label encoders of the categorical column and of the target; an unseen label is an error."""
    order = {"stringOrderType": "alphabetAsc", "handleInvalid": "error"}
    return [
        StringIndexer(inputCol=CATEGORICAL, outputCol=f"{CATEGORICAL}_index", **order),
        StringIndexer(inputCol=TARGET, outputCol="label", **order),
    ]


def fit(training: DataFrame, trees: int = 20, max_depth: int = 15, seed: int = 42):
    """Label encoders, assembler, forest and inverse target encoder as one pipeline model.

    Encoders are fitted first so that the inverse encoder knows the labels; the fitted stages form the model.
    """
    training = training.persist()
    category, target = (e.fit(training) for e in encoders())
    assembler = VectorAssembler(inputCols=[*FEATURES, f"{CATEGORICAL}_index"], outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=seed, labelCol="label", featuresCol="features")
    inverse = IndexToString(inputCol="prediction", outputCol="predicted_genre", labels=target.labels)
    encoded = target.transform(training)
    fitted = Pipeline(stages=[category, assembler, forest, inverse]).fit(encoded)
    training.unpersist()
    return fitted, target


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows)


def class_report(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with overall accuracy; zero denominators give 0."""
    pairs = predictions.groupBy(label, predicted).agg(F.count("*").alias("n"))
    hit = F.col(label) == F.col(predicted)
    by_label = pairs.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits")
    )
    by_prediction = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted"))
    accuracy = pairs.agg(F.try_divide(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")))
    zero = F.lit(0.0)
    joined = by_label.join(by_prediction, "class", "full").select(
        "class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hits", "predicted")]
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), zero)
    recall = F.coalesce(F.try_divide("hits", "support"), zero)
    return joined.select(
        "class", "support", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
        accuracy.scalar().alias("accuracy"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
