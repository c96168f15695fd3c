"""Candidate-ranking models on Spark ML: one-hot features and tree ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lariat.functions.text import round_half_even
from lariat.operators.features import categorical_features, drop_column
from lariat.operators.label import FEATURES
from lariat.operators.ranking import top_k
from lariat.operators.sampling import stratified_split
from lariat.operators.stats import classification_report, class_ratio

NULL = "__null__"
PROBABILITY = "prob_contratacao"


def fill_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null is a category of its own."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in columns}) if columns else df


def classifier(kind: str = "gbt", weight: str | None = None, label: str = "target", **params):
    """gbt (production), rf (balanced baseline) or lr."""
    made = {
        "gbt": lambda: GBTClassifier(**{"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": 42} | params),
        "rf": lambda: RandomForestClassifier(**{"numTrees": 100, "maxDepth": 10, "seed": 42} | params),
        "lr": lambda: LogisticRegression(**params),
    }[kind]()
    made = made.setLabelCol(label).setFeaturesCol("features")
    return made.setWeightCol(weight) if weight else made


def build_pipeline(columns: Sequence[str], model=None) -> Pipeline:
    """Index, one-hot and assemble. handleInvalid='keep' adds a bucket for unseen values, which dropLast removes: an unseen category is a zero vector."""
    indexed, hot = [f"__i_{c}" for c in columns], [f"__o_{c}" for c in columns]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(columns), outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=hot, outputCol="features"),
        *([model] if model is not None else []),
    ])


def balanced_weight(df: DataFrame, target: str = "target", name: str = "weight") -> DataFrame:
    """n / (2 n_class), as class_weight='balanced'."""
    n = df.groupBy(target).agg(F.count("*").alias("__n"))
    n = n.withColumn("__all", F.sum("__n").over(Window.partitionBy(F.lit(0))))
    return df.join(F.broadcast(n), target).withColumn(name, F.col("__all") / (F.lit(2.0) * F.col("__n"))).drop("__n", "__all")


def positive_weight(df: DataFrame, target: str = "target", name: str = "weight") -> DataFrame:
    """Positives weigh majority / minority, others 1."""
    return df.join(F.broadcast(class_ratio(df, target))).withColumn(name, F.when(F.col(target) == 1, F.col("ratio")).otherwise(F.lit(1.0))).drop("ratio")


def fit(df: DataFrame, columns: Sequence[str] | None = None, model=None, target: str = "target") -> PipelineModel:
    columns = list(columns) if columns is not None else categorical_features(drop_column(df, target))
    return build_pipeline(columns, model if model is not None else classifier(label=target)).fit(fill_nulls(df, columns))


def predict(model: PipelineModel, df: DataFrame, columns: Sequence[str] | None = None, probability: str = PROBABILITY) -> DataFrame:
    """The input's columns, the probability of class 1 and the hard prediction."""
    columns = list(columns) if columns is not None else model.stages[0].getInputCols()
    packed = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(c) for c in columns], F.struct(*df.columns).alias("__row"))
    scored = model.transform(packed)
    return scored.select("__row.*", vector_to_array("probability")[1].alias(probability), F.col("prediction").cast("int").alias("prediction"))


def predict_proba(model: PipelineModel, df: DataFrame, key: str, top_n: int = 5, probability: str = PROBABILITY) -> DataFrame:
    """Score and keep the top_n rows by probability, ties by key."""
    return top_k(predict(model, df, probability=probability).drop("prediction"), probability, key, top_n)


def rank_candidates(model: PipelineModel, df: DataFrame, key: str, top_n: int = 10) -> DataFrame:
    """predict_proba of a table that may still hold its target."""
    return predict_proba(model, drop_column(df, "target", must_exist=False), key, top_n)


def score_one(spark: SparkSession, model: PipelineModel, record: Mapping[str, str], features: Sequence[str] = FEATURES) -> float:
    """Validate one record (all features, text only) and return its probability, 8 decimals, half to even."""
    bad = [c for c in features if not isinstance(record.get(c), str)]
    if bad:
        raise ValueError(f"missing or not text: {', '.join(bad)}")
    schema = StructType([StructField(c, StringType()) for c in features])
    row = spark.createDataFrame([tuple(record[c] for c in features)], schema)
    return predict(model, row).select(round_half_even(F.col(PROBABILITY)).alias("p")).first().p


def train_and_evaluate(df: DataFrame, key: str, columns: Sequence[str] | None = None, model=None, target: str = "target", weight: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """Stratified 80/20 split by ``key``, fit on the larger part, report on the rest."""
    columns = list(columns) if columns is not None else [c for c in categorical_features(drop_column(df, target)) if c != key]
    split = stratified_split(df, key, target)
    train = split.where(~F.col("is_test"))
    if weight:
        train = {"balanced": balanced_weight, "positive": positive_weight}[weight](train, target)
    fitted = fit(train, columns, model if model is not None else classifier(weight="weight" if weight else None, label=target), target)
    return fitted, classification_report(predict(fitted, split.where("is_test"), columns), target, "prediction")


def feature_importance(model: PipelineModel, df: DataFrame, top_n: int = 15) -> DataFrame:
    """(feature, importance), highest first: as many rows as encoded categories of the listed columns."""
    columns = model.stages[0].getInputCols()
    spark = df.sparkSession
    attrs = model.transform(fill_nulls(df.limit(1), columns)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"].removeprefix("__o_") for group in attrs.values() for a in group}
    values = model.stages[-1].featureImportances
    rows = [(names[int(i)], float(v)) for i, v in zip(values.indices, values.values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top_n)
