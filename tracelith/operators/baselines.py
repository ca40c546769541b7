"""Tabular baselines on Spark ML: lr, nb, rf, gbt, mlp, svm (linear: Spark has no RBF kernel, nor leaf-wise boosting)."""

from __future__ import annotations

from pyspark.ml import Pipeline, classification
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import confusion


def _model(kind: str, n: int):
    c = classification
    return {
        "lr": lambda: c.LogisticRegression(featuresCol="scaled", maxIter=2000), "nb": lambda: c.NaiveBayes(modelType="gaussian"), "rf": lambda: c.RandomForestClassifier(numTrees=500, maxDepth=30, seed=42),
        "gbt": lambda: c.GBTClassifier(maxIter=600, maxDepth=6, stepSize=0.05, seed=42), "mlp": lambda: c.MultilayerPerceptronClassifier(featuresCol="scaled", layers=[n, 256, 128, 2], maxIter=200, seed=42),
        "svm": lambda: c.LinearSVC(featuresCol="scaled"),
    }[kind]()


#: Model groups that are trained together.
GROUPS = {"both": ("rf", "gbt"), "all": ("lr", "nb", "rf", "gbt", "mlp", "svm"), "all_wo_svm": ("lr", "nb", "rf", "gbt", "mlp")}


def train_eval_group(df: DataFrame, features: list[str], label: str, train: str, group: str) -> DataFrame:
    """train_eval of each model of a group, with its kind as column model."""
    out = None
    for kind in GROUPS[group]:
        one = train_eval(df, features, label, train, kind).withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def train_eval(df: DataFrame, features: list[str], label: str, train: str, kind: str) -> DataFrame:
    """Fit on rows where train holds, confusion metrics on the others; missing features count as 0."""
    x = df.select(F.col(label).cast("double").alias("label"), F.col(train).alias("_train"), *(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features))
    steps = [VectorAssembler(inputCols=features, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), _model(kind, len(features))]
    model = Pipeline(stages=steps).fit(x.where("_train"))
    return confusion(model.transform(x.where("not _train")), [], "label", "prediction")
