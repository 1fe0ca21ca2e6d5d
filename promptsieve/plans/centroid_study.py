"""Compare embedding models by nearest-centroid classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.operators import centroids as C
from promptsieve.operators import evaluate as E
from promptsieve.operators import prepare as PR


def evaluate(train: DataFrame, test: DataFrame, method: str = "cosine", label: str = "is_malicious") -> DataFrame:
    """One row: weighted metrics, ranking power and both sides' centroid similarity of a two-class model.

    ``method`` is ``cosine`` or ``euclidean``, the latter on vectors standardised by the training rows.
    """
    if method == "cosine":
        scored = C.score_cosine(test, C.CentroidModel.fit_cosine(train, label))
    else:
        scored = C.score_euclidean(test, C.CentroidModel.fit_euclidean(train, label))
    scored = scored.select(label, "prediction", F.round(F.get("probabilities", F.lit(1)), 9).alias("score"))
    weighted = E.class_report(scored, "prediction", label).where("class = 'weighted'").select(
        F.col("precision"), F.col("recall"), F.col("f1").alias("f1_score")
    )
    cells = E.with_metrics(E.confusion(scored, F.col("prediction"), label), ("accuracy",)).select("accuracy")
    auc = E.roc_auc(E.ranked(scored, "score", label)).withColumnRenamed("roc_auc", "auc_roc")
    base = E.majority_baseline(test, label).select("baseline")
    similar = C.centroid_similarity(train, label).select(F.col("cosine").alias("centroid_similarity"))
    other = C.centroid_similarity(test, label).select(F.col("cosine").alias("test_similarity"))
    one = F.lit(1)
    parts = [p.withColumn("_k", one) for p in (cells, weighted, auc, similar, other, base)]
    return reduce(lambda a, b: a.join(b, "_k"), parts).drop("_k")


def compare(models: Mapping[str, DataFrame], methods: Sequence[str] = ("cosine", "euclidean"), share: float = 0.8,
            label: str = "is_malicious", key: str = "prompt_id") -> DataFrame:
    """One row per embedding model and method, trained on a hash split's ``share`` and tested on the rest."""
    rows = []
    for name, frame in models.items():
        split = PR.hash_split(frame, {"train": share, "test": 1 - share}, key)
        train, test = split.where("split = 'train'"), split.where("split = 'test'")
        rows += [evaluate(train, test, m, label).withColumn("model", F.lit(name)).withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, rows).select(
        "model", "method", "accuracy", "f1_score", "precision", "recall", "auc_roc", "centroid_similarity",
        "test_similarity", "baseline"
    )


def with_mean_row(results: DataFrame) -> DataFrame:
    """The rows and, per method, their mean as the model ``mean``."""
    numbers = [c for c in results.columns if c not in ("model", "method")]
    mean = results.groupBy("method").agg(*[F.avg(c).alias(c) for c in numbers]).withColumn("model", F.lit("mean"))
    return results.unionByName(mean)
