"""Nearest-centroid operators over embeddings that arrive as an array column.

Fitting is one partial aggregation whose state is a vector per class, so a class
holding a third of the rows costs the same as any other.  The fitted model is
|classes| x |dimensions| numbers and travels to the tasks inside the expression.
Scoring multiplies whole Arrow batches by the centroid matrix: measured on 40,000
64-d vectors against 10 centroids this took 0.3 s, higher-order functions 0.8 s,
and the gap widens with the dimension.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.functions import vectors as V

# Ship these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLOOR = 1e-8
MOST_CLASSES = 10_000


def l2_normalise(frame: DataFrame, column: str = "embedding", floor: float = FLOOR) -> DataFrame:
    """Replaces the vector with its unit vector; vectors shorter than ``floor`` are divided by it."""
    return frame.withColumn(column, V.normalise(F.col(column), floor))


def class_means(frame: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(class, n, centroid): the mean vector of each class."""
    vector = array_to_vector(F.col(column))
    return frame.groupBy(F.col(by).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(vector)).alias("centroid")
    )


def unit_means(frame: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """Class means scaled to length one (left as they are below the floor)."""
    centroid, size = F.col("centroid"), V.norm(F.col("centroid"))
    return class_means(frame, by, column).withColumn(
        "centroid", F.when(size > FLOOR, V.divide(centroid, size)).otherwise(centroid)
    )


def scale_statistics(frame: DataFrame, column: str = "embedding") -> DataFrame:
    """(n, mean, scale) over all rows: population deviation, 1 where it is 0."""
    summary = frame.agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(column))).alias("s")
    )
    n = F.col("s.count").cast("double")
    return summary.select(
        F.col("s.count").alias("n"), vector_to_array(F.col("s.mean")).alias("mean"),
        F.transform(
            vector_to_array(F.col("s.variance")),
            lambda v: F.when(v > 0, F.sqrt(v * (n - 1) / n)).otherwise(F.lit(1.0)),
        ).alias("scale"),
    )


@dataclass(frozen=True)
class CentroidModel:
    """Centroids in ascending class order, with the scaling they were fitted under."""

    classes: tuple
    centroids: np.ndarray
    raw: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    @classmethod
    def _ordered(cls, means: DataFrame) -> tuple[tuple, np.ndarray]:
        """One row per class, of which there may be ``MOST_CLASSES``; rows without class are left out."""
        rows = means.where("class is not null").limit(MOST_CLASSES + 1).collect()
        if len(rows) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        rows = sorted(rows, key=lambda r: r["class"])
        return tuple(r["class"] for r in rows), np.array([r["centroid"] for r in rows], dtype="f8")

    @classmethod
    def fit_cosine(cls, frame: DataFrame, by: str, column: str = "embedding") -> CentroidModel:
        """Unit centroids for cosine similarity.  Collects one row per class."""
        classes, raw = cls._ordered(class_means(frame, by, column))
        norms = np.linalg.norm(raw, axis=1, keepdims=True)
        return cls(classes, raw / np.where(norms > FLOOR, norms, 1.0), raw)

    @classmethod
    def fit_euclidean(cls, frame: DataFrame, by: str, column: str = "embedding") -> CentroidModel:
        """Centroids of the standardised vectors.

        Standardising is affine, so the mean of scaled vectors is the scaled mean and
        one aggregation per class plus one for the scale is enough.
        """
        classes, raw = cls._ordered(class_means(frame, by, column))
        stats = scale_statistics(frame, column).first()
        mean, scale = np.array(stats["mean"]), np.array(stats["scale"])
        return cls(classes, (raw - mean) / scale, raw, mean, scale)

    @property
    def class_literals(self) -> Column:
        return F.array(*map(F.lit, self.classes))


def _batch(function, dims: int, classes: int):
    """An Arrow function from (rows, dims) to (rows, classes) as a column function.

    A null vector, or one with a null entry, gives null; any other must have ``dims`` entries.
    """
    @F.arrow_udf("array<double>")
    def apply(vectors):
        import numpy as np
        import pyarrow as pa

        sizes = np.diff(np.asarray(vectors.offsets))
        there = np.asarray(vectors.is_valid())
        sizes = np.where(there, sizes, 0)
        if wrong := set(sizes[there].tolist()) - {dims}:
            raise ValueError(f"vectors of {dims} dimensions expected, found {sorted(wrong)}")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)
        whole = ~np.isnan(flat).any(axis=1)
        there[np.flatnonzero(there)[~whole]] = False
        y = function(flat[whole])
        offsets = np.concatenate([[0], np.cumsum(np.where(there, classes, 0))]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()), mask=pa.array(~there))

    return apply


def cosine_similarities(model: CentroidModel, column: str = "embedding") -> Column:
    """Array of cosine similarities, one per class in class order."""
    target = np.ascontiguousarray(model.centroids.T)

    def similarities(x):
        norms = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), FLOOR)
        return (x / norms) @ target

    return _batch(similarities, *target.shape)(F.col(column))


def euclidean_distances(model: CentroidModel, column: str = "embedding") -> Column:
    """Array of distances between the standardised vector and each centroid."""
    centroids, mean, scale = model.centroids, model.mean, model.scale

    def distances(x):
        z = (x - mean) / scale
        return np.stack([np.sqrt(((z - c) ** 2).sum(axis=1)) for c in centroids], axis=1)

    return _batch(distances, centroids.shape[1], len(centroids))(F.col(column))


def argmax_class(model: CentroidModel, values: Column) -> Column:
    """Class of the largest value; the smallest class wins a tie."""
    best = F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return F.get(model.class_literals, -best["i"])


def argmin_class(model: CentroidModel, values: Column) -> Column:
    best = F.array_min(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.get(model.class_literals, best["i"])


def score_cosine(frame: DataFrame, model: CentroidModel, column: str = "embedding") -> DataFrame:
    """Adds similarities, prediction and softmax probabilities."""
    scored = frame.withColumn("similarities", cosine_similarities(model, column))
    return scored.withColumn("prediction", argmax_class(model, F.col("similarities"))).withColumn(
        "probabilities", V.softmax(F.col("similarities"))
    )


def score_euclidean(frame: DataFrame, model: CentroidModel, column: str = "embedding") -> DataFrame:
    """Adds distances, prediction and inverse-distance probabilities."""
    scored = frame.withColumn("distances", euclidean_distances(model, column))
    inverse = F.transform("distances", lambda d: 1.0 / (d + FLOOR))
    whole = F.aggregate(inverse, F.lit(0.0), lambda s, v: s + v)
    return scored.withColumn("prediction", argmin_class(model, F.col("distances"))).withColumn(
        "probabilities", V.divide(inverse, whole)
    )


def max_similarity(frame: DataFrame, model: CentroidModel, classes: Sequence | None = None, column: str = "embedding") -> DataFrame:
    """(prompt_id, centroid): largest cosine to any centroid, or to those of ``classes``."""
    keep = [i for i, c in enumerate(model.classes) if classes is None or c in classes]
    part = CentroidModel(tuple(model.classes[i] for i in keep), model.centroids[keep], model.raw[keep])
    return frame.select(
        "prompt_id", F.array_max(cosine_similarities(part, column)).alias("centroid")
    )


def margins(scored: DataFrame) -> DataFrame:
    """Adds ``margin`` of a two-class score; positive leans to the second class."""
    if "similarities" in scored.columns:
        return scored.withColumn("margin", F.get("similarities", F.lit(1)) - F.get("similarities", F.lit(0)))
    return scored.withColumn("margin", F.get("distances", F.lit(0)) - F.get("distances", F.lit(1)))


def margin_statistics(scored: DataFrame, label: str = "is_malicious", near: float = 0.01) -> DataFrame:
    """Per class: rows, mean margin, spread and the share lying within ``near`` of zero."""
    close = (F.abs("margin") < near).cast("double")
    return scored.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("margin").alias("mean_margin"),
        F.stddev_pop("margin").alias("std_margin"), (F.avg(close) * 100.0).alias("pct_near_zero"),
    )


def centroid_similarity(frame: DataFrame, by: str = "is_malicious", column: str = "embedding") -> DataFrame:
    """Raw dot product and cosine of the two class centroids (classes 0 and 1)."""
    means = class_means(frame, by, column)
    pair = means.agg(
        F.first(F.when(F.col("class") == 0, F.col("centroid")), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("class") == 1, F.col("centroid")), ignorenulls=True).alias("b"),
    )
    return pair.select(
        V.dot(F.col("a"), F.col("b")).alias("dot"),
        (V.dot(F.col("a"), F.col("b")) / (V.norm(F.col("a")) * V.norm(F.col("b")))).alias("cosine"),
    )


def overlap_index(frame: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """Mean pairwise cosine over the k class centroids.

    The squared length of the sum of k unit vectors is k plus twice all pairwise
    cosines, so the mean needs no pairs: (|sum|^2 - k) / (k * (k - 1)).
    """
    total = unit_means(frame, by, column).agg(
        F.count(F.lit(1)).alias("classes"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("centroid")))).alias("s"),
    )
    k = F.col("classes").cast("double")
    return total.select(
        "classes", ((V.dot(F.col("s"), F.col("s")) - k) / (k * (k - 1.0))).alias("overlap")
    )


def collapse_check(
    results: DataFrame, baseline: Column, max_similarity: float = 0.95, min_auc: float = 0.55,
) -> DataFrame:
    """Adds ``collapsed``: similar centroids, no ranking power and below the majority baseline."""
    return results.withColumn(
        "collapsed",
        (
            F.coalesce(F.col("centroid_similarity") > max_similarity, F.lit(False))
            & (F.col("auc_roc") < min_auc) & (F.col("accuracy") < baseline)
        ).cast("int"),
    )
