"""Training, stacking, calibration and model evaluation with Spark ML.

Driver loops run over folds and learners, never over data, and their fits run at the same
time.  Training reads its feature table many times, so callers write that table once (see plans).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.operators import evaluate as E
from promptsieve.streaming.feedback import shared_folder
from promptsieve.together import together

LABEL = "is_malicious"


def logistic(n: int, c: float = 1.0, max_iter: int = 1000, weight: str | None = None) -> LogisticRegression:
    """L2 logistic regression whose penalty equals 1 / (2 c) on the summed loss of n rows."""
    model = LogisticRegression(
        labelCol=LABEL, featuresCol="features", maxIter=max_iter, regParam=1.0 / (c * max(n, 1)),
        elasticNetParam=0.0, standardization=False,
    )
    return model.setWeightCol(weight) if weight else model


def forest(trees: int = 300, depth: int = 12, leaf: int = 2, seed: int = 42, weight: str | None = None) -> RandomForestClassifier:
    model = RandomForestClassifier(
        labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy="sqrt", seed=seed,
    )
    return model.setWeightCol(weight) if weight else model


def boosted(rounds: int = 500, depth: int = 6, rate: float = 0.05, seed: int = 42, leaf: int = 5, share: float = 0.8) -> GBTClassifier:
    return GBTClassifier(
        labelCol=LABEL, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
        minInstancesPerNode=leaf, subsamplingRate=share, featureSubsetStrategy=str(share),
    )


def stack_learners(rounds: int = 500, depth: int = 6, trees: int = 300, forest_depth: int = 12, seed: int = 42) -> dict:
    """Two differently seeded boosted models and a forest."""
    return {
        "boosted_1": boosted(rounds, depth, seed=seed), "boosted_2": boosted(rounds, depth, seed=seed + 1),
        "forest": forest(trees, forest_depth, seed=seed),
    }


def assemble(frame: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(frame)


def fitted(learner, frame: DataFrame):
    """``learner.fit(frame)`` without the training summary.

    A summary refers to the session and goes with the model into every task that scores; a session that has ever
    registered an ``Observation`` cannot be serialised.  Boosting adds a step to its rows' lineage each round and cuts it
    only with a checkpoint folder, so a session without one gets it.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession, "rounds"))
    model = learner.fit(frame)
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(frame.sparkSession._jvm.scala.Option.empty())
    return model


def positive(column: str = "probability") -> Column:
    """The second entry of a dense vector, read from its stored form: no function object travels with the tasks."""
    return F.get(F.unwrap_udt(column)["values"], F.lit(1))


def _scored(model, frame: DataFrame, name: str) -> DataFrame:
    """Adds the positive-class probability of one fitted model."""
    out = model.transform(frame).withColumn(name, positive())
    return out.drop("rawPrediction", "probability", "prediction")


def linear_probe(train: DataFrame, test: DataFrame, column: str = "embedding", c: float = 1.0) -> DataFrame:
    """(prompt_id, label, score, pred) of logistic regression on raw embeddings."""
    vec = lambda frame: frame.select("prompt_id", LABEL, array_to_vector(F.col(column)).alias("features"))
    model = fitted(logistic(train.count(), c), vec(train))
    return _scored(model, vec(test), "score").select(
        "prompt_id", LABEL, "score", (F.col("score") > 0.5).cast("int").alias("pred")
    )


@dataclass
class Stack:
    """Base learners on ``features`` with a logistic meta-learner over their out-of-fold
    probabilities and, by default, the features themselves."""

    learners: Mapping
    folds: int = 3
    passthrough: bool = True
    meta_iterations: int = 1000
    models: dict = field(default_factory=dict)
    meta: object = None

    def _meta_input(self, frame: DataFrame) -> DataFrame:
        parts = [f"p_{n}" for n in self.learners] + (["features"] if self.passthrough else [])
        return assemble(frame, parts, "_meta").withColumnRenamed("features", "_features").withColumnRenamed("_meta", "features")

    def fit(self, train: DataFrame) -> Stack:
        """``train`` has features, the label and ``fold`` in 0..folds-1."""
        parts = [None, *(range(self.folds) if len(self.learners) > 1 else ())]  # None: no fold is held out
        fit = lambda learner, k: fitted(learner, train if k is None else train.where(F.col("fold") != k))
        models = together(train.sparkSession, {
            (n, k): partial(fit, learner, k) for k in parts for n, learner in self.learners.items()})
        self.models = {n: models[n, None] for n in self.learners}
        if len(self.learners) == 1:
            return self
        held_out = []
        for k in range(self.folds):
            part = train.where(F.col("fold") == k)
            for name in self.learners:
                part = _scored(models[name, k], part, f"p_{name}")
            held_out.append(part)
        joined = self._meta_input(reduce(DataFrame.unionByName, held_out))
        self.meta = fitted(logistic(train.count(), max_iter=self.meta_iterations), joined)
        return self

    def predict(self, frame: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of the positive class."""
        if self.meta is None:
            (only,) = self.models.values()
            return _scored(only, frame, name)
        for base, model in self.models.items():
            frame = _scored(model, frame, f"p_{base}")
        scored = _scored(self.meta, self._meta_input(frame), name)
        return scored.drop("features", *[f"p_{n}" for n in self.models]).withColumnRenamed("_features", "features")

    def importances(self, spark: SparkSession, learner: str, names: Sequence[str], k: int = 20) -> DataFrame:
        """(feature, importance): the k most important inputs of one tree learner."""
        values = self.models[learner].featureImportances.toArray().tolist()
        top = sorted(zip(names, values), key=lambda p: (-p[1], p[0]))[:k]
        return spark.createDataFrame(top, "feature string, importance double")


@dataclass
class Calibrator:
    """Mean of isotonic fits, each on the rows outside one fold."""

    models: list

    @classmethod
    def fit(cls, scored: DataFrame, score: str = "score", folds: int = 3, label: str = LABEL) -> Calibrator:
        """``scored`` has the score, the label and ``fold``; calibrates a fitted score."""
        regression = IsotonicRegression(labelCol="_y", featuresCol=score, isotonic=True)
        rows = scored.withColumn("_y", F.col(label).cast("double"))
        return cls([regression.fit(rows.where(F.col("fold") != k)) for k in range(folds)])

    def transform(self, scored: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
        for i, model in enumerate(self.models):
            scored = model.copy({model.predictionCol: f"_c{i}"}).transform(scored)
        parts = [f"_c{i}" for i in range(len(self.models))]
        mean = reduce(lambda a, b: a + b, [F.col(p) for p in parts]) / len(parts)
        return scored.withColumn(name, mean).drop(*parts)


def bootstrap_interval(cells: DataFrame, draws: int = 500, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Confidence interval of balanced accuracy.

    Resampling (label, prediction) pairs is a multinomial draw over the four cells, so
    each draw costs four numbers whatever the size of the table.
    """
    tp, fp, tn, fn = (int(v) for v in cells.select("tp", "fp", "tn", "fn").first())

    def draw(batches):
        import numpy as np
        import pandas as pd

        n = tp + fp + tn + fn
        for batch in batches:
            values = []
            for i in batch["id"]:
                a, b, c, d = np.random.default_rng([seed, int(i)]).multinomial(n, np.array([tp, fp, tn, fn]) / n)
                recalls = [x / y for x, y in ((a, a + d), (c, c + b)) if y > 0]
                values.append(sum(recalls) / len(recalls))
            yield pd.DataFrame({"ba": values})

    tail = (1.0 - level) / 2
    return cells.sparkSession.range(draws).mapInPandas(draw, "ba double").agg(
        F.percentile("ba", F.lit(tail)).alias("low"), F.percentile("ba", F.lit(1 - tail)).alias("high")
    )


def fold_statistics(frame: DataFrame, columns: Sequence[str], label: str = LABEL) -> dict[int, dict]:
    """Rows per class, and mean and population deviation (0 becomes 1) of each column, over the rows outside each fold.

    One aggregation over the folds; counts, means and variances of the other folds are then combined.
    """
    rows = frame.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positive"),
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns],
    ).collect()
    found = {}
    for held_out in rows:
        others = [r for r in rows if r["fold"] != held_out["fold"]]
        n, scale = sum(r["n"] for r in others), {}
        for c in columns:
            mean = sum(r["n"] * r[f"m_{c}"] for r in others) / max(n, 1)
            spread = sum(r["n"] * (r[f"v_{c}"] + (r[f"m_{c}"] - mean) ** 2) for r in others) / max(n, 1)
            scale[c] = (mean, spread ** 0.5 or 1.0)
        found[held_out["fold"]] = {"n": n, "positive": sum(r["positive"] for r in others), "scale": scale}
    return found


def cross_validate(frame: DataFrame, columns: Sequence[str], learners: Mapping, folds: int = 5) -> DataFrame:
    """Pooled metrics, mean fold balanced accuracy and its interval per learner, best first.

    ``frame`` has the columns, the label and ``fold``.  Each fold's rows are standardised by the others' means and
    deviations.  Class weights are in the column ``weight``, for learners that name it as theirs.
    """
    spark, statistics = frame.sparkSession, fold_statistics(frame, columns)

    def scaled(k: int, rows: DataFrame) -> DataFrame:
        s = statistics[k]
        weight = F.when(F.col(LABEL) == 1, s["n"] / (2.0 * max(s["positive"], 1))).otherwise(s["n"] / (2.0 * max(s["n"] - s["positive"], 1)))
        plain = rows.select(LABEL, "fold", weight.alias("weight"), *[((F.col(c) - m) / d).alias(c) for c, (m, d) in s["scale"].items()])
        return assemble(plain, columns)

    present = [k for k in range(folds) if k in statistics]
    models = together(spark, {
        (name, k): partial(lambda learner, k: fitted(learner, scaled(k, frame.where(F.col("fold") != k))), learner, k)
        for name, learner in learners.items() for k in present})

    def judged(name: str) -> DataFrame:
        parts = [_scored(models[name, k], scaled(k, frame.where(F.col("fold") == k)), "score").select(LABEL, "fold", "score") for k in present]
        pooled = reduce(DataFrame.unionByName, parts).withColumn("pred", (F.col("score") > 0.5).cast("int")).persist()
        cells = E.confusion(pooled, F.col("pred"))
        per_fold = E.with_metrics(E.confusion(pooled, F.col("pred"), by=["fold"]), ("balanced_accuracy",))
        one = E.with_metrics(cells, ("f1", "mcc", "precision", "recall", "fpr", "fnr")).first().asDict()
        one |= per_fold.agg(F.avg("balanced_accuracy").alias("balanced_accuracy")).first().asDict()
        one |= E.roc_auc(E.ranked(pooled)).first().asDict() | bootstrap_interval(cells).first().asDict()
        pooled.unpersist()
        return one | {"learner": name}

    rows = together(spark, {name: partial(judged, name) for name in learners})
    found = sorted(rows.values(), key=lambda r: (-r["balanced_accuracy"], r["learner"]))
    kinds = ", ".join(f"{c} {'string' if c == 'learner' else 'long' if c in ('tp', 'fp', 'tn', 'fn') else 'double'}" for c in found[0])
    return spark.createDataFrame([tuple(r.values()) for r in found], kinds)


def overfit_ratio(train: DataFrame, validation: DataFrame, score: str = "score") -> DataFrame:
    """(train_accuracy, validation_accuracy, ratio) of two scored frames."""
    accuracy = lambda f: f.agg(F.avg(((F.col(score) >= 0.5).cast("int") == F.col(LABEL)).cast("double")).alias("a"))
    a = accuracy(train).select(F.col("a").alias("train_accuracy"), F.lit(1).alias("_k"))
    b = accuracy(validation).select(F.col("a").alias("validation_accuracy"), F.lit(1).alias("_k"))
    return a.join(b, "_k").drop("_k").withColumn(
        "ratio", F.col("train_accuracy") / F.greatest(F.col("validation_accuracy"), F.lit(1e-8))
    )


def retrain_on_feedback(
    buffer: DataFrame, threshold: float, fp_ema: float = 0.05, minimum: int = 200, alpha: float = 0.001,
    target_fp: float = 0.05, label: str = "label",
) -> tuple[Calibrator, dict] | None:
    """Refit the calibrator on buffered feedback and take one threshold step.

    Returns the calibrator and the new threshold, fp average and drift baseline, or None
    while the buffer is too small.  The buffer has score, label, pred and event_id.
    """
    cells = E.confusion(buffer, F.col("pred"), label).first()
    if cells["tp"] + cells["fp"] + cells["tn"] + cells["fn"] < minimum:
        return None
    folded = buffer.withColumn("fold", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    calibrator = Calibrator.fit(folded, label=label)
    baseline = calibrator.transform(folded).agg(
        F.avg("calibrated").alias("mean"), F.stddev_pop("calibrated").alias("std")
    ).first()
    ema = alpha * cells["fp"] / max(1, cells["fp"] + cells["tn"]) + (1 - alpha) * fp_ema
    return calibrator, {
        "threshold": min(0.80, max(0.30, threshold - alpha * (ema - target_fp))), "fp_ema": ema,
        "baseline_mean": baseline["mean"], "baseline_std": baseline["std"],
    }
