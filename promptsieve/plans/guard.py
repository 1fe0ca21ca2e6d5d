"""Hybrid training: features, stacking, calibration, threshold, test metrics, ablation.

The feature table is written once to the shared folder; every fit and every ablation
run reads columns of it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve import lexicon as L
from promptsieve.functions import vectors as V
from promptsieve.functions.hashing import unit_hash
from promptsieve.operators import evaluate as E
from promptsieve.operators import learn as LN
from promptsieve.operators import prepare as PR
from promptsieve.operators.features import features
from promptsieve.operators.tfidf import TfidfModel
from promptsieve.streaming.feedback import shared_folder
from promptsieve.together import AT_ONCE, together

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def _training(prompts: DataFrame, placed: DataFrame, seed: int) -> DataFrame:
    """The prompts of the training split, told by their hash alone.

    The split takes the first of each class in hash order, so one bound per class says who is in it and
    no text moves to meet its split.
    """
    place = lambda: F.struct(unit_hash(F.col("prompt_id"), seed).alias("h"), F.col("prompt_id").alias("id"))
    bounds = placed.where("split = 'train'").groupBy("is_malicious").agg(F.max(place()).alias("last")).collect()
    kind = dict(prompts.dtypes)["prompt_id"]
    within = [
        F.col("is_malicious").eqNullSafe(F.lit(r["is_malicious"]))
        & (place() <= F.struct(F.lit(r["last"]["h"]).alias("h"), F.lit(r["last"]["id"]).cast(kind).alias("id")))
        for r in bounds
    ]
    return prompts.where(reduce(or_, within, F.lit(False)))


def feature_table(prompts: DataFrame, max_terms: int = 5000, seed: int = 42, folder: str | None = None) -> tuple[DataFrame, TfidfModel]:
    """(prompt_id, label, split, fold, 117 features, tfidf) as a written table.

    The split and folds are exact inside each class; the vocabulary is fitted on the
    training rows only.  Texts are reduced to numbers in their rows, by one projection; only those meet
    the split and fold.  Rows of equal id share these.
    """
    ids = prompts.groupBy("prompt_id").agg(F.max("is_malicious").alias("is_malicious"))
    split = PR.stratified_split(ids, SHARES, seed=seed)
    placed = PR.stratified_folds(split, 3, ["split", "is_malicious"], seed=seed + 1).select("prompt_id", "is_malicious", "split", "fold")
    model = TfidfModel.fit(_training(prompts, placed, seed), max_terms)
    weighed = model.with_weights(prompts.select("prompt_id", "is_malicious", "prompt_text")).withColumn(
        "tfidf", V.sparse(len(model.terms), F.col("term_ids"), F.col("weights")))
    table = features(weighed, keep=("is_malicious", "tfidf")).join(placed.drop("is_malicious"), "prompt_id")
    target = folder or shared_folder(prompts.sparkSession, "features")
    table.write.mode("overwrite").parquet(target)
    return prompts.sparkSession.read.parquet(target), model


def inputs(use_tfidf: bool = True, use_handcrafted: bool = True, without: Sequence[str] = ()) -> list[str]:
    """Input columns of an experiment: feature names in order, then the TF-IDF vector."""
    dropped = {n for g in without for n in L.FEATURE_GROUPS[g]}
    names = [n for n in L.FEATURE_NAMES if n not in dropped] if use_handcrafted else []
    return names + (["tfidf"] if use_tfidf else [])


@dataclass
class Guard:
    """A fitted stack with its calibrator and decision threshold."""

    columns: list[str]
    stack: LN.Stack
    calibrator: LN.Calibrator
    threshold: float
    ece: float

    @classmethod
    def fit(cls, table: DataFrame, columns: Sequence[str], learners: Mapping, splits: Sequence[str] = ("train",),
            meta_iterations: int = 1000) -> Guard:
        """Fit on the splits; calibrate on one half of validation, choose the threshold on the other.

        Every pass of every fit reads the inputs, so they are put together once, as vectors that stay with the executors.
        """
        slim = table.select("prompt_id", "is_malicious", "split", "fold", *columns)
        ready = LN.assemble(slim, columns).select("prompt_id", "is_malicious", "split", "fold", "features").persist()
        try:
            return cls._fit(table, ready, columns, learners, splits, meta_iterations)
        finally:
            ready.unpersist()

    @classmethod
    def _fit(cls, table: DataFrame, ready: DataFrame, columns: Sequence[str], learners: Mapping, splits: Sequence[str],
             meta_iterations: int) -> Guard:
        stack = LN.Stack(learners, meta_iterations=meta_iterations).fit(ready.where(F.col("split").isin(list(splits))))
        halves = PR.stratified_folds(table.where("split = 'val'").select("prompt_id", "is_malicious"), 2).select(
            "prompt_id", F.col("fold").alias("half")
        )
        scored = stack.predict(ready.where("split = 'val'")).join(halves, "prompt_id").select(
            "prompt_id", "is_malicious", "fold", "half", "score"
        )
        calibrator = LN.Calibrator.fit(scored.where("half = 0"))
        tuned = calibrator.transform(scored.where("half = 1"))
        best = E.best_f1_threshold(tuned, score="calibrated").first()
        ece = E.calibration_error(tuned, score="calibrated").first()["ece"]
        return cls(list(columns), stack, calibrator, best["threshold"], ece)

    def predict(self, table: DataFrame) -> DataFrame:
        """(prompt_id, label, score, probability, pred)."""
        ready = LN.assemble(table, self.columns).select("prompt_id", "is_malicious", "features")
        scored = self.calibrator.transform(self.stack.predict(ready), name="probability")
        return scored.select(
            "prompt_id", "is_malicious", "score", "probability",
            (F.col("probability") >= self.threshold).cast("int").alias("pred"),
        )


def test_report(predicted: DataFrame, score: str = "probability") -> DataFrame:
    """One row: confusion cells, all threshold metrics, roc_auc and pr_auc."""
    one = E.with_metrics(E.confusion(predicted, F.col("pred"))).withColumn("_k", F.lit(1))
    ranking = E.ranking_metrics(E.ranked(predicted, score)).withColumnRenamed("average_precision", "pr_auc")
    return one.join(ranking.withColumn("_k", F.lit(1)), "_k").drop("_k")


def experiments() -> dict[str, list[str]]:
    """Name and input columns of the 20 ablation runs."""
    runs = {
        "full": inputs(), "tfidf_only": inputs(use_handcrafted=False), "handcrafted_only": inputs(use_tfidf=False),
    }
    return {**runs, **{f"no_{g}": inputs(without=[g]) for g in L.FEATURE_GROUPS}}


def ablation(table: DataFrame, learners: Callable[[], Mapping], n_terms: int, runs: Mapping[str, Sequence[str]] | None = None,
             meta_iterations: int = 1000, at_once: int = AT_ONCE) -> DataFrame:
    """One result row per experiment on column subsets of one feature table.

    ``learners`` is a function giving fresh base learners for each run; ``at_once`` runs are fitted at the same time.
    """
    spark = table.sparkSession

    def one(name: str, columns: Sequence[str]) -> dict:
        guard = Guard.fit(table, columns, learners(), meta_iterations=meta_iterations)
        row = test_report(guard.predict(table.where("split = 'test'"))).first().asDict()
        total = len(columns) + (n_terms - 1 if "tfidf" in columns else 0)
        return row | {"experiment": name, "total_features": total, "threshold": guard.threshold, "ece": guard.ece}

    rows = list(together(spark, {n: partial(one, n, c) for n, c in (runs or experiments()).items()}, at_once).values())
    whole = ("tp", "fp", "tn", "fn")
    kinds = ", ".join(f"{c} {'string' if c == 'experiment' else 'int' if c == 'total_features' else 'long' if c in whole else 'double'}" for c in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
