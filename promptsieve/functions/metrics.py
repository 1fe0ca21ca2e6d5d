"""Binary-classification metrics as expressions over confusion cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def from_cells(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in (tp, fp, tn, fn))
    n = tp + fp + tn + fn
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    accuracy = ratio(tp + tn, n)
    return {
        "accuracy": accuracy,
        # Mean recall over the classes present.
        "balanced_accuracy": F.when(tp + fn == 0, specificity)
        .when(tn + fp == 0, recall)
        .otherwise((recall + specificity) / 2),
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(
            tp * tn - fp * fn,
            F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn),
        ),
        "kappa": ratio(accuracy - chance, 1 - chance),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }
