"""Evaluation aggregates: cells, reports, sweeps, curves, calibration error.

Everything is one partial aggregation down to a grid or to distinct scores.
Ranking metrics need a global order; they get it from per-bucket windows plus
bucket offsets, so no single task ever sorts the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from promptsieve.functions import metrics as M

LABEL, SCORE = "is_malicious", "score"


def grid_index(value: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are <= value, as a balanced CASE tree."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(float(edges[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def confusion(frame: DataFrame, pred: Column, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label)
    return frame.groupBy(*by).agg(
        F.count_if((pred == 1) & (y == 1)).alias("tp"),
        F.count_if((pred == 1) & (y == 0)).alias("fp"),
        F.count_if((pred == 0) & (y == 0)).alias("tn"),
        F.count_if((pred == 0) & (y == 1)).alias("fn"),
    )


def with_metrics(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Adds the metrics of a table that has tp, fp, tn, fn columns."""
    exprs = M.from_cells()
    return cells.select("*", *[exprs[n].alias(n) for n in (names or exprs)])


def class_report(frame: DataFrame, pred: str, label: str = LABEL, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, plus the support-weighted row."""
    counts = frame.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_class = counts.agg(
        *[F.coalesce(F.sum(F.when((F.col("y") == c) & (F.col("p") == c), F.col("n"))), F.lit(0)).alias(f"hit{c}") for c in classes],
        *[F.coalesce(F.sum(F.when(F.col("p") == c, F.col("n"))), F.lit(0)).alias(f"said{c}") for c in classes],
        *[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("n"))), F.lit(0)).alias(f"support{c}") for c in classes],
    ).select(F.explode(F.array(*[
        F.struct(
            F.lit(str(c)).alias("class"), F.col(f"hit{c}").cast("double").alias("hit"),
            F.col(f"said{c}").cast("double").alias("said"), F.col(f"support{c}").alias("support"),
        ) for c in classes
    ])).alias("r")).select("r.*")
    hit, said, support = F.col("hit"), F.col("said"), F.col("support")
    scored = per_class.select(
        "class", M.ratio(hit, said).alias("precision"), M.ratio(hit, support).alias("recall"),
        M.ratio(2 * hit, said + support).alias("f1"), "support",
    )
    n = F.sum("support")
    weighted = scored.agg(
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1")],
        n.alias("support"),
    ).select(F.lit("weighted").alias("class"), "precision", "recall", "f1", "support")
    return scored.unionByName(weighted)


def grid_cells(
    frame: DataFrame, thresholds: Sequence[float], score: str = SCORE, label: str = LABEL,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion cells at every threshold (score >= t is positive) from one aggregation.

    Rows collapse to one count pair per grid cell; the cumulative step then runs
    over at most len(thresholds) + 1 entries per group.
    """
    y = F.col(label)
    cells = frame.groupBy(*by, grid_index(F.col(score), thresholds).alias("cell")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    packed = cells.groupBy(*by).agg(
        F.collect_list(F.struct("cell", "pos", "neg")).alias("cells"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )
    grid = packed.select(
        *by, "cells", "n_pos", "n_neg",
        F.posexplode(F.lit([float(t) for t in thresholds])).alias("i", "threshold"),
    )

    def above(part: str) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("bigint"),
            lambda acc, c: acc + F.when(c["cell"] > F.col("i"), c[part]).otherwise(F.lit(0)),
        )

    return grid.select(
        *by, "threshold", above("pos").alias("tp"), above("neg").alias("fp"), "n_pos", "n_neg"
    ).select(
        *by, "threshold", "tp", "fp",
        (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"),
    )


SWEEP_THRESHOLDS = tuple(t / 100.0 for t in range(30, 80))
SWEEP_METRICS = ("balanced_accuracy", "f1", "mcc", "precision", "recall", "fpr", "fnr")


def threshold_sweep(
    frame: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, score: str = SCORE,
    label: str = LABEL, by: Sequence[str] = (),
) -> DataFrame:
    """All sweep metrics at each threshold; one shuffle of at most |grid| rows per task."""
    return with_metrics(grid_cells(frame, thresholds, score, label, by), SWEEP_METRICS)


def constrained_optimum(sweep: DataFrame, max_fnr: float = 0.05) -> DataFrame:
    """Best balanced accuracy with fnr <= max_fnr, else the smallest fnr; lowest threshold on ties."""
    feasible = F.col("fnr") <= max_fnr
    row = F.struct(*sweep.columns)
    return sweep.agg(
        F.max_by(row, F.when(feasible, F.struct(F.col("balanced_accuracy"), -F.col("threshold")))).alias("a"),
        F.min_by(row, F.struct(F.col("fnr"), F.col("threshold"))).alias("b"),
    ).select(F.coalesce("a", "b").alias("r")).select("r.*")


def f1_thresholds(start: float = 0.05, stop: float = 0.95, step: float = 0.01) -> list[float]:
    import numpy as np

    return np.arange(start, stop, step).tolist()


def best_f1_threshold(frame: DataFrame, thresholds: Sequence[float] | None = None, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """(threshold, f1): the first maximum over the grid; 0.5 if no F1 is above 0."""
    sweep = with_metrics(grid_cells(frame, thresholds or f1_thresholds(), score, label), ("f1",))
    best = sweep.agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("f1"),
    )
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(0.5)).alias("threshold"), "f1")


def calibration_error(frame: DataFrame, score: str = SCORE, label: str = LABEL, bins: int = 10, closed: bool = False) -> DataFrame:
    """Expected calibration error over equal half-open bins.

    As published, a score of exactly 1.0 belongs to no bin; ``closed`` puts it in the last.
    """
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    cell = grid_index(F.col(score), edges)
    if closed:
        cell = F.least(cell, F.lit(bins))
    per_bin = frame.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("y"), F.avg(score).alias("p")
    )
    inside = F.col("cell").between(1, bins)
    return per_bin.agg(
        F.coalesce(
            F.sum(F.when(inside, F.col("n") * F.abs(F.col("y") - F.col("p")))) / F.sum("n"), F.lit(0.0)
        ).alias("ece"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n_binned"),
        F.sum("n").alias("n"),
    )


BUCKET_SCORES, MOST_BUCKETS = 1_000_000, 8192


def quantile_splits(frame: DataFrame, score: str = SCORE, buckets: int = 64) -> list[float]:
    """Distinct approximate quantiles; at most ``buckets`` - 1 numbers reach the driver."""
    probs = [i / buckets for i in range(1, buckets)]
    found = frame.approxQuantile(score, probs, 0.25 / buckets)
    return sorted(set(found))


def ranked(
    frame: DataFrame, score: str = SCORE, label: str = LABEL, splits: Sequence[float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct score with cumulative counts from the top.

    Columns: score, pos, neg, tp, fp (cumulative, inclusive), n_pos, n_neg, and
    next_pos / next_neg, the counts at the next lower score (null at the end).

    Ties are collapsed by the first aggregation, so a score held by a third of the
    rows is one row.  The order is then resolved inside quantile buckets, of about
    ``BUCKET_SCORES`` distinct scores unless ``buckets`` is given, and a table of at most
    len(splits) + 1 bucket totals supplies the offsets.
    """
    if splits is None:
        if buckets is None:
            scores = frame.agg(F.approx_count_distinct(score)).first()[0]
            buckets = min(MOST_BUCKETS, max(64, scores // BUCKET_SCORES))
        splits = quantile_splits(frame, score, buckets)
    y = F.col(label)
    grouped = (
        frame.groupBy(F.col(score).alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    if len(splits) <= 256:
        grouped = grouped.withColumn("bucket", grid_index(F.col("score"), splits))
    else:  # by binary search
        cuts = [float("-inf"), *splits, float("inf")]
        grouped = Bucketizer(splits=cuts, inputCol="score", outputCol="_bucket", handleInvalid="keep").transform(
            grouped).withColumn("bucket", F.col("_bucket").cast("int")).drop("_bucket")
    totals = grouped.groupBy("bucket").agg(
        F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("top"),
    )
    # One row holding every bucket total, newest bucket first; bounded by the splits.
    packed = totals.agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("bucket", "b_pos", "b_neg", "top")))).alias("all"),
        F.sum("b_pos").alias("n_pos"), F.sum("b_neg").alias("n_neg"),
    )
    before = lambda part: F.aggregate(
        F.slice("all", 1, F.col("i")), F.lit(0).cast("bigint"), lambda acc, b: acc + b[part]
    )
    offsets = packed.select("all", "n_pos", "n_neg", F.posexplode("all").alias("i", "b")).select(
        F.col("b.bucket").alias("bucket"), "n_pos", "n_neg",
        before("b_pos").alias("pos_above"), before("b_neg").alias("neg_above"),
        F.get("all", F.col("i") + 1)["top"].alias("next_top"),
    )
    w = W.partitionBy("bucket").orderBy(F.col("score").desc())
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    return grouped.join(F.broadcast(offsets), "bucket").select(
        "score", "pos", "neg",
        (F.col("pos_above") + F.sum("pos").over(so_far)).alias("tp"),
        (F.col("neg_above") + F.sum("neg").over(so_far)).alias("fp"),
        "n_pos", "n_neg",
        F.coalesce(F.lead("pos").over(w), F.col("next_top.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(w), F.col("next_top.neg")).alias("next_neg"),
    )


def roc_auc(rank: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties counting one half; null where a class is missing."""
    above = F.col("tp") - F.col("pos")
    return rank.agg(
        F.try_divide(
            F.sum(F.col("neg").cast("double") * (above + F.col("pos") / 2)),
            F.max("n_pos").cast("double") * F.max("n_neg"),
        ).alias("roc_auc")
    )


def average_precision(rank: DataFrame) -> DataFrame:
    """Step-wise average precision (not the trapezoid); null without a positive."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return rank.agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.max("n_pos")).alias("average_precision")
    )


def ranking_metrics(rank: DataFrame) -> DataFrame:
    """roc_auc and average_precision in one pass over the ranking."""
    above = F.col("tp") - F.col("pos")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return rank.agg(
        F.try_divide(
            F.sum(F.col("neg").cast("double") * (above + F.col("pos") / 2)),
            F.max("n_pos").cast("double") * F.max("n_neg"),
        ).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.max("n_pos")).alias("average_precision"),
    )


def roc_curve(rank: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) from (+inf, 0, 0) down, without collinear inner points."""
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    last = F.col("next_pos").isNull()
    corner = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = rank.where(first | last | corner) if drop_collinear else rank
    points = kept.select(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"),
    )
    origin = rank.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_curve(rank: DataFrame) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the (1, 0) end point."""
    points = rank.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("n_pos")).alias("recall"),
    )
    end = rank.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def score_histogram(frame: DataFrame, score: str = SCORE, label: str = LABEL, bins: int = 50) -> DataFrame:
    """Counts and densities of the score per class, over each class's own range."""
    ranges = frame.groupBy(label).agg(
        F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("n_class")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)),
    ).otherwise(F.lit(0)).cast("int")
    # ``ranges`` has one row per class.
    return (
        frame.join(F.broadcast(ranges), label)
        .groupBy(label, cell.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.first("n_class").alias("n_class"),
            F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        )
        .select(
            label, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "n",
            F.when(width > 0, F.col("n") / (F.col("n_class") * width)).alias("density"),
        )
    )


def majority_baseline(frame: DataFrame, label: str = LABEL) -> DataFrame:
    """Accuracy of always answering with the larger class."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        (F.max("n") / F.sum("n")).alias("baseline"),
        F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("majority_class"),
        F.sum("n").alias("n"),
    )
