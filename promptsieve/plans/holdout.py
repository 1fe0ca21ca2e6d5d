"""Leave-one-dataset-out evaluation: each data set in turn is judged by a model that never saw it.

Data sets quote each other, so a plain split by data set would train on texts it tests on. Texts that differ only in
case, accents or blanks form one group, and rows of other data sets whose group occurs in the held-out one are left
out of training. Groups meet as digests; only those of several data sets are joined back, and their lists
are as long as there are data sets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from promptsieve.functions.unicode import one_spelling
from promptsieve.operators import evaluate as E
from promptsieve.operators import learn as LN
from promptsieve.operators.features import features
from promptsieve.streaming.feedback import shared_folder
from promptsieve.together import together

METRICS = ("accuracy", "f1", "mcc", "precision", "recall", "fpr", "fnr", "balanced_accuracy")


def text_group(text: Column) -> Column:
    return F.md5(one_spelling(F.coalesce(text, F.lit(""))).cast("binary"))


def with_quoting(sets: DataFrame) -> DataFrame:
    """(dataset, item_id, prompt_text, is_malicious) with ``group`` and ``quoted_in``, the data sets its group occurs in."""
    grouped = sets.withColumn("group", text_group(F.col("prompt_text")))
    # Map-side distinct first: a text that a third of the rows repeat is one row per task.
    shared = grouped.select("group", "dataset").distinct().groupBy("group").agg(
        F.array_sort(F.collect_list("dataset")).alias("quoted_in")).where(F.size("quoted_in") > 1)
    return grouped.join(shared, "group", "left").withColumn("quoted_in", F.coalesce("quoted_in", F.array("dataset")))


def sides(frame: DataFrame, held_out: str) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) when one data set is held out."""
    return frame.where(~F.array_contains("quoted_in", held_out)), frame.where(F.col("dataset") == held_out)


def side_sizes(frame: DataFrame) -> DataFrame:
    """(held_out, n_train, n_test, n_left_out): rows of each side, and of other data sets that quote the held-out one."""
    counts = frame.groupBy("dataset", "quoted_in").agg(F.count(F.lit(1)).alias("n"))
    met = counts.select("dataset", F.explode("quoted_in").alias("held_out"), "n")
    own = F.col("dataset") == F.col("held_out")
    sizes = met.groupBy("held_out").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_test"), F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("n_left_out"))
    total = F.sum("n_test").over(W.partitionBy())  # one row per data set
    return sizes.select("held_out", (total - F.col("n_test") - F.col("n_left_out")).alias("n_train"), "n_test", "n_left_out")


def holdout_table(sets: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """The sets with quoting and features as a written table, without texts; texts are reduced in their rows."""
    keyed = with_quoting(sets).withColumn("prompt_id", F.monotonically_increasing_id())
    table = features(keyed, groups, keep=("dataset", "item_id", "is_malicious", "group", "quoted_in"))
    target = shared_folder(sets.sparkSession, "holdout")
    table.write.parquet(target)
    return sets.sparkSession.read.parquet(target)


def leave_one_out(table: DataFrame, columns: Sequence[str], learner: Callable[[int], object]) -> DataFrame:
    """One row per held-out data set: ``n_train``, ``n_test``, cells, metrics and roc_auc of ``learner(n_train)``.

    A data set without training rows of both classes gets no metrics.
    """
    spark = table.sparkSession
    names = sorted(r.dataset for r in table.select("dataset").distinct().collect())

    def one(name: str) -> Mapping:
        train, test = sides(table, name)
        sizes = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_malicious") == 1).alias("positive")).first()
        row = {"held_out": name, "n_train": sizes.n, "n_test": test.count()}
        if not 0 < sizes.positive < sizes.n:
            return row
        model = LN.fitted(learner(sizes.n), LN.assemble(train, columns))
        scored = model.transform(LN.assemble(test, columns)).select("is_malicious", LN.positive().alias("score")).persist()
        judged = scored.withColumn("pred", (F.col("score") > 0.5).cast("int"))
        row |= E.with_metrics(E.confusion(judged, F.col("pred")), METRICS).first().asDict() | E.roc_auc(E.ranked(judged)).first().asDict()
        scored.unpersist()
        return row

    rows = together(spark, {n: partial(one, n) for n in names})
    whole = ("n_train", "n_test", "tp", "fp", "tn", "fn")
    columns_out = ("held_out", *whole, *METRICS, "roc_auc")
    kinds = ", ".join(f"{c} {'string' if c == 'held_out' else 'long' if c in whole else 'double'}" for c in columns_out)
    return spark.createDataFrame([tuple(rows[n].get(c) for c in columns_out) for n in names], kinds)
