"""The online loop: buffered feedback, scheduled retraining, and scoring with the newest calibrator.

Everything is tables below one folder that all executors reach:

* ``buffer/batch=N``: the newest judged events of each stream in micro-batch N;
* ``versions/version=N``: a calibrator (Spark ML models) and its state, one row. A version is prepared elsewhere
  and renamed into place, so a reader sees all of it or nothing, and of two retrainers at once only one wins;
* ``scores/batch=N``: what micro-batch N of predictions was scored as, and by which version.

A retraining reads the buffer behind the last micro-batch that the newest version has seen and records how far
it came: that clears the buffer without deleting a row, and a failed retraining changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptsieve.operators import adapt as A
from promptsieve.operators import learn as LN
from promptsieve.streaming.drift import put, stored
from promptsieve.streaming.feedback import make_folder

EVENTS = "stream_id long, event_id long, ts timestamp, score double, pred int, label int"
STATE = (
    "version long, threshold double, fp_ema double, baseline_mean double, baseline_std double, n long, upto_batch long"
)
SCORES = "prompt_id long, score double, calibrated double, pred int, version long"
FIRST = {"version": 0, "threshold": 0.55, "fp_ema": 0.05, "baseline_mean": 0.5, "baseline_std": 0.2, "n": 0, "upto_batch": -1}


@dataclass
class Version:
    """A published calibrator with its threshold, averages and reach; version 0 leaves scores as they are."""

    state: dict
    calibrator: LN.Calibrator | None = None

    def transform(self, scored: DataFrame) -> DataFrame:
        """Adds ``calibrated``, ``pred`` by this version's threshold, and ``version``."""
        known = scored.withColumn("calibrated", F.col("score")) if self.calibrator is None else self.calibrator.transform(scored)
        return known.withColumn("pred", (F.col("calibrated") >= self.state["threshold"]).cast("int")).withColumn(
            "version", F.lit(self.state["version"]).cast("long"))


class Versions:
    """The versions published below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, make_folder(spark, f"{folder}/versions")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def newest(self) -> Version:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else Version(dict(FIRST))

    def read(self, number: int) -> Version:
        at = f"{self.folder}/version={number}"
        state = self.spark.read.schema(STATE).parquet(f"{at}/state").first().asDict()
        names = sorted(s.getPath().getName() for s in self.files.listStatus(self.path(f"{at}/models")))
        return Version(state, LN.Calibrator([IsotonicRegressionModel.load(f"{at}/models/{n}") for n in names]))

    def states(self) -> DataFrame:
        """One row per version, the oldest first."""
        rows = [tuple(self.read(n).state[c.split()[0]] for c in STATE.split(", ")) for n in self.numbers()]
        return self.spark.createDataFrame(rows, STATE)

    def publish(self, calibrator: LN.Calibrator, state: dict) -> bool:
        """Whether this became version ``state['version']``; False if another one was there before."""
        staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"
        for i, model in enumerate(calibrator.models):
            model.save(f"{staged}/models/model-{i}")
        row = tuple(state[c.split()[0]] for c in STATE.split(", "))
        self.spark.createDataFrame([row], STATE).coalesce(1).write.parquet(f"{staged}/state")
        target = self.path(f"{self.folder}/version={state['version']}")
        if self.files.exists(target):
            return False
        return bool(self.files.rename(self.path(staged), target))


def start_buffer(feedback: DataFrame, folder: str, size: int = 5000, **trigger) -> StreamingQuery:
    """Append judged events to the buffer: of each micro-batch the newest ``size`` of every stream.

    ``feedback`` has the columns of ``EVENTS``; events without a label, prediction or score are left out.  A
    micro-batch that is run again replaces its rows.
    """
    rows = feedback.withColumn("ts", A.instant(feedback)).selectExpr(
        *(f"cast({n} as {kind}) as {n}" for n, kind in (c.split() for c in EVENTS.split(", "))))

    def append(batch, batch_id):
        judged = batch.dropna(subset=["label", "pred", "score"])
        put(A.feedback_buffer(judged, size, minimum=1).drop("buffered"), f"{folder}/buffer", batch_id)

    return (rows.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/buffer.checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def buffered(spark: SparkSession, folder: str, after: int = -1, size: int = 5000, minimum: int = 100) -> DataFrame:
    """The newest ``size`` events of each stream with at least ``minimum``, of micro-batches later than ``after``."""
    rows = stored(spark, f"{folder}/buffer", EVENTS).where(F.col("batch") > after)
    return A.feedback_buffer(rows.drop("batch"), size, minimum)


def retrain(spark: SparkSession, folder: str, size: int = 5000, minimum: int = 200, per_stream: int = 1) -> Version | None:
    """Refit on what the buffer holds since the newest version and publish the next one.

    None while the events are fewer than ``minimum`` or of one class, or if another retraining was
    faster.  The threshold takes one step, the drift baseline becomes that of the calibrated scores.
    """
    versions = Versions(spark, folder)
    last = versions.newest().state
    waiting = stored(spark, f"{folder}/buffer", EVENTS).where(F.col("batch") > last["upto_batch"])
    upto = waiting.agg(F.max("batch")).first()[0]
    if upto is None:
        return None
    events = A.feedback_buffer(waiting.where(F.col("batch") <= upto).drop("batch"), size, per_stream).persist()
    try:
        counts = events.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("classes")).first()
        made = LN.retrain_on_feedback(events, last["threshold"], last["fp_ema"], minimum) if counts.classes > 1 else None
    finally:
        events.unpersist()
    if made is None:
        return None
    calibrator, state = made
    state |= {"version": last["version"] + 1, "n": counts.n, "upto_batch": upto}
    return Version(state, calibrator) if versions.publish(calibrator, state) else None


def start_scoring(predictions: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Score a stream of (prompt_id, score) with whatever version is newest when a micro-batch begins.

    A micro-batch that is run again replaces its rows; it may be scored by a newer version then.
    """
    versions = Versions(predictions.sparkSession, folder)

    def score(batch, batch_id):
        put(versions.newest().transform(batch.select("prompt_id", "score")).select("prompt_id", "score", "calibrated", "pred", "version"),
            f"{folder}/scores", batch_id)

    return (predictions.writeStream.foreachBatch(score).option("checkpointLocation", f"{folder}/scores.checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/scores", SCORES)
